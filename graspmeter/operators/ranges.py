"""Joins on order instead of equality: points in intervals, and the nearest row before or behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter.session import materialize

#: Levels of bucket widths: lengths of a long differ by less than that many doublings.
_LEVELS = 63
#: Intervals are filed under wider buckets so that points look into fewer: at most so many
#: doublings wider, and only while the pairs to compare stay below that multiple by estimate.
_WIDER, _MORE_PAIRS = 6, 4.0


def _filed_levels(costs: dict[int, float]) -> dict[int, int]:
    """For each level the one that its intervals are filed under, itself or a wider one.

    ``costs`` weighs the intervals of a level; times the width that is the pairs they are compared in.
    """
    spare = (_MORE_PAIRS - 1) * sum(cost * 2.0**n for n, cost in costs.items())
    filed, wide = {}, None
    for n in sorted(costs, reverse=True):
        extra = costs[n] * (2.0**wide - 2.0**n) if wide is not None else 0.0
        if wide is None or wide - n > _WIDER or extra > spare:
            wide, extra = n, 0.0
        filed[n], spare = wide, spare - extra
    return filed


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int = 1
) -> DataFrame:
    """Every pair of a point and an interval of equal keys with ``start <= at <= end``.

    ``at``, ``start`` and ``end`` are integers (days, lines, microseconds). An interval is filed
    under buckets of the first width ``width * 2 ** level`` that is longer than it, or of a wider
    one that others need anyway, which are two at most whatever its length; a point looks into one
    bucket of each level that is used. So it is an equi-join on keys, level and bucket: a key with
    very many rows spreads over its buckets. Each pair meets in one bucket only. Rows with a null in keys or bounds match nothing.

    Columns: the keys, then all others of both sides; other equal names must not occur.
    """
    units = F.call_function("div", F.col(end) - F.col(start), F.lit(width))
    level = F.length(F.bin(units)).cast("int")
    sided = intervals.where(F.col(end) >= F.col(start)).withColumn("__level", level)
    # A key's intervals weigh by their number, as its points probably do, so hot keys decide.
    by_level = sided.groupBy(*keys, "__level").agg(F.count("*").alias("__n"))
    of_key = by_level.groupBy(*keys).agg(F.sum("__n").cast("double").alias("__all"), F.collect_list(F.struct("__level", "__n")).alias("__by"))
    costs = of_key.select("__all", F.inline("__by")).groupBy("__level").agg(F.sum(F.col("__all") * F.col("__n")))
    places = _filed_levels(dict(tuple(row) for row in costs.limit(_LEVELS + 1).collect()))
    if places:
        wider = F.create_map(*[F.lit(n) for place in places.items() for n in place])
        sided = sided.withColumn("__level", F.element_at(wider, F.col("__level")))

    def bucket(value: Column, of: Column) -> Column:
        wide = F.lit(width) * F.call_function("shiftleft", F.lit(1).cast("long"), of)
        return F.call_function("div", value - F.pmod(value, wide), wide)

    first, last = bucket(F.col(start), F.col("__level")), bucket(F.col(end), F.col("__level"))
    filed = sided.withColumn("__bucket", F.explode(F.array_distinct(F.array(first, last))))
    levels = F.array(*[F.lit(n) for n in sorted(set(places.values()))]).cast("array<int>")
    looking = points.withColumn("__level", F.explode(levels)).withColumn("__bucket", bucket(F.col(at), F.col("__level")))
    met = looking.join(filed, [*keys, "__level", "__bucket"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("__level", "__bucket")


def merged_intervals(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The intervals of each key without overlaps: those that touch are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach, 0).otherwise(1)
    numbered = intervals.select(*keys, start, end, new.alias("__new")).withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__no").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__no")


def covered(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, name: str = "covered") -> DataFrame:
    """``points``, all of them, with a flag: is the point inside some interval of its keys?"""
    spans = merged_intervals(intervals, keys, start, end)
    placed = asof_join(points, spans.withColumnsRenamed({start: "__start", end: "__end"}), keys, at, "__start")
    inside = F.coalesce(F.col("found.__end") >= F.col(at), F.lit(False))
    return placed.withColumn(name, inside).drop("found")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    direction: str = "backward",
    ties: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """``left``, all rows, with ``found``: the nearest row of ``right`` with equal keys before it, as a struct.

    ``direction`` is ``backward`` (at or before), ``forward`` (at or behind) or ``nearest`` (the
    earlier one of two equally near; needs numbers). Without ``exact`` a row at the very place
    does not count. Of right rows at one place the last by ``ties`` counts. Rows of
    ``left`` with a null key or place, or without a match, have a null.

    Both sides are united and dealt out by ranges of keys and place, so the rows of a hot key
    lie in several tasks. A task carries the last right row down; only the last key of each task
    and its last right row, one row a task, are passed on to the tasks behind.
    """
    if direction == "nearest":
        back = asof_join(left, right, keys, left_at, right_at, "backward", ties, exact).withColumnRenamed("found", "__back")
        both = asof_join(back, right, keys, left_at, right_at, "forward", ties, exact)
        place, other = F.col(left_at), F.col("found")
        behind = F.col("__back").isNull() | (other[right_at] - place < place - F.col("__back")[right_at])
        return both.withColumn("found", F.when(other.isNotNull() & behind, other).otherwise(F.col("__back"))).drop("__back")
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward, forward or nearest")
    side = int(exact)
    found = F.struct(*[F.col(c) for c in right.columns])
    rights = right.where(" and ".join(f"`{c}` is not null" for c in (*keys, right_at)))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.lit(None).cast("int")
    lefts = left.select(*named, F.col(left_at).alias("__at"), F.lit(side).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    rights = rights.select(*named, F.col(right_at).alias("__at"), F.lit(1 - side).alias("__side"), tie.alias("__tie"), found.alias("__right"))
    rows = lefts.unionByName(rights, allowMissingColumns=True).withColumn("__row", F.monotonically_increasing_id())
    place = F.asc_nulls_first("__at") if direction == "backward" else F.desc_nulls_first("__at")
    names = [f"__k{i}" for i in range(len(keys))]
    order = [*names, place, F.col("__side"), F.col("__tie"), F.col("__row")]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "asof")

    key = F.struct(*names)
    whole = F.when(F.col("__right").isNotNull(), F.struct(F.col("__side").alias("side"), F.col("__tie").alias("tie"), F.col("__row").alias("row")))
    # The last right row of a key in a part: at the utmost place, of those the last by ties.
    spot = F.when(whole.isNotNull(), F.col("__at"))
    utmost = F.max(spot) if direction == "backward" else F.min(spot)
    by_key = dealt.groupBy("__part", *names).agg(utmost.alias("__utmost"))
    edges = by_key.groupBy("__part").agg(F.max(F.struct(*names, "__utmost")).alias("__last"), F.min(key).alias("__first"))
    edges = materialize(edges.select("__part", "__first", *[F.col(f"__last.{n}").alias(n) for n in names], F.col("__last.__utmost").alias("__utmost")), "edges")
    same = [F.col(f"e.{n}").eqNullSafe(F.col(f"d.{n}")) for n in names]
    tail = (
        dealt.alias("d")
        .join(F.broadcast(edges.where("__utmost is not null").alias("e")), [F.col("e.__part") == F.col("d.__part"), F.col("e.__utmost") == F.col("d.__at"), *same])
        .where("d.__right is not null")
        .groupBy("d.__part")
        .agg(F.max_by(F.col("d.__right"), F.struct("d.__tie", "d.__row")).alias("__right"))
    )
    until = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = edges.join(tail, "__part", "left").withColumn("__upto", F.last("__right", ignorenulls=True).over(until))
    # A part goes on with the key that the part before it ends with, so that one has its carry.
    before = Window.orderBy("__part")
    carried = known.select("__part", "__first", F.lag(F.struct(F.struct(*names).alias("key"), "__upto")).over(before).alias("__before"))
    carried = carried.where("__before is not null").select(
        "__part", *[F.col(f"__first.{n}").alias(n) for n in names], F.when(F.col("__first") == F.col("__before.key"), F.col("__before.__upto")).alias("__carry")
    )
    within = Window.partitionBy("__part", *names).orderBy(place, "__side", "__tie", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = dealt.withColumn("__down", F.last("__right", ignorenulls=True).over(within)).where("__left is not null")
    carries = F.broadcast(carried.where("__carry is not null"))
    joined = down.join(carries, ["__part", *names], "left").withColumn("found", F.coalesce("__down", "__carry"))
    missing = F.greatest(*[F.col(n).isNull().cast("int") for n in (*names, "__at")], F.lit(0), F.lit(0)) == 1
    return joined.select("__left.*", F.when(~missing, F.col("found")).alias("found"))
