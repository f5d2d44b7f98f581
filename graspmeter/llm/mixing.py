"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are sorted by key
ranges, prefix sums of their sizes are formed over the sums of the ranges, and the source's
budget cuts the order: whole epochs first, then what the last epoch still takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter.llm.common import word_count, written

#: Documents in a key range on average.
RANGE_ROWS = 4_000


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """``sources`` (source, source_size) with the words that each is to give.

    The mix has ``share`` times all words. Weights repeat over the sources by code point (null
    last). A source gives at most ``repeats`` times its size; what it can't give goes to the
    others by weight. So there is one level with ``target = min(repeats * size, weight * level)``,
    found with running sums over the sources in the order in which they reach their limit.
    This works on one row for each source, never on documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.isnull("source"), "source")
    by_limit = Window.orderBy("reach", F.isnull("source"), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(repeats))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("before")) / F.col("after")
    found = (
        sources.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("reach", F.col("limit") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("after", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("free", F.col("limit") > F.col("weight") * F.col("level"))
    )
    chosen = F.min(F.when(F.col("free"), F.struct("reach", "level"))).over(everything)["level"]
    return found.withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("weight") * chosen, F.col("limit")))).select(
        *sources.columns, "target"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    repeats: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of every row: ``size, source_size, target, taken``.

    ``taken`` sums up to the rounded target of each source; the row at the cut gives a part of
    its words. A null source is a source of its own. Null and empty texts have size 0 and give
    nothing. Equal ids have equal keys and follow each other by size, so reruns agree. Other
    columns are not read; an empty table gives an empty result.
    """
    sizes = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes"
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = written(source_targets(totals, weights, share, repeats), "sources").select(F.col("source").alias("of"), "source_size", "rows", "target")

    point = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id").cast("string")), 11) / F.lit(float(1 << 53))
    keyed = (
        sizes.join(sources, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("key", point)
        .withColumn("range", F.floor(F.col("key") * F.ceil(F.col("rows") / RANGE_ROWS)))
        .drop("of", "rows")
    )
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))
    )
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - (F.col("offset") + F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken")
    )
