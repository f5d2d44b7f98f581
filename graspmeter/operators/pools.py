"""Question pools of very many users, without a product of users and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter.session import materialize

#: Ranks of a block: what a user has been shown is looked at block by block.
BLOCK = 4_096


def ranked_questions(questions: DataFrame, order: list[Column]) -> DataFrame:
    """``questions`` with ``rank`` from 1 in the given order, which must tell all rows apart.

    Rows are dealt out by ranges of the order and numbered where they lie; only the sizes of the
    ranges, one row a task, are summed up.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = questions.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("__part"), inside.alias("__at")), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    return dealt.join(offsets, "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def missing_ranks(users: DataFrame, shown: DataFrame, last: int, n: int, block: int = BLOCK) -> DataFrame:
    """``(user_id, rank, fresh)``: the first ``n`` ranks of 1 to ``last`` that a user was not shown.

    ``users`` has ``user_id``, ``shown`` has ``user_id, rank``, repeated rows allowed. A user who
    was shown all ranks gets the first ``n`` of those, with ``fresh`` false. Users that are
    null or only in ``shown`` get nothing.

    Between two ranks shown one after the other all ranks are missing, so the answer follows
    from the gaps. The counts of whole blocks come first, and only the blocks in which
    the first ``n`` missing ranks can lie are looked at rank by rank: a user with very many
    shown ranks gives a row a block, and gaps of a few blocks.
    """
    users = users.select("user_id").where("user_id is not null").distinct()
    seen = shown.where(F.col("rank").between(1, last)).select("user_id", F.col("rank").cast("long").alias("rank")).distinct()
    seen = materialize(seen.withColumn("block", F.floor((F.col("rank") - 1) / block)), "seen")
    counts = seen.groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n_shown"))

    # Blocks with something missing, in order, until n ranks are missing; blocks without any row shown lie between them.
    earlier = Window.partitionBy("user_id").orderBy("block")
    size = F.least(F.lit(block), F.lit(last) - F.col("block") * block)
    shown_before = F.coalesce(F.sum("n_shown").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("user_id", "block", "n_shown", (F.col("block") * block - shown_before).alias("missing_before"), size.alias("size"))
    open_blocks = spans.where((F.col("missing_before") < n) & (F.col("n_shown") < F.col("size")))
    inner = seen.join(open_blocks.select("user_id", "block", "missing_before"), ["user_id", "block"])
    rows = Window.partitionBy("user_id", "block").orderBy("rank")
    placed = inner.withColumns(
        {
            "before": F.coalesce(F.lag("rank").over(rows), F.col("block") * block),
            "nth": F.col("rank") - F.col("block") * block - F.row_number().over(rows) + F.col("missing_before"),
            "behind": F.when(F.lead("rank").over(rows).isNull(), F.least((F.col("block") + 1) * block, F.lit(last)) + 1),
        }
    )
    # A gap is (first rank, number of ranks, missing ranks before it). One lies before each shown rank, one ends each block.
    def gap(after: str, until: str, missing: Column) -> Column:
        return F.struct((F.col(after) + 1).alias("first"), (F.col(until) - F.col(after) - 1).alias("n"), missing.alias("missing"))

    before = gap("before", "rank", F.col("nth") - (F.col("rank") - F.col("before") - 1))
    behind = gap("rank", "behind", F.col("nth"))
    gaps = placed.select("user_id", F.inline(F.array_compact(F.array(before, F.when(F.col("behind").isNotNull(), behind)))))

    # Whole blocks that a user was shown nothing of: before the first, between two, behind the last.
    next_block = F.coalesce(F.lead("block").over(earlier), F.ceil(F.lit(last) / F.lit(float(block))))
    after = counts.select(
        "user_id", (F.col("block") + 1).alias("from"), next_block.alias("to"), (F.sum("n_shown").over(earlier.rowsBetween(Window.unboundedPreceding, 0))).alias("shown")
    )
    first = counts.groupBy("user_id").agg(F.min("block").alias("to")).select("user_id", F.lit(0).cast("long").alias("from"), "to", F.lit(0).cast("long").alias("shown"))
    nothing = users.join(counts.select("user_id").distinct(), "user_id", "left_anti")
    all_blocks = nothing.select("user_id", F.lit(0).cast("long").alias("from"), F.ceil(F.lit(last) / F.lit(float(block))).alias("to"), F.lit(0).cast("long").alias("shown"))
    empty = after.unionByName(first).unionByName(all_blocks).where(F.col("to") > F.col("from"))
    whole = empty.select(
        "user_id", (F.col("from") * block + 1).alias("first"), (F.least(F.col("to") * block, F.lit(last)) - F.col("from") * block).alias("n"),
        (F.col("from") * block - F.col("shown")).alias("missing"),
    )
    wanted = gaps.unionByName(whole).where((F.col("n") > 0) & (F.col("missing") < n))
    rank = F.explode(F.sequence("first", F.col("first") + F.least(F.col("n"), F.lit(n) - F.col("missing")) - 1))
    fresh = wanted.join(users, "user_id", "left_semi").select("user_id", rank.alias("rank"), F.lit(True).alias("fresh"))

    full = counts.groupBy("user_id").agg(F.sum("n_shown").alias("n_shown")).where(F.col("n_shown") == last).join(users, "user_id", "left_semi")
    again = full.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(min(n, last)).cast("long"))).alias("rank"), F.lit(False).alias("fresh"))
    return fresh.unionByName(again)


def fresh_pools(questions: DataFrame, shown: DataFrame, users: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """For each user the first ``n`` questions not shown to them yet, or of all if there are none: ``user_id, question_id, rank, fresh``.

    ``questions`` has a ``question_id`` that tells its rows apart; ids shown that are no
    question don't count. Without questions there are no rows.
    """
    ranked = ranked_questions(questions, order).select("question_id", "rank")
    ranked = materialize(ranked, "ranks")
    last = ranked.count()
    seen = shown.join(ranked, "question_id").select("user_id", "rank")
    return missing_ranks(users, seen, last, n).join(ranked, "rank").select("user_id", "question_id", "rank", "fresh")
