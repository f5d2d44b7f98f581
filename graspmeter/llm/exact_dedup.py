"""Exact dedup with counting quotient filters.

Each partition builds a filter of the 64-bit fingerprints of its normalised texts: the high
bits of a fingerprint (quotient) choose a block, the block holds its fingerprints' low bits
(remainders) in order, each with a counter. Blocks of the same quotients merge without loss
by their sorted remainders, so only counters travel, and a text that fills a third of the
corpus is one entry per partition. Rows whose merged counter is above one go on to byte
verification, which groups by the text itself; all others are unique already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graspmeter.llm.common import one_space, written

#: Distinct fingerprints that a block of the merged filter holds on average.
BLOCK = 50_000
#: Fingerprints of a partition that are sorted at once.
NEW = 1 << 16
#: Rows of one text that a task of the byte verification gets, and how many texts may be split.
SHARE, HOT_TEXTS = 5_000, 1_000
FILTER = "block int, remainders array<long>, counts array<long>"


def merge_sorted(remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal remainders once, with the sum of their counters, in order."""
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    starts = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]]) if len(remainders) else np.zeros(0, int)
    return remainders[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Build:
    """A partition's fingerprints and counters, from batches of any size in time n log n.

    New fingerprints wait until they are ``NEW``, then make a sorted run; a run is merged into
    the one before it as soon as it is as long, so each fingerprint is moved a few times only.
    """

    def __init__(self):
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, fingerprints: np.ndarray) -> None:
        self.waiting.append(fingerprints)
        self.held += len(fingerprints)
        if self.held >= NEW:
            self.settle()
            while len(self.runs) > 1 and len(self.runs[-2][0]) <= len(self.runs[-1][0]):
                self.join_last()

    def settle(self) -> None:
        new = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        self.runs.append(merge_sorted(new, np.ones(len(new), np.int64)))
        self.waiting, self.held = [], 0

    def join_last(self) -> None:
        (keys, counts), (more, added) = self.runs.pop(), self.runs.pop()
        self.runs.append(merge_sorted(np.r_[keys, more], np.r_[counts, added]))

    def finished(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        while len(self.runs) > 1:
            self.join_last()
        return self.runs[0]


def partition_filters(fingerprints: DataFrame, quotient_bits: int) -> DataFrame:
    """The counting quotient filter of each partition, a row for each block that is not empty."""
    shift = 64 - quotient_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        build = Build()
        for batch in batches:
            build.add(batch["fingerprint"].to_numpy(np.int64).view(np.uint64))
        keys, counts = build.finished()
        if not len(keys):
            return
        blocks = (keys >> np.uint64(shift)).astype(np.int64) if quotient_bits else np.zeros(len(keys), np.int64)
        remainders = (keys & np.uint64((1 << shift) - 1)).view(np.int64)
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        yield pd.DataFrame(
            {"block": blocks[cuts].astype(np.int32), "remainders": np.split(remainders, cuts[1:]), "counts": np.split(counts, cuts[1:])}
        )

    return fingerprints.select("fingerprint").mapInPandas(build, FILTER)


def merged_filter(filters: DataFrame, quotient_bits: int) -> DataFrame:
    """Fingerprints and counters over all partitions' filters."""
    shift = 64 - quotient_bits

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        remainders, counts = merge_sorted(np.concatenate(group["remainders"].to_numpy()), np.concatenate(group["counts"].to_numpy()))
        high = np.uint64(int(group["block"].iloc[0]) << shift if quotient_bits else 0)
        return pd.DataFrame({"fingerprint": (remainders.view(np.uint64) | high).view(np.int64), "n": counts})

    return filters.groupBy("block").applyInPandas(merge, "fingerprint long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with the row that stays of its group: ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each run of white space became one space; a
    null text equals the empty one. The smallest id stays; where rows share that id as well
    (repeated rows), one of them stays. A row without id stays only if its whole group has none.
    Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), one_space(F.col(text_col)).alias("norm"))
    digest = [F.xxhash64("norm").alias("fingerprint"), F.sha2("norm", 256).alias("sha")]
    digests = written(docs.select("id", F.monotonically_increasing_id().alias("row"), *digest), "digests")
    rows = digests.count()
    bits = max(0, int(np.ceil(np.log2(max(1, rows / BLOCK)))))
    counters = merged_filter(partition_filters(digests, bits), bits).where("n > 1")
    repeated = written(counters, "repeated")

    # A hot text is dealt to several tasks. At most HOT_TEXTS fingerprints can have more rows than this.
    hot = repeated.where(F.col("n") > max(SHARE, rows // HOT_TEXTS)).withColumn("shares", F.ceil(F.col("n") / SHARE))
    dealt = (
        docs.select("id", "norm", F.xxhash64("norm").alias("fingerprint"))
        .join(F.broadcast(hot.select("fingerprint", "shares")), "fingerprint", "left")
        .withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("id"), "shares")).otherwise(F.lit(0)))
    )
    wanted = (
        repeated.select("fingerprint", "n")
        .join(F.broadcast(hot.select("fingerprint", "shares")), "fingerprint", "left")
        .select("fingerprint", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    )
    least, number = F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    classes = (
        dealt.join(wanted, ["fingerprint", "share"], "left_semi")
        .groupBy("fingerprint", "share", "norm")
        .agg(least, number)
        .groupBy("fingerprint", "norm")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("fingerprint", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
        .where("group_size > 1")
    )
    # Which row stays, should several have the smallest id.
    keepers = (
        digests.join(repeated.select("fingerprint"), "fingerprint", "left_semi")
        .groupBy("fingerprint", "sha")
        .agg(F.min(F.struct(F.isnull("id"), "id", "row"))["row"].alias("keep_row"))
    )
    # A written side lets Spark split a hot text's rows in the last join.
    marked = written(classes.join(keepers, ["fingerprint", "sha"]), "classes")
    found = digests.join(marked, ["fingerprint", "sha"], "left")
    single = F.col("keep_row").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that share id and text count as copies too and come down to one; of rows that share
    an id only, each is judged by its own text.
    """
    groups = exact_groups(docs, id_col, text_col).where("kept")
    kept = groups.select(F.concat_ws(":", F.col(id_col).cast("string"), "text_sha256").alias("__key"))
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(one_space(F.col(text_col)), 256))
    return docs.withColumn("__key", key).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
