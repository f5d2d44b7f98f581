"""Importance resampling towards a target distribution of hashed word runs.

Each text is brought to words joined by one space and scanned once by running CRCs; the CRC of
any run of words follows from the registers at its two ends (``prefix_crc``). Runs fall into
buckets by their CRC. The counts of a bucket in the corpus and in the target give its gain, a
document's weight is its mean gain, and the documents of the highest weights plus Gumbel noise
are drawn, which is sampling without replacement in proportion to the exponential weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter.llm.common import written
from graspmeter.llm.prefix_crc import Running, crc_of_parts

#: Words of a run at most, and buckets of the runs.
LONGEST, BUCKETS = 2, 10_000
#: A-Z become a-z; of the other ASCII characters all but a-z and 0-9 separate words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes whose words are held at once, and bytes of words that are scanned at once.
PIECE, STREAM = 1 << 20, 1 << 22


def pieces(text: str | None, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """Lists of the words of a text, and how many words of the list ended the one before it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    start, last = 0, []
    while start < len(raw):
        end = start + PIECE
        while end < len(raw) and PLAIN[raw[end]] != 32:
            end += 1
        words = last + raw[start:end].translate(PLAIN).split()
        yield words, len(last)
        start, last = end, words[len(words) - min(len(words), longest - 1) :]


def runs(stream: list[bytes], counts: np.ndarray, carried: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and CRCs of all runs of up to ``longest`` words.

    ``stream`` has the words of texts one after the other, ``counts`` how many each has. Runs
    that end within the first ``carried`` words of a text were taken before.
    """
    lengths = np.fromiter(map(len, stream), np.int64, len(stream))
    ends = np.cumsum(lengths + 1) - 1
    running = Running(b" ".join(stream))
    before, after = running.at(ends - lengths), running.at(ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    new = np.arange(len(stream)) - np.repeat(np.cumsum(counts) - counts, counts) >= carried[owner]
    owners, crcs = [], []
    for more in range(min(longest, len(stream))):
        first = np.flatnonzero((owner[: len(owner) - more] == owner[more:]) & new[more:])
        last = first + more
        owners.append(owner[first])
        crcs.append(crc_of_parts(before[first], after[last], ends[last] - ends[first] + lengths[first]))
    return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(crcs or [np.zeros(0, np.uint32)])


def hashed_runs(texts: list[str | None], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and buckets of all runs of the texts, in parts of bounded size."""
    stream, rows, counts, carried, size = [], [], [], [], 0

    def settle() -> tuple[np.ndarray, np.ndarray]:
        owners, crcs = runs(stream, np.array(counts), np.array(carried), longest)
        return np.array(rows)[owners], (crcs % np.uint32(buckets)).astype(np.int64)

    for row, text in enumerate(texts):
        for words, again in pieces(text, longest):
            if not words:
                continue
            stream += words
            rows.append(row)
            counts.append(len(words))
            carried.append(again)
            size += sum(map(len, words))
            if size >= STREAM:
                yield settle()
                stream, rows, counts, carried, size = [], [], [], [], 0
    if stream:
        yield settle()


def word_counts(texts: list[str | None]) -> np.ndarray:
    return np.array([sum(len(words) - again for words, again in pieces(text, 1)) for text in texts], np.int64)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket; a partition sends one row a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in hashed_runs(list(batch["text"]), longest, buckets):
                counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": counts[at]})

    summed = texts.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most one row a bucket
        total[row.bucket] = row.n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the corpus, each count plus one."""
    ratio = (target + 1.0) * float(corpus.sum() + len(corpus)) / ((corpus + 1.0) * float(target.sum() + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``docs`` (text and others) with ``n_words, n_features, weight`` instead of the text."""
    gains = docs.sparkSession.sparkContext.broadcast(
        bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    )

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch)
            number, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for rows, found in hashed_runs(texts, longest, buckets):
                number += np.bincount(rows, minlength=len(texts))
                # Sums of integers below 2 ** 53 are exact in doubles.
                total += np.bincount(rows, gains.value[found], len(texts)).astype(np.int64)
            yield pd.DataFrame({"n_words": word_counts(texts), "n_features": number, "weight": total // np.maximum(number, 1)})

    others = [name for name in docs.columns if name != "text"]
    return docs.select(*others, weighed("text").alias("w")).select(*others, "w.*")


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """``scored`` with ``place``, its number from 1 in the given order, which must tell all rows apart.

    Rows are dealt out by ranges of the order, so no task gets more than its share whatever
    values they have; a range's rows are numbered where they are sorted and written, and only
    the sizes of the ranges, one row a partition, are summed up.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("part"), inside.alias("at")), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return dealt.join(F.broadcast(offsets), "part").withColumn("place", F.col("offset") + F.col("at") + 1).drop("part", "at", "offset")


def importance_ranks(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """``n_features, weight, score, rank`` of every row; rank is null for rows that are not drawn.

    Of the N rows of at least ``least_words`` words, ``floor(percent * N / 100)`` of the highest
    scores are drawn, of equal scores the smaller id. Null and empty texts have no features and
    weight 0. Rows without id have the noise of the empty id and follow the others; repeated
    rows have one score and consecutive ranks. An empty target leaves the gains to the corpus,
    an empty corpus gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    judged = weights(texts, target.select(F.col(target_text_col).alias("text")), longest, buckets)
    scored = written(
        judged.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scores"
    )
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = ranked(scored, [F.desc(fit), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")])
    rank = F.when(fit & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; ``options`` as for the ranks.

    Ids must tell the rows apart; of rows that share an id all are kept if one is drawn.
    """
    drawn = importance_ranks(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col(id_col).alias("__id"))
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
