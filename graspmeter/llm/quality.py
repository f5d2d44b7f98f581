"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graspmeter.llm.common import held_out, row_key, written
from graspmeter.llm.gbdt import Forest, train

#: Labelled documents that the trees learn from at most; a statistic each, no text, goes to the driver.
SAMPLE = 20_000
#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32),
    "line": (10,),
    "stop": (33, 46, 63),
    "comma": (44, 58, 59),
    "bar": (124,),
    "symbol": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126),
    "bang": (33,),
    "markup": (34, 39, 40, 41, 45, 47),
    "high": range(128, 256),
}
STATISTICS = [
    "bytes", "words", "word_length", *CLASSES, "distinct_words", "top_word", "repeated_next", "lines",
    "distinct_lines", "line_length", "capital_words", "short_words",
]
#: Bytes of text whose words are held at once.
PIECE = 1 << 20


def statistics(text: str | None) -> list[float]:
    """The statistics of one text in the order of ``STATISTICS``; all but logs are shares or means."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(256, np.int64)
    words: Counter[bytes] = Counter()
    number = repeated = 0
    last = None
    for start in range(0, len(raw), PIECE):
        piece = raw[start : start + PIECE]
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        found = piece.split()
        words.update(found)
        number += len(found)
        if found:
            repeated += sum(map(bytes.__eq__, found, found[1:])) + (found[0] == last)
            last = found[-1]
    lines = [line for line in raw.split(b"\n") if line.strip()]
    size, many, rows = max(1, len(raw)), max(1, number), max(1, len(lines))
    letters = sum(len(w) * n for w, n in words.items())
    capital = sum(n for w, n in words.items() if 65 <= w[0] < 91)
    short = sum(n for w, n in words.items() if len(w) <= 3)
    return [
        np.log1p(len(raw)), np.log1p(number), letters / many,
        *(float(counts[list(codes)].sum()) / size for codes in CLASSES.values()),
        len(words) / many, max(words.values(), default=0) / many, repeated / many, np.log1p(len(lines)),
        len(set(lines)) / rows, np.log1p(len(raw) / rows), capital / many, short / many,
    ]


def text_statistics(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select(F.col(id_col).alias("id"), udf(F.col(text_col)).alias("stats"), *more)


def fit(stats: DataFrame, labels: DataFrame, sample: int, label_col: str, id_col: str) -> Forest:
    """Trees from at most ``sample`` labelled documents that are not held out, chosen by hash."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id")
    )
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = stats.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("stats", "label")).alias("s"))
    frame = rows.select("id", "s.stats", "s.label").toPandas().sort_values("id")
    if not len(frame):
        return train(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return train(np.stack(frame["stats"].to_numpy()), frame["label"].to_numpy())


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``held_out, score, predicted`` of every row.

    The statistics of all whole texts are computed once and written; training reads those of a
    bounded sample. Null and empty texts are scored like any text, with statistics of zero;
    rows without id are scored but never learned from; repeated rows are scored each; labels
    that are null or without document are left out; without labels of both kinds the score is
    constant. Other columns are not read; an empty table gives an empty result.
    """
    stats = written(text_statistics(docs, id_col, text_col), "statistics")
    forest = stats.sparkSession.sparkContext.broadcast(fit(stats, labels, sample, label_col, id_col))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.stack(batch["stats"].to_numpy()) if len(batch) else np.zeros((0, len(STATISTICS)))
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": forest.value.score(rows)})

    kind = dict(stats.dtypes)["id"]
    found = stats.withColumn("held_out", held_out("id")).mapInPandas(scored, f"id {kind}, held_out boolean, score double")
    return found.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, by their own texts.

    Of rows that share an id each is judged, and so are rows without id; nulls, empty texts and
    empty tables are as in ``score_quality``. All columns stay as they are.
    """
    key = row_key(id_col, text_col).alias("key")
    found = text_statistics(docs.select(id_col, text_col, key), id_col, text_col, "key")
    stats = written(found, "statistics")
    forest = stats.sparkSession.sparkContext.broadcast(fit(stats, labels, SAMPLE, "quality", id_col))

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(forest.value.score(np.stack(batch.to_numpy())) if len(batch) else [], dtype=float)

    rejected = stats.where(score("stats") < threshold).select(F.col("key").alias("__key")).distinct()
    return docs.join(rejected, row_key(id_col, text_col) == F.col("__key"), "left_anti")
