"""Substring dedup by hashing lines, cut at sentence ends.

A unit is a line or, where a line has several sentences, each of them. Its words are
lower-cased and joined by one space, and the digests are grouped globally. The document with
the smallest id keeps the unit, there its first occurrence; all others are repeated. Every
repeated unit is removed; those that follow each other make one stretch, and the original
offsets of the stretches are kept. A caller can ask for stretches of more words only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graspmeter.llm.common import written

#: Words of a stretch that is removed, at least: no limit. A repeated passage often begins and ends
#: inside sentences of its document, so the whole units of a long passage can have few words.
#: Units of ``COUNTED`` words or more count for a limit: all.
LEAST_WORDS, COUNTED = 1, 1
#: A point or question mark between letters or digits ends no sentence (decimals, addresses, code).
UNIT = re.compile(r"[^\n.!?](?:[^\n.!?]|(?<=\w)[.?](?=\w))*[.!?]*")
WORD = re.compile(r"\w+")


def units_of(text: str | None) -> Iterator[tuple[int, int, int, int, bool]]:
    """``(digest, words, begin, end, again)`` of each unit with words; ``again``: met before in this text.

    Begin and end count code points of the original text.
    """
    seen: set[int] = set()
    for found in UNIT.finditer(text or ""):
        words = WORD.findall(found.group().lower())
        if words:
            digest = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
            yield digest, len(words), found.start(), found.end(), digest in seen
            seen.add(digest)


def text_units(docs: DataFrame) -> DataFrame:
    """The units of ``docs`` (id, text_hash, text), numbered in each text."""
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, text_hash long, unit int, digest long, words int, begin int, end int, again boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [list(units_of(text)) for text in batch["text"]]
            sizes = [len(units) for units in found]
            rows = [unit for units in found for unit in units]
            digest, words, begin, end, again = zip(*rows) if rows else ((),) * 5
            number = np.concatenate([np.arange(n) for n in sizes]) if rows else np.zeros(0)
            owner = batch[["id", "text_hash"]].loc[batch.index.repeat(sizes)].reset_index(drop=True)
            yield owner.assign(
                unit=number.astype(np.int32), digest=np.array(digest, np.uint64).view(np.int64), words=np.array(words, np.int32),
                begin=np.array(begin, np.int32), end=np.array(end, np.int32), again=np.array(again, bool),
            )

    return docs.mapInPandas(run, schema)


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stretches to remove: id, text_hash, begin, end (code points), words, units, first_id.

    ``first_id`` is the smallest id that keeps a unit of the stretch, the own id where a text
    repeats itself. Null and empty texts have no units. Rows with the same id count as one
    document; rows without id rank last. Other columns are not read, and an empty table gives
    an empty result.
    """
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    units = written(text_units(named), "units")
    single = units.where("not again")
    firsts = single.groupBy("digest", "words").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1 and first_id is not null").drop("n"), "firsts")
    columns = ["id", "text_hash", "unit", "words", "begin", "end", "first_id"]
    later = single.join(firsts, ["digest", "words"]).where(~F.col("id").eqNullSafe(F.col("first_id"))).select(columns)
    inside = units.where("again").withColumn("first_id", F.col("id")).select(columns)
    in_text = Window.partitionBy("id", "text_hash")
    stretch = F.col("unit") - F.row_number().over(in_text.orderBy("unit"))
    return (
        later.unionByName(inside)
        .dropDuplicates(["id", "text_hash", "unit"])
        .withColumn("stretch", stretch)
        .groupBy("id", "text_hash", "stretch")
        .agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").alias("words"),
            F.count(F.lit(1)).alias("units"), F.min("first_id").alias("first_id"),
        )
        .where(F.col("words") >= least_words)
        .drop("stretch")
        .withColumnRenamed("id", id_col)
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the stretches cut out of the text; ``removed_spans`` has their original offsets.

    A column of that name is replaced; null texts stay null, and rows with nothing to remove have no spans.
    """
    docs = docs.drop("removed_spans")
    span = F.struct("begin", "end")
    spans = repeated_spans(docs, least_words, id_col, text_col).groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"))
    spans = spans.agg(F.array_sort(F.collect_list(span)).alias("removed_spans"))
    text, cut = F.col(text_col), F.col("removed_spans")
    # What stays is the text before the first span, between two spans, and behind the last.
    kept = F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda i: F.substring(
            text,
            F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get(cut, i)["begin"], F.length(text)) - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)),
        ),
    )
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    joined = docs.join(spans, same, "left").drop("__id", "__hash")
    return joined.withColumn(text_col, F.when(cut.isNull(), text).otherwise(F.array_join(kept, "")))
