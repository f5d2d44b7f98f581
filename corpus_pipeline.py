"""A corpus pipeline of the training-data operators: what a stage drops, later stages never see."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graspmeter.llm.common import prepared, table, written
from graspmeter.llm.decontam import drop_contaminated
from graspmeter.llm.exact_dedup import drop_copies
from graspmeter.llm.mixing import mix
from graspmeter.llm.quality import keep_good
from graspmeter.llm.simhash_dedup import drop_near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Every stage judges each row by its id and text, so rows without id and rows that share one are
# judged like all others. Null texts count as empty; an empty table gives an empty one; columns
# besides doc_id, text and source are carried along, whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier accepts; ties with the threshold stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest id, a row without id only where no other is."""
    prepared(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near texts: the smallest id, of several the one of the smallest text hash."""
    prepared(spark)
    return drop_near_copies(docs, size=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of the benchmark; without items all stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left; the last stage returns no texts."""
    prepared(spark)
    return mix(docs, weights=(3, 1, 2), share=1.5, repeats=2.0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: SQL expresses neither the classifier nor the hash of the fingerprints.
ORACLE_SQL = None
