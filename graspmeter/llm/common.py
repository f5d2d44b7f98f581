"""Small helpers that the operators share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graspmeter.session import configure, work_dir

#: The white space of the contracts: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Documents are large, so Arrow batches hold fewer of them than Spark's default.
BATCH_ROWS = "512"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with UTC, adaptive execution and small Arrow batches.

    Python workers look for the package where the driver has it, unless told otherwise; a
    cluster without that folder gets the package with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors.

    Compressed with zstd, as the default codec's writers leave buffers outside the heap until a
    collection, which adds up where many small files are written.
    """
    folder = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of all documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def row_key(id_col: str, text_col: str) -> Column:
    """What a stage knows a row by: its id and text, those without id behind all others.

    Rows that share an id are told apart by their texts, and rows without id too; rows that
    share both are judged alike by every operator.
    """
    return F.struct(F.isnull(id_col).alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def one_space(text: Column) -> Column:
    """``text`` with each run of white space as one space; null counts as empty.

    A single space is left alone, which gives the same text with far fewer replacements.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def word_count(text: Column) -> Column:
    """Number of words, that is of runs without white space; null counts as empty."""
    trimmed = F.trim(one_space(text))
    spaces = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(spaces + 1).cast("long")
