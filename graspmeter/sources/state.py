"""Saved state as Parquet tables: sessions, shown questions, pinned files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["initialized", "analysis", "sessions", "report", "pinned_files", "shown_questions"]


def upsert(current: DataFrame, changes: DataFrame, key: str, version: Column) -> DataFrame:
    """Newest row per key of both tables; ``changes`` wins a tie of versions.

    An aggregation (partial on the map side) and not a window, so a hot key does not hurt.
    """
    cols = [c for c in current.columns if c != key]

    def ranked(df: DataFrame, source: int) -> DataFrame:
        return df.select(
            key, F.struct(version.alias("v"), F.lit(source).alias("s"), *cols).alias("row")
        )

    both = ranked(current, 0).unionByName(ranked(changes, 1))
    return (
        both.groupBy(key)
        .agg(F.max_by("row", F.struct("row.v", "row.s")).alias("row"))
        .select(key, *[F.col(f"row.{c}").alias(c) for c in cols])
    )


def mark_shown(shown: DataFrame, question_ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Set union of the ids already shown and new ones, of all or for each value of ``by`` (``["user_id"]``)."""
    columns = [*(by or []), "question_id"]
    return shown.select(columns).union(question_ids.select(columns)).distinct()


def pin(pinned: DataFrame, files: DataFrame) -> DataFrame:
    """Add the files that are not pinned yet."""
    new = files.dropDuplicates(["file"]).join(pinned, "file", "left_anti")
    return pinned.unionByName(new.select(*pinned.columns))


def unpin(pinned: DataFrame, files: DataFrame) -> DataFrame:
    return pinned.join(files, "file", "left_anti")


def save(df: DataFrame, base: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{name}")


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


def reset(df: DataFrame) -> DataFrame:
    """The empty table of the same schema."""
    return df.where(F.lit(False))


def reset_all(spark: SparkSession, base: str, names: list[str] | None = None) -> None:
    """Overwrite saved tables with empty ones; tables that were never saved are left alone."""
    for name in names or TABLES:
        try:
            schema = load(spark, base, name).schema
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        save(spark.createDataFrame([], schema), base, name)
