"""Import graph between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K


def _relative_imports(wide: bool) -> Column:
    pattern = K.WIDE_IMPORT if wide else K.IMPORT
    targets = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(targets, lambda t: t.startswith(".")))


def dependency_nodes(files: DataFrame, wide: bool = False) -> DataFrame:
    """Files with at least one relative import, with the distinct targets in order.

    The default pattern misses ``require('./x')`` and ``import type {..}``, as the results to
    match do; ``wide`` takes those too.
    """
    return (
        files.select("file_id", "relative_path", _relative_imports(wide).alias("calls"))
        .where(F.size("calls") > 0)
        .select(
            "file_id",
            F.col("relative_path").alias("file"),
            F.array().cast("array<string>").alias("called_by"),
            "calls",
            F.lit(0).alias("risk_level"),
        )
    )


def import_edges(files: DataFrame, wide: bool = False) -> DataFrame:
    """One row per file and distinct relative import."""
    return files.select(
        "file_id", F.col("relative_path").alias("src"), F.explode(_relative_imports(wide)).alias("target")
    )


def resolve(src: Column, target: Column) -> Column:
    """Path a relative import points to, without extension: ``a/b.ts`` + ``../c`` -> ``c``."""
    folder = F.filter(F.split(F.regexp_replace(src, r"[^/]*\z", ""), "/"), lambda p: p != "")
    path = F.aggregate(
        F.split(target, "/"),
        folder,
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.regexp_replace(F.array_join(path, "/"), r"\.(?:tsx?|jsx?|py)\z", "")


def in_degree(edges: DataFrame) -> DataFrame:
    """How many files import each resolved target (counted on the map side first)."""
    return (
        edges.withColumn("module", resolve(F.col("src"), F.col("target")))
        .groupBy("module")
        .agg(F.count_distinct("src").alias("imported_by"))
    )
