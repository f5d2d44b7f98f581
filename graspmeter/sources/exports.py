"""Team score documents: one JSON document per owner out, many documents in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_SCHEMA = (
    "exportedBy string, exportedAt bigint, overallScore int, "
    "fileScores array<struct<file: string, relativePath: string, score: int, questionCount: bigint, "
    "riskLevel: int, lastUpdated: bigint>>, "
    "categoryScores array<struct<category: string, score: int, questionCount: bigint>>, "
    "sessionCount bigint"
)


def team_exports(
    overall: DataFrame, file_scores: DataFrame, category_scores: DataFrame, exported_at: int
) -> DataFrame:
    """One document per owner as a JSON text; owners without an overall score give none.

    ``overall(exported_by, overall_score, session_count)``; the score tables carry
    ``exported_by``. A document holds the files of one project, so its size is bounded by it.
    """
    files = file_scores.groupBy("exported_by").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "file",
                    F.col("relative_path").alias("relativePath"),
                    "score",
                    F.col("question_count").alias("questionCount"),
                    F.col("risk_level").alias("riskLevel"),
                    F.lit(exported_at).cast("bigint").alias("lastUpdated"),
                )
            )
        ).alias("fileScores")
    )
    categories = category_scores.groupBy("exported_by").agg(
        F.array_sort(
            F.collect_list(
                F.struct("category", "score", F.col("question_count").alias("questionCount"))
            )
        ).alias("categoryScores")
    )
    doc = F.struct(
        F.col("exported_by").alias("exportedBy"),
        F.lit(exported_at).cast("bigint").alias("exportedAt"),
        F.col("overall_score").cast("int").alias("overallScore"),
        F.coalesce("fileScores", F.array().cast("array<struct<file:string,relativePath:string,score:int,questionCount:bigint,riskLevel:int,lastUpdated:bigint>>")).alias("fileScores"),
        F.coalesce("categoryScores", F.array().cast("array<struct<category:string,score:int,questionCount:bigint>>")).alias("categoryScores"),
        F.col("session_count").alias("sessionCount"),
    )
    return (
        overall.where(F.col("overall_score").isNotNull())
        .join(files, "exported_by", "left")
        .join(categories, "exported_by", "left")
        .select("exported_by", F.to_json(doc).alias("value"))
    )


def write_team_exports(exports: DataFrame, folder: str) -> None:
    exports.select("value").write.mode("overwrite").text(folder)


def parse_exports(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``documents(source, value)`` into parsed exports and rejected rows."""
    schema = EXPORT_SCHEMA + ", _corrupt_record string"
    parsed = documents.withColumn(
        "doc",
        F.from_json(
            "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        ),
    )
    broken = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    good = parsed.where(~broken).select(
        "source",
        F.col("doc.exportedBy").alias("exported_by"),
        F.col("doc.exportedAt").alias("exported_at"),
        F.col("doc.overallScore").alias("overall_score"),
        F.col("doc.sessionCount").alias("session_count"),
        F.col("doc.fileScores").alias("file_scores"),
        F.col("doc.categoryScores").alias("category_scores"),
    )
    return good, parsed.where(broken).select("source", "value")


def read_team_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read score files, one document each; broken ones come back in the second table."""
    docs = spark.read.option("wholetext", "true").text(path).select(
        F.input_file_name().alias("source"), "value"
    )
    return parse_exports(docs)
