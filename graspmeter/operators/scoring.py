"""Understanding scores per file, category and overall, and danger zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.scores import n_right, percent
from graspmeter.functions.text import half_up


def answer_facts(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with file and category of their question; unmatched answers are dropped.

    Questions that carry a session are matched within it.
    """
    keys = ["question_id"] + (["session_id"] if "session_id" in questions.columns else [])
    return answers.join(questions.select(*keys, "file", "category"), keys)


def _names(critical: DataFrame) -> DataFrame:
    """Risky files once per name they may be called by; the relative one comes first.

    An equi-join on the name replaces an OR of two conditions, which would be a nested loop.
    """
    both = F.array_distinct(F.array("file", "abs_file"))
    return critical.select("*", F.posexplode(both).alias("name_no", "name"))


def file_scores(facts: DataFrame, critical: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Score, number of answers and risk (1 if not risky) per file.

    ``critical(file, abs_file, risk_level)``: a question may name its file either way. The
    counts are aggregated before the join, so it only sees one row per file.
    """
    counts = facts.groupBy("file").agg(n_right().alias("correct"), F.count("*").alias("question_count"))
    names = _names(critical).select(
        F.col("name").alias("file"),
        F.col("risk_level").alias("risk"),
        F.when(F.col("name_no") == 1, F.col("file")).alias("rel"),
    )
    out = counts.join(names, "file", "left").select(
        "file",
        F.coalesce("rel", "file").alias("relative_path"),
        percent(F.col("correct"), F.col("question_count")).alias("score"),
        "question_count",
        F.coalesce("risk", F.lit(1)).alias("risk_level"),
    )
    return out if updated_at is None else out.withColumn("last_updated", updated_at)


def category_scores(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(
        percent(n_right(), F.count("*")).alias("score"), F.count("*").alias("question_count")
    )


def overall_score(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the rounded file scores; risky files count three times."""
    weight = F.when(F.col("risk_level") >= K.DANGER_RISK, K.CRITICAL_WEIGHT).otherwise(1)
    total, weights = F.sum(F.col("score") * weight), F.sum(weight)
    return scores.groupBy(*(by or [])).agg(
        F.coalesce(half_up(total / weights), F.lit(0)).alias("overall_score"),
        F.count("*").alias("n_files"),
    )


def danger_zones(critical: DataFrame, scores: DataFrame) -> DataFrame:
    """Risky files that are little understood; a file without a score counts as 0.

    ``critical(file, abs_file, category, risk_level)``.
    """
    risky = critical.where(F.col("risk_level") >= K.DANGER_RISK)
    known = scores.select(F.col("file").alias("name"), "score")
    joined = (
        _names(risky)
        .join(known, "name", "left")
        .groupBy("file", "abs_file", "category", "risk_level")
        .agg(F.min_by("score", F.when(F.col("score").isNotNull(), F.col("name_no"))).alias("score"))
    )
    return (
        joined.withColumn("understanding_score", F.coalesce("score", F.lit(0)))
        .where(F.col("understanding_score") <= K.DANGER_SCORE)
        .withColumn("danger_score", F.col("risk_level") * (1 - F.col("understanding_score") / 100))
        .select(
            F.col("abs_file").alias("file"),
            F.col("file").alias("relative_path"),
            "category",
            "risk_level",
            "understanding_score",
            "danger_score",
            F.lit(0).alias("start_line"),
            F.lit(0).alias("end_line"),
        )
    )


def ranked_zones(zones: DataFrame) -> DataFrame:
    return zones.orderBy(F.desc("danger_score"), "relative_path")
