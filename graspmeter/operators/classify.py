"""Risk classes of files: which risk words a file contains and how risky that makes it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import half_up, let, once


def _words(category: str, content: Column, name: Column, path: Column) -> Column:
    found = F.filter(
        F.array(*[F.lit(w) for w in K.CATEGORY_WORDS[category]]),
        lambda w: content.contains(w) | name.contains(w),
    )
    if category != "api-route":
        return found
    return F.concat(found, route_dirs(path))


def route_dirs(path: Column) -> Column:
    """``dir:x`` for every route directory among the path's segments."""
    dirs = F.array(*[F.lit(d) for d in K.ROUTE_DIRS])
    hit = F.array_intersect(dirs, F.split(F.lower(path), "/"))
    return F.transform(hit, lambda d: F.concat(F.lit("dir:"), d))


def _on_lowered(build) -> Column:
    """Lower-case content once per file."""
    name = F.lower(F.substring_index("relative_path", "/", -1))
    return let(F.lower("content"), lambda content: build(content, name, F.col("relative_path")))


def _all_categories() -> Column:
    return _on_lowered(
        lambda c, n, p: F.filter(
            F.array(
                *[
                    F.struct(F.lit(i).alias("rank"), F.lit(cat).alias("category"), _words(cat, c, n, p).alias("words"))
                    for i, cat in enumerate(K.CATEGORY_WORDS)
                ]
            ),
            lambda x: F.size(x["words"]) > 0,
        )
    )


def _first_category() -> Column:
    """First category with a word; the later ones are not looked at."""
    def attempt(category: str, words: Column) -> Column:
        return F.when(F.size(words) > 0, F.struct(F.lit(category).alias("category"), words.alias("words")))

    def build(c: Column, n: Column, p: Column) -> Column:
        tries = [
            let(_words(cat, c, n, p), partial(attempt, cat)) for cat in K.CATEGORY_WORDS
        ]
        return F.coalesce(*tries)

    return _on_lowered(build)


_ALL = once(_all_categories)
_FIRST = once(_first_category)


def keyword_matches(files: DataFrame) -> DataFrame:
    """All risk words per file and category."""
    return files.select("file_id", "relative_path", F.explode(_ALL()).alias("m")).select(
        "file_id", "relative_path", "m.rank", "m.category", F.col("m.words").alias("matched")
    )


def risk_level(n_matches: Column) -> Column:
    return half_up(F.least(F.lit(10.0), 3 + 1.5 * n_matches))


def with_risk(files: DataFrame) -> DataFrame:
    """Add category, risk level (1 without a match) and matched words to every file."""
    return files.withColumn("m", _FIRST()).withColumns(
        {
            "category": F.col("m.category"),
            "risk_level": F.when(F.col("m").isNull(), 1).otherwise(risk_level(F.size("m.words"))),
            "critical_patterns": F.coalesce("m.words", F.array().cast("array<string>")),
        }
    ).drop("m")


def critical_paths(files: DataFrame) -> DataFrame:
    """Files with a risk category: at most one row per file."""
    return with_risk(files).where(F.col("category").isNotNull()).select(
        "file_id",
        "relative_path",
        "category",
        "risk_level",
        F.col("critical_patterns").alias("matched_patterns"),
        F.lit(0).alias("start_line"),
        F.lit(0).alias("end_line"),
    )


def file_risk(files: DataFrame, critical: DataFrame) -> DataFrame:
    """Risk of every file from a separate table of critical paths; 1 and no words by default."""
    found = critical.select("file_id", "risk_level", F.col("matched_patterns").alias("critical_patterns"))
    return files.join(found, "file_id", "left").withColumns(
        {
            "risk_level": F.coalesce("risk_level", F.lit(1)),
            "critical_patterns": F.coalesce("critical_patterns", F.array().cast("array<string>")),
        }
    )
