"""Score arithmetic shared by grading, scoring and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graspmeter.functions.text import half_up


def percent(correct: Column, total: Column) -> Column:
    """Share of right answers in whole percent, half up; 0 without answers."""
    return F.when(total > 0, half_up(correct / total * 100)).otherwise(F.lit(0))


def n_right(flag: str = "is_correct") -> Column:
    return F.count_if(F.col(flag))


def band(score: Column, bands: list[tuple[int, str]]) -> Column:
    """Label of the first band whose lower bound the score reaches."""
    return F.coalesce(*[F.when(score >= low, F.lit(label)) for low, label in bands])
