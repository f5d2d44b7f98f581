"""The three end-to-end jobs: scan a corpus, build questions, report scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter.operators import (
    classify,
    code_functions,
    detectors,
    imports,
    metrics,
    paths,
    questions,
    report,
    scoring,
)
from graspmeter.session import materialize


@dataclass
class Scan:
    """Tables of one corpus scan; each is lazy and reads the landed ``files`` once."""

    files: DataFrame
    critical: DataFrame
    symbols: DataFrame
    edges: DataFrame
    totals: DataFrame


def scan(files: DataFrame, by: list[str]) -> Scan:
    """Risk, complexity, symbols, imports and totals of ``files`` (per ``by``, e.g. repository)."""
    analyzed = metrics.file_metrics(classify.with_risk(files))
    return Scan(
        files=analyzed,
        critical=classify.critical_paths(files),
        symbols=metrics.symbols(files),
        edges=imports.import_edges(files),
        totals=metrics.totals(files, by),
    )


@dataclass
class Audit:
    functions: DataFrame
    findings: DataFrame
    code_paths: DataFrame
    questions: DataFrame


def audit(files: DataFrame, seed: int = 0) -> Audit:
    """Functions, findings, code paths and the whole question bank of a corpus."""
    funcs = code_functions.functions(detectors.with_secrets(files))
    findings = detectors.detect_all(funcs)
    return Audit(
        functions=funcs,
        findings=detectors.describe(findings),
        code_paths=paths.trace_paths(funcs),
        questions=questions.render_questions(questions.first_per_rule(findings), seed=seed),
    )


@dataclass
class Report:
    overall: DataFrame
    file_scores: DataFrame
    category_scores: DataFrame
    danger_zones: DataFrame
    timeline: DataFrame
    trend: DataFrame

    def save(self, base: str) -> None:
        for name, df in vars(self).items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")


def score_report(
    answers: DataFrame,
    question_table: DataFrame,
    sessions: DataFrame,
    critical: DataFrame,
    session_scores: DataFrame,
    updated_at: Column | None = None,
) -> Report:
    facts = scoring.answer_facts(answers, question_table)
    # One row per file, read by three of the tables below.
    scores = materialize(scoring.file_scores(facts, critical, updated_at), "file_scores")
    timeline = report.progress_timeline(sessions, session_scores)
    return Report(
        overall=scoring.overall_score(scores),
        file_scores=scores,
        category_scores=scoring.category_scores(facts),
        danger_zones=scoring.danger_zones(critical, scores),
        timeline=timeline,
        trend=report.trend(timeline),
    )


def one_table_report(rep: Report) -> DataFrame:
    """The report as one long table: part, key and value."""
    def part(name: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    return (
        part("overall", rep.overall, F.lit("all"), F.col("overall_score"))
        .unionByName(part("file", rep.file_scores, F.col("file"), F.col("score")))
        .unionByName(part("category", rep.category_scores, F.col("category"), F.col("score")))
        .unionByName(part("danger", rep.danger_zones, F.col("relative_path"), F.col("danger_score")))
    )
