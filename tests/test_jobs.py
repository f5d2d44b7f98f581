"""The end-to-end jobs on small input."""

from __future__ import annotations

from pyspark.sql import functions as F

from graspmeter.operators import classify, grading
from graspmeter.plans import driver_tables as D
from graspmeter.plans import jobs
from graspmeter.sources import corpus

LOGIN = """import { q } from './db';
export async function login(user) {
  const row = await db.query("select " + user);
  return row;
}
class Session {}
"""


def test_scan_and_audit(spark, files, tmp_path):
    landed = corpus.land(files(login=LOGIN, note_py="x = 1\n"), str(tmp_path / "files"), partitions=2)
    tables = jobs.scan(landed, by=["repo"])
    assert [tuple(r) for r in tables.totals.collect()] == [("repo", 2, 1, 1)]
    assert {r.file_id: r.risk_level for r in tables.files.collect()} == {"login.ts": 6, "note_py.py": 1}
    assert [r.target for r in tables.edges.collect()] == ["./db"]
    assert sorted(r.kind for r in tables.symbols.collect()) == ["class", "function"]
    result = jobs.audit(landed)
    types = [r.type for r in result.findings.orderBy("pos").collect()]
    assert types == ["SQL_INJECTION_RISK", "MISSING_ERROR_HANDLING", "UNHANDLED_ASYNC", "UNCHECKED_PARAMETER"]
    assert result.questions.count() == 2 * len(types)
    assert [p.path_no for p in result.code_paths.orderBy("path_no").collect()] == [0, 3]


def test_risk_from_a_table_equals_risk_on_the_row(files):
    df = files(login=LOGIN, plain="const a = 1;")
    joined = classify.file_risk(df.drop("content"), classify.critical_paths(df))
    direct = classify.with_risk(df)
    cols = ["file_id", "risk_level", "critical_patterns"]
    assert sorted(joined.select(*cols).collect()) == sorted(direct.select(*cols).collect())


def test_report_is_saved_as_tables(spark, sf, tmp_path):
    answers = D.answers(spark, sf)
    rep = jobs.score_report(
        answers, D.questions(spark, sf), D.sessions(spark, sf), D.critical_paths(spark, sf), grading.session_scores(answers),
        F.lit("2024-01-01").cast("timestamp"),
    )
    rep.save(str(tmp_path / "report"))
    saved = spark.read.parquet(str(tmp_path / "report" / "danger_zones"))
    assert saved.count() == rep.danger_zones.count() == 4
    assert spark.read.parquet(str(tmp_path / "report" / "overall")).head().overall_score > 0
