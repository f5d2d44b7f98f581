"""Sources, file classes, metrics and the import graph."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graspmeter.operators import classify, imports, metrics
from graspmeter.sources import corpus, exports, manifests, state


def test_scan_corpus(spark, tmp_path):
    tree = {
        "src/a.ts": b"const x = 1;\n", "src/B.JSX": b"x", "lib/c.py": b"\xff\xfe bad\n\n", "node_modules/m/d.js": b"x",
        ".hidden/e.js": b"x", "docs/readme.md": b"x", "out/f.js": b"x", "out.js": b"\xef\xbb\xbfy",
    }
    for name, data in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {r.relative_path: r for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["lib/c.py", "out.js", "src/B.JSX", "src/a.ts"]
    assert got["src/a.ts"].line_count == 2 and got["lib/c.py"].line_count == 3
    assert got["lib/c.py"].content.startswith("\ufffd") and got["out.js"].content == "y"
    assert got["src/B.JSX"].language == "javascript"
    assert corpus.scan_corpus(spark, f"file:{tmp_path}", limit=2).count() == 2


def test_nesting_depth_equals_a_plain_count(spark):
    def depth(text: str) -> int:
        now = top = 0
        for ch in text:
            now = now + 1 if ch in "{(" else max(0, now - 1) if ch in "})" else now
            top = max(top, now)
        return top

    rng = random.Random(7)
    texts = ["".join(rng.choice("{}() a") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", metrics.nesting_depth(F.col("t"), "{(", "})").alias("d")).collect()
    assert [r.d for r in got] == [depth(r.t) for r in got]


def test_risk_and_first_category(files):
    df = files(login="const a = 1;", pay="stripe.charge()", plain="const b = 2;", routes="x").withColumn(
        "relative_path", F.when(F.col("file_id") == "routes.ts", "src/routes/index.ts").otherwise(F.col("relative_path"))
    )
    got = {r.file_id: (r.category, r.risk_level, r.critical_patterns) for r in classify.with_risk(df).collect()}
    assert got["login.ts"] == ("auth", 5, ["login"])
    assert got["pay.ts"] == ("payments", 6, ["stripe", "charge"])
    assert got["plain.ts"] == (None, 1, [])
    assert got["routes.ts"] == ("api-route", 5, ["dir:routes"])


def test_imports_and_resolution(files):
    src = "import { a } from './x';\nimport b from '../y/z';\nimport c from 'react';\nconst d = require('./q');\nimport './x';\n"
    df = files(m=src).withColumn("relative_path", F.lit("src/app/m.ts"))
    edges = imports.import_edges(df)
    assert [r.target for r in edges.collect()] == ["./x", "../y/z"]
    assert {r.target for r in imports.import_edges(df, wide=True).collect()} == {"./x", "../y/z", "./q"}
    assert {r.module for r in imports.in_degree(edges).collect()} == {"src/app/x", "src/y/z"}
    assert imports.dependency_nodes(files(n="const x = 1;")).count() == 0


def test_manifest_order_and_parse_error(spark):
    rows = [
        ("a", "package.json", '{"dependencies": {"react": "1", "next": "2"}, "devDependencies": {"jest": "1"}}'),
        ("a", "requirements.txt", "django"),
        ("b", "requirements.txt", "flask\nsqlalchemy"), ("b", "pyproject.toml", "django"),
        ("c", "package.json", "{"), ("d", "README.md", "x"), ("a", "tsconfig.json", "{}"),
    ]
    df = spark.createDataFrame(rows, "project string, file_name string, content string")
    got = {r.project: r for r in manifests.project_profiles(df).collect()}
    assert (got["a"].primary_language, got["a"].framework, got["a"].has_testing) == ("typescript", "Next.js", True)
    assert (got["b"].primary_language, got["b"].framework, got["b"].has_database) == ("python", "Flask", True)
    assert (got["c"].primary_language, got["c"].framework) == ("typescript", None)
    assert got["d"].primary_language == "unknown"


def test_export_round_trip_with_a_broken_file(spark, tmp_path):
    overall = spark.createDataFrame([("ann", 70, 3), ("bob", None, 0)], "exported_by string, overall_score int, session_count bigint")
    scores = spark.createDataFrame(
        [("ann", "f.ts", "f.ts", 70, 4, 7)],
        "exported_by string, file string, relative_path string, score int, question_count bigint, risk_level int",
    )
    categories = spark.createDataFrame([("ann", "auth", 70, 4)], "exported_by string, category string, score int, question_count bigint")
    docs = exports.team_exports(overall, scores, categories, 1000)
    exports.write_team_exports(docs, str(tmp_path / "team"))
    (tmp_path / "team" / "broken.txt").write_text("{not json")
    good, bad = exports.read_team_exports(spark, str(tmp_path / "team" / "*.txt"))
    rows = good.where("exported_by is not null").collect()
    assert [(r.exported_by, r.overall_score, r.category_scores[0].category) for r in rows] == [("ann", 70, "auth")]
    assert "{not json" in [r.value for r in bad.collect()]


def test_saved_state(spark, tmp_path):
    schema = "id int, score int, version int"
    current = spark.createDataFrame([(1, 10, 1), (2, 20, 5)], schema)
    changes = spark.createDataFrame([(1, 11, 2), (2, 21, 4), (3, 30, 1)], schema)
    merged = state.upsert(current, changes, "id", F.col("version"))
    assert sorted(tuple(r) for r in merged.select("id", "score").collect()) == [(1, 11), (2, 20), (3, 30)]
    state.save(merged, str(tmp_path), "sessions")
    state.reset_all(spark, str(tmp_path))
    assert state.load(spark, str(tmp_path), "sessions").count() == 0
    pinned = spark.createDataFrame([("a",)], "file string")
    more = state.pin(pinned, spark.createDataFrame([("a",), ("b",), ("b",)], "file string"))
    assert sorted(r.file for r in more.collect()) == ["a", "b"]
    assert [r.file for r in state.unpin(more, pinned).collect()] == ["b"]
