"""Grading, adaptive difficulty, scores, reports and replies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graspmeter.operators import chunks, grading, report, scoring


def plain_level(oks, level=3):
    right = wrong = 0
    for ok in oks:
        right, wrong = (right + 1, 0) if ok else (0, wrong + 1)
        if right == 3:
            level, right = min(5, level + 1), 0
        if wrong == 2:
            level, wrong = max(1, level - 1), 0
    return level, right, wrong


def test_adaptive_difficulty_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.random() < 0.6) for i in range(5000)]
    rows += [(f"k{i % 40}", i, rng.random() < 0.5) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, n int, is_correct boolean")
    tables = {r.key: len(r.tables) for r in grading.run_tables(df, "key", ["n"], 8).collect()}
    assert tables["hot"] > 3, "the hot key has to be folded in several runs"
    by_key: dict[str, list[tuple[int, bool]]] = {}
    for k, n, ok in rows:
        by_key.setdefault(k, []).append((n, ok))
    want = {k: plain_level([ok for _, ok in sorted(v)]) for k, v in by_key.items()}
    for parts in (1, 3, 8):
        got = grading.adaptive_difficulty(df, "key", ["n"], partitions=parts).collect()
        assert {r.key: (r.level, r.right_streak, r.wrong_streak) for r in got} == want


def test_start_level_is_kept_in_range(spark):
    df = spark.createDataFrame([(0,), (1,), (9,), (-2,)], "n int")
    assert [r[0] for r in df.select(grading.start_level(F.col("n"))).collect()] == [3, 1, 5, 3]


@pytest.mark.parametrize(
    ("right", "total", "want"), [(1, 3, 33), (2, 3, 67), (1, 200, 1), (1, 8, 13), (0, 5, 0), (5, 5, 100)]
)
def test_percent_is_rounded_half_up(spark, right, total, want):
    rows = [("s", i < right) for i in range(total)]
    df = spark.createDataFrame(rows, "session_id string, is_correct boolean")
    assert grading.session_scores(df).head().score == want


def test_scores_and_zones_by_either_name(spark):
    critical = spark.createDataFrame(
        [("a.ts", "/w/a.ts", "auth", 9), ("b.ts", "/w/b.ts", "auth", 7), ("c.ts", "/w/c.ts", "auth", 6), ("d.ts", "/w/d.ts", "auth", 8)],
        "file string, abs_file string, category string, risk_level int",
    )
    facts = spark.createDataFrame(
        [("/w/a.ts", False, "x"), ("/w/a.ts", True, "x"), ("/w/a.ts", False, "y"), ("b.ts", True, "x"), ("z.ts", False, "y")],
        "file string, is_correct boolean, category string",
    )
    scores = scoring.file_scores(facts, critical)
    got = {r.file: (r.relative_path, r.score, r.risk_level) for r in scores.collect()}
    assert got == {"/w/a.ts": ("a.ts", 33, 9), "b.ts": ("b.ts", 100, 7), "z.ts": ("z.ts", 0, 1)}
    # (33*3 + 100*3 + 0) / 7
    assert scoring.overall_score(scores).head().overall_score == 57
    zones = scoring.ranked_zones(scoring.danger_zones(critical, scores)).collect()
    assert [(z.relative_path, z.understanding_score) for z in zones] == [("d.ts", 0), ("a.ts", 33)]


def test_trend_needs_two_sessions_and_ten_points(spark):
    rows = [("up", 1, 10), ("up", 2, 90), ("up", 3, 40), ("up", 4, 50), ("down", 1, 50), ("down", 2, 40), ("one", 1, 5), ("flat", 1, 50), ("flat", 2, 59)]
    df = spark.createDataFrame([(u, n, n, s) for u, n, s in rows], "user_id string, session_id int, end_ts int, score int")
    want = {"up": "declining", "down": "declining", "one": "stable", "flat": "stable"}
    for seed in (1, 2):
        got = report.trend(df.orderBy(F.rand(seed)))
        assert {r.user_id: r.trend for r in got.collect()} == want


def test_session_numbers(spark):
    rows = [("u", f"s{i:02d}", f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, t string").withColumn("start_ts", F.to_timestamp("t"))
    got = {r.session_id: r.session_no for r in report.session_numbers(df).collect()}
    assert got == {f"s{i:02d}": i + 1 for i in range(12)}


def test_learning_path_branches(spark):
    wrong = spark.createDataFrame(
        [(i, "B", "a.ts", i % 3, i) for i in range(9)],
        "question_id int, selected_label string, file string, start_line int, age int",
    )
    asked = spark.createDataFrame(
        [(i, "a.ts", i % 3, 9, "data-flow", "why?" * 30, f"x{i}") for i in range(9)],
        "question_id int, file string, start_line int, end_line int, category string, question string, explanation string",
    ).withColumn(
        "options",
        F.expr("array(named_struct('label', 'A', 'text', 'good', 'is_correct', true), named_struct('label', 'B', 'text', 'bad', 'is_correct', false))"),
    )
    zones = spark.createDataFrame(
        [(f"/w/{i}", f"{i}", "auth", 9, 0, 9.0 - i, 0, 0) for i in range(9)],
        "file string, relative_path string, category string, risk_level int, understanding_score int, danger_score double, start_line int, end_line int",
    )
    scores = spark.createDataFrame([("q", "q", 90), ("p", "p", 10)], "file string, relative_path string, score int")
    order = [F.col("age")]
    full = report.learning_path(wrong, asked, zones, scores, order).orderBy("priority").collect()
    assert len(full) == 10
    assert [(r.file, r.why_it_matters) for r in full[:3]] == [
        ("a.ts", f'Incorrect. The correct answer was: "good"\n\nx{i}') for i in range(3)
    ]
    assert full[0].concept == "data flow — " + ("why?" * 30)[:60] + "…"
    assert full[3].why_it_matters == "Risk level 9/5 — understanding score 0%"
    nothing = report.learning_path(wrong.limit(0), asked, zones.limit(0), scores, order).orderBy("priority").collect()
    assert [(r.file, r.concept) for r in nothing] == [("p", "Review: p (10% understood)"), ("q", "Review: q (90% understood)")]


def test_replies_are_split_into_good_and_rejected(spark):
    good = '```json\n{"questions": [{"id": "1", "question": "q", "options": [{"label": "A", "text": "x", "isCorrect": true}]}]}\n```'
    two = good.replace("}]}]}", '}, {"label": "B", "text": "y", "isCorrect": true}]}]}')
    rows = [("good", good), ("two", two), ("text", "sorry"), ("list", '{"items": []}'), ("noid", good.replace('"1"', '""'))]
    replies = spark.createDataFrame(rows, "reply_id string, reply string")
    ok, bad = chunks.parse_questions(replies)
    assert [(r.reply_id, r.id) for r in ok.collect()] == [("good", "1")]
    assert {r.reply_id: r.reason for r in bad.collect()} == {
        "two": "invalid question", "text": "not valid JSON", "list": 'missing "questions" list', "noid": "invalid question",
    }


def test_misconceptions_in_order(spark):
    texts = {
        "Express will catch it automatically": "Express does NOT", "TypeScript prevents it": "TypeScript types", "It retries": "do NOT retry",
        "a global handler": "Global error handlers", "returns null": "safe values", "the .gitignore": ".gitignore only", "else": "Review the code at f:3 ",
    }
    df = spark.createDataFrame([(t, "f", 2) for t in texts], "t string, file string, start_line int")
    got = df.select("t", grading.misconception(F.col("t")).alias("m")).collect()
    for r in got:
        assert texts[r.t] in r.m


def test_code_context_is_clamped(spark):
    df = spark.createDataFrame([("\n".join(str(i) for i in range(1, 21)), 1, 2), ("1\n2\n3", 3, 3)], "c string, a int, b int")
    got = [r[0].split("\n") for r in df.select(chunks.code_with_context(F.col("c"), F.col("a"), F.col("b"))).collect()]
    assert got == [[str(i) for i in range(1, 8)], ["1", "2", "3"]]


def test_long_runs_are_cut_and_compose(spark, monkeypatch):
    rows = [("hot", i, i % 7 not in (2, 3, 5)) for i in range(500)] + [("cold", 1, True)]
    log = spark.createDataFrame(rows, "user_id string, nth int, is_correct boolean")
    whole = sorted(map(str, grading.adaptive_difficulty(log, "user_id", ["nth"], partitions=3).collect()))
    monkeypatch.setattr(grading, "RUN_ROWS", 16)
    tables = grading.run_tables(log, "user_id", ["nth"], partitions=3)
    assert tables.where("user_id = 'hot'").head().answered == 500
    assert len(tables.where("user_id = 'hot'").head().tables) >= 500 // 16
    assert sorted(map(str, grading.adaptive_difficulty(log, "user_id", ["nth"], partitions=3).collect())) == whole
