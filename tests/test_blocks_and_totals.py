"""Nested Python blocks, pruned scans, the team matrix, totals by level and learning paths by user."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from graspmeter.operators import code_functions as fn
from graspmeter.operators import metrics, report
from graspmeter.operators.py_blocks import indent_width, nested_blocks
from graspmeter.sources import corpus

HEAD = re.compile(r"[ \t]*(async[ \t]+def|def|class)[ \t]+(\w+)")


def brute_blocks(text):
    """A stack of open blocks, line by line."""
    lines, stack, found = text.split("\n"), [], []

    def close(indent, at):
        while stack and stack[-1]["indent"] >= indent:
            stack.pop()["end"] = at - 1

    for at, line in enumerate(lines):
        body = line.strip()
        if not body or body[0] in ")]}":
            continue
        blanks = line[: len(line) - len(line.lstrip(" \t"))]
        indent = len(blanks.expandtabs(8))
        close(indent, at)
        if m := HEAD.match(line):
            parent = stack[-1] if stack else None
            block = {"kind": re.sub(r"[ \t]+", " ", m[1]), "name": m[2], "start": at, "indent": indent, "depth": len(stack), "parent": parent and parent["start"]}
            stack.append(block)
            found.append(block)
    close(-1, len(lines))
    return [(b["kind"], b["name"], b["start"], b["end"], b["indent"], b["depth"], b["parent"]) for b in found]


def test_blocks_equal_a_stack(files):
    pick = random.Random(3)
    heads = ["def f():", "async  def g(a,", "class C:", "x = 1", "@decorated", "", "   ", "\t", "# note", ")", "if x:", "definition = 2", "return def_"]
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(pick.randrange(40)):
            blanks = pick.choice(["", "  ", "    ", "      ", "\t", "\t\t", "  \t", "\t  ", " " * 9])
            lines.append(blanks + pick.choice(heads))
        texts[f"t{i}_py"] = "\n".join(lines)
    texts |= {"empty_py": "", "script": "def f():\n  pass"}
    got = {}
    for r in nested_blocks(files(**texts)).collect():
        got.setdefault(r.file_id, []).append((r.kind, r.name, r.start_line, r.end_line, r.indent, r.depth, r.parent_line))
    for name, text in texts.items():
        assert sorted(got.pop(f"{name}.py", []), key=str) == sorted(brute_blocks(text) if name.endswith("_py") else [], key=str), text
    assert not got


def test_outermost_blocks_equal_the_functions_at_column_0(files):
    text = "import x\ndef a(p, q):\n    if p:\n\n        return q\n\nasync def b():\n\treturn 1\nz = 1\ndef c(): pass\n\n"
    frame = files(m_py=text)
    want = fn.function_spans(frame).select("name", "start_line", "end_line").collect()
    got = nested_blocks(frame).where("depth = 0").select("name", "start_line", "end_line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_indents(spark):
    lines = ["x", "  x", "\tx", "   \tx", "\t  x", "        \tx", " \t \tx", ""]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    got = {r.line: r.n for r in frame.select("line", indent_width(F.col("line")).alias("n")).collect()}
    assert got == {line: len(line[: len(line) - len(line.lstrip())].expandtabs(8)) for line in lines}


def test_skipped_folders_are_neither_listed_nor_read(spark, tmp_path):
    for path in ("src/a.ts", "src/deep/b.PY", "src/node_modules/x/bad.ts", ".git/c.js", "dist/d.js", "lib/[e]{1}*.tsx", "lib/f.md", "lib/.hidden.ts", "lib/x y/g.jsx"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    (tmp_path / "lib" / "broken.ts").write_bytes(b"\xff\xfe{")
    # A folder that can't be listed: whoever follows it runs in a circle.
    (tmp_path / "src" / "node_modules" / "loop").symlink_to(tmp_path / "src" / "node_modules")
    files, listed = corpus.list_tree(spark, str(tmp_path))
    assert not any("node_modules" in f or ".git" in f or "dist" in f for f in listed) and len(listed) == 5
    assert all(length > 0 for _, length in files)
    got = corpus.scan_corpus(spark, str(tmp_path))
    rows = {r.relative_path: r.content for r in got.collect()}
    assert rows.keys() == {"src/a.ts", "src/deep/b.PY", "lib/[e]{1}*.tsx", "lib/x y/g.jsx", "lib/broken.ts"}
    assert rows["lib/[e]{1}*.tsx"] == "lib/[e]{1}*.tsx" and rows["lib/broken.ts"] == "\ufffd\ufffd{"
    assert not any("node_modules" in f for f in got.inputFiles())
    assert corpus.scan_corpus(spark, str(tmp_path / "dist")).count() == 1
    assert corpus.scan_corpus(spark, str(tmp_path / "none")).count() == 0


EXPORTS = "export_id int, exported_by string, overall_score int, category_scores array<struct<category:string,score:int>>"


def test_team_matrix(spark):
    rows = [(1, "Ann", 50, [("auth", 80), ("db", 10)]), (2, None, 60, [("auth", 80)]), (3, "", 70, [("auth", 20), ("db", 90), ("db", 5)]), (4, "Bob", 5, []), (5, "Cy", 6, None), (6, "Di", 7, [("auth", None), ("auth", 85)])]
    exports = spark.createDataFrame(rows, EXPORTS)
    got = {r.export_id: r.asDict() for r in report.team_matrix(exports).collect()}
    assert list(got[1]) == ["export_id", "name", "overall_score", "auth_score", "auth_rank", "db_score", "db_rank"]
    auth = {i: (r["auth_score"], r["auth_rank"]) for i, r in got.items()}
    assert auth == {1: (80, 2), 2: (80, 2), 3: (20, 4), 4: (None, None), 5: (None, None), 6: (85, 1)}
    assert {i: r["db_rank"] for i, r in got.items()} == {1: 2, 2: None, 3: 1, 4: None, 5: None, 6: None}
    assert [got[i]["name"] for i in range(1, 7)] == ["Ann", "Teammate", "Teammate", "Bob", "Cy", "Di"]
    assert report.team_matrix(exports, ["db"]).columns == ["export_id", "name", "overall_score", "db_score", "db_rank"]
    assert report.team_matrix(exports.where("export_id in (4, 5)")).columns == ["export_id", "name", "overall_score"]
    with pytest.raises(ValueError):
        report.team_categories(exports, most=1)


def test_parts_merge_to_the_whole(spark):
    """Sums of daily parts are those of the whole; both sketches are within three deviations of the exact numbers."""
    names = "".join(f"function n{i}() {{}}\n" for i in range(50))
    rows = []
    for day in range(8):
        for k in range(25):
            text = names + "".join(f"function d{day * 10 + i}_{k}() {{}}\n" for i in range(20))
            rows.append((f"{day}/{k}", f"{day}/{k}", "typescript" if k % 2 else "javascript", f"r{k % 3}", day, text))
    rows.append(("none", "none", "python", None, 0, "x = 1"))
    files = spark.createDataFrame(rows, "file_id string, relative_path string, language string, repo string, day int, content string")
    by = ["repo", "language"]
    whole = metrics.rolled_up(metrics.rollup_parts(files, by), by)
    parts = [metrics.rollup_parts(files.where(F.col("day") == d), by) for d in range(8)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    exact = {(r.repo, r.language, r.level): r.names for r in metrics.distinct_names(files, by).collect()}
    found = []
    for rolled in (whole, metrics.rolled_up(merged, by)):
        rows = rolled.collect()
        for r in rows:
            names = exact.get((r.repo, r.language, r.level), 0)
            assert abs(r.about_names - names) <= 3 * 0.0163 * names + 1
        found.append(sorted(((r.repo, r.language, r.level, r.total_files, r.total_functions) for r in rows), key=str))
    one, many = found
    assert one == many and len(one) == 12
    assert next(r for r in one if r[2] == 2)[3] == 201


def test_learning_paths_by_user(spark):
    option = "array(named_struct('label','A','text','yes','is_correct',true), named_struct('label','B','text','no','is_correct',false))"
    questions = spark.range(40).selectExpr(
        "id question_id", "concat('f', id % 4, '.ts') file", "'data-flow' category", "cast(id as int) start_line", "cast(id + 5 as int) end_line",
        "concat('question ', id) question", "'because' explanation", "3 difficulty", f"{option} options",
    )
    wrong = spark.createDataFrame([(1, q, 100 - q, "B") for q in range(12)] + [(2, 7, 1, "B"), (2, 7, 2, "B")], "user_id long, question_id long, age long, selected_label string")
    wrong = wrong.join(questions.select("question_id", "file", "start_line"), "question_id")
    critical = spark.createDataFrame([("f0.ts", "auth", 9), ("f1.ts", "db", 8), ("f2.ts", "auth", 7), ("f9.ts", "db", 6)], "file string, category string, risk_level int")
    own = [(2, "f0.ts", 100), (2, "f1.ts", 40), (2, "f9.ts", 0), (4, "f0.ts", 50), (4, "f1.ts", 60), (4, "f2.ts", 41), (4, "f9.ts", 80)]
    own = spark.createDataFrame(own, "user_id long, file string, score int")
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 4)], "user_id long")
    got = {}
    for r in report.learning_paths(wrong, questions, critical, own, users, [F.col("age")]).orderBy("user_id", "priority").collect():
        got.setdefault(r.user_id, []).append((r.priority, r.file, r.start_line, r.why_it_matters.split("\n")[0]))
    assert [(p, line) for p, _, line, _ in got[1]] == [(i + 1, 11 - i) for i in range(10)]
    # Of one place the newest wrong answer counts once; then zones: no score of f2 (7.0) before 40 % of f1 (4.8).
    assert [(f, line) for _, f, line, _ in got[2]] == [("f3.ts", 7), ("f2.ts", 0), ("f1.ts", 0)]
    assert got[2][2][3] == "Risk level 8/5 — understanding score 40%"
    assert [f for _, f, _, _ in got[3]] == ["f0.ts", "f1.ts", "f2.ts"]
    # No wrong answers and no zones: the files of the lowest scores.
    assert [f for _, f, _, _ in got[4]] == ["f2.ts", "f0.ts", "f1.ts", "f9.ts"]
