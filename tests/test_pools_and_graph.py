"""Pools by user and the resolved import graph against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from graspmeter.operators import graph
from graspmeter.operators.pools import fresh_pools, missing_ranks, ranked_questions


def brute_missing(users, shown, last, n):
    found = []
    for user in {u for u in users if u is not None}:
        seen = {r for u, r in shown if u == user}
        left = [r for r in range(1, last + 1) if r not in seen]
        found += [(user, r, True) for r in left[:n]] or [(user, r, False) for r in range(1, min(n, last) + 1)]
    return sorted(found)


@pytest.mark.parametrize("block", [1, 3, 10, 4096])
@pytest.mark.parametrize("n", [1, 4, 25])
def test_missing_ranks(spark, block, n):
    pick = random.Random(block * 100 + n)
    last, users, shown = 23, [*range(30), None, 3], []
    for user in range(30):
        shown += [(user, r) for r in range(1, last + 1) if pick.random() < user / 25]
    # Repeated rows, ranks that do not exist, users that are not asked for.
    shown += [*shown[:5], (5, 0), (5, 99), (77, 1), (None, 2)]
    frame = spark.createDataFrame([(u,) for u in users], "user_id long")
    seen = spark.createDataFrame(shown, "user_id long, rank long")
    got = missing_ranks(frame, seen, last, n, block)
    assert sorted(map(tuple, got.collect())) == brute_missing(users, shown, last, n)
    assert not re.search("NestedLoop|Cartesian|Python", got._jdf.queryExecution().executedPlan().toString())


def test_a_user_with_very_many_shown(spark):
    """Of 100,000 questions all but two: only the blocks of the two are looked at."""
    shown = spark.range(1, 100_001).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("rank")).where("rank not in (50000, 99999)")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = sorted(map(tuple, missing_ranks(users, shown, 100_000, 3).collect()))
    assert got == [(1, 50000, True), (1, 99999, True), (2, 1, True), (2, 2, True), (2, 3, True)]


def test_pools_of_questions(spark):
    questions = spark.createDataFrame([(f"q{i}", i % 3) for i in range(10)], "question_id string, size int")
    users = spark.createDataFrame([("a",), ("b",), (None,)], "user_id string")
    shown = spark.createDataFrame([("a", "q2"), ("a", "q2"), ("a", "gone"), ("c", "q0")], "user_id string, question_id string")
    order = [F.desc("size"), F.asc("question_id")]
    ranked = ranked_questions(questions, order).orderBy("rank").collect()
    assert [(r.rank, r.question_id) for r in ranked[:4]] == [(1, "q2"), (2, "q5"), (3, "q8"), (4, "q1")]
    got = sorted(map(tuple, fresh_pools(questions, shown, users, 2, order).collect()))
    assert got == [("a", "q5", 2, True), ("a", "q8", 3, True), ("b", "q2", 1, True), ("b", "q5", 2, True)]
    everything = users.crossJoin(questions.select("question_id"))
    assert sorted(map(tuple, fresh_pools(questions, everything, users, 1, order).collect())) == [("a", "q2", 1, False), ("b", "q2", 1, False)]
    assert fresh_pools(questions.limit(0), shown, users, 2, order).count() == 0


TREE = {
    "src/a.ts": ["./b", "./c.js", "../lib", "./gone", "../../above", "react"],
    "src/b.ts": ["./a"],
    "src/b/index.ts": [],
    "src/c.js": ["./b/"],
    "lib/index.tsx": ["./deep/x"],
    "lib/deep/x.py": [],
    "src/self.ts": ["./self"],
    "src/lone.ts": ["."],
}


@pytest.fixture(scope="module")
def imports(spark):
    rows = []
    for repo in ("one", "two"):
        for path, targets in TREE.items():
            if repo == "two" and path == "src/b.ts":
                continue
            text = "".join(f'import {{ q }} from "{t}";\n' for t in targets)
            rows.append((f"{repo}/{path}", path, repo, text))
    rows.append(("one/none", "src/none.ts", "one", None))
    return graph.resolved_imports(spark.createDataFrame(rows, "file_id string, relative_path string, repo string, content string"))


def test_imports_are_resolved_in_order(imports):
    found = {(r.repo, r.src, r.target): r.file for r in imports.collect()}
    assert found["one", "src/a.ts", "./b"] == "src/b.ts" and found["two", "src/a.ts", "./b"] == "src/b/index.ts"
    assert found["one", "src/c.js", "./b/"] == "src/b.ts"
    assert found["one", "src/a.ts", "./c.js"] == "src/c.js" and found["one", "src/a.ts", "../lib"] == "lib/index.tsx"
    assert found["one", "lib/index.tsx", "./deep/x"] == "lib/deep/x.py" and found["one", "src/self.ts", "./self"] == "src/self.ts"
    lost = {(r.repo, r.src, r.target) for r in graph.unresolved(imports).collect()}
    assert lost == {(repo, src, t) for repo in ("one", "two") for src, t in [("src/a.ts", "./gone"), ("src/a.ts", "../../above"), ("src/lone.ts", ".")]}


def test_importers_and_dependents(imports):
    by = {}
    for r in graph.importers(imports).where("repo = 'one'").collect():
        by.setdefault(r.file, set()).add(r.called_by)
    assert by == {"src/a.ts": {"src/b.ts"}, "src/b.ts": {"src/a.ts", "src/c.js"}, "src/c.js": {"src/a.ts"}, "lib/index.tsx": {"src/a.ts"}, "lib/deep/x.py": {"lib/index.tsx"}}
    pairs = {(r.file, r.dependent): r.distance for r in graph.dependents(imports).where("repo = 'one'").collect()}

    def reach(file):
        """Breadth first over the reversed edges, from the file's own importers on."""
        edges = {f: set(c) for f, c in by.items()}
        edges["src/self.ts"] = {"src/self.ts"}
        found, now, distance = {}, {file}, 0
        while now:
            distance += 1
            now = {d for f in now for d in edges.get(f, ())} - set(found)
            found |= dict.fromkeys(now, distance)
        return found

    assert pairs == {(file, d): n for file in TREE for d, n in reach(file).items()}
    near = {(r.file, r.dependent) for r in graph.dependents(imports, max_rounds=1).where("repo = 'one'").collect()}
    assert near == {k for k, n in pairs.items() if n == 1}
    counts = {r.file: (r.imported_by, r.n_dependents, r.in_cycle) for r in graph.dependent_counts(imports).where("repo = 'one'").collect()}
    assert counts["src/b.ts"] == (2, 2, True) and counts["lib/deep/x.py"] == (1, 4, False) and counts["src/self.ts"] == (0, 0, True)
    assert graph.dependents(imports.limit(0)).count() == 0
