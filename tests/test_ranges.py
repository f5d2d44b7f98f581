"""Interval and as-of joins against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from graspmeter.operators.ranges import asof_join, covered, interval_join, merged_intervals


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    pick = random.Random(1)
    keys = ["hot"] * 10 + [f"k{i}" for i in range(30)]
    points = [(pick.choice(keys), pick.randrange(-500, 5000), i) for i in range(900)]
    points += [(None, 5, 900), ("hot", None, 901), ("alone", 7, 902), points[0], points[0]]
    spans = []
    for i in range(300):
        start = pick.randrange(-500, 5000)
        spans.append((pick.choice(keys), start, start + int(2 ** pick.uniform(0, 12)) - 1, i))
    spans += [("hot", 10, 9, 300), ("hot", 10, 10, 301), (None, 0, 9, 302), ("hot", None, 9, 303), spans[0]]
    return (
        points, spans,
        spark.createDataFrame(points, "k string, at long, p int").repartition(7),
        spark.createDataFrame(spans, "k string, a long, b long, s int").repartition(5),
    )


@pytest.mark.parametrize("width", [1, 10, 100_000])
def test_every_pair_meets_once(tables, width):
    points, spans, left, right = tables
    met = interval_join(left, right, ["k"], "at", "a", "b", width)
    want = [(k, at, p, a, b, s) for k, at, p in points for q, a, b, s in spans if k is not None and k == q and None not in (at, a) and a <= at <= b]
    assert sorted(tuple(r) for r in met.select("k", "at", "p", "a", "b", "s").collect()) == sorted(want)
    assert not re.search("NestedLoop|Cartesian|Python", plan_of(met))
    assert interval_join(left, right.limit(0), ["k"], "at", "a", "b").count() == 0


def test_a_hot_key_spreads(spark):
    """All points of one key and time range: the join's keys are as many as the buckets."""
    left = spark.range(20_000).select(F.lit("x").alias("k"), F.col("id").alias("at"))
    right = spark.range(0, 20_000, 10).select(F.lit("x").alias("k"), F.col("id").alias("a"), (F.col("id") + 12).alias("b"))
    met = interval_join(left, right, ["k"], "at", "a", "b")
    assert met.count() == sum(1 for a in range(0, 20_000, 10) for at in range(a, min(a + 13, 20_000)))
    dealt = left.withColumn("bucket", F.col("at").bitwiseAND(~15))
    assert dealt.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 16


def brute(points, rows, direction, exact):
    """Row of ``rows`` for each point; of rows at one place the one with the largest number."""
    found = []
    for k, at, p in points:
        good = [r for r in rows if None not in (k, at, r[1]) and r[0] == k and (exact or r[1] != at)]
        before = max((r for r in good if r[1] <= at), key=lambda r: (r[1], r[2]), default=None)
        behind = min((r for r in good if r[1] >= at), key=lambda r: (r[1], -r[2]), default=None)
        if direction == "nearest":
            nearer = before is None or (behind is not None and behind[1] - at < at - before[1])
            found.append((k, at, p, behind if nearer else before))
        else:
            found.append((k, at, p, before if direction == "backward" else behind))
    return sorted(map(str, found))


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_nearest_rows(spark, direction, exact):
    pick = random.Random(2)
    keys = ["hot"] * 8 + ["a", "b", "c", "d"]
    points = [(pick.choice(keys), pick.randrange(300), i) for i in range(700)] + [("none", 1, 700), (None, 1, 701), ("hot", None, 702)]
    points.append(points[0])
    rows = [(pick.choice(keys), pick.randrange(300), i) for i in range(60)] + [("hot", None, 60), (None, 1, 61), ("other", 3, 62)]
    left = spark.createDataFrame(points, "k string, at long, p int").repartition(6)
    right = spark.createDataFrame(rows, "k string, t long, n int").repartition(3)
    got = asof_join(left, right, ["k"], "at", "t", direction, ties=["n"], exact=exact)
    assert got.columns == ["k", "at", "p", "found"]
    assert sorted(str((r.k, r.at, r.p, tuple(r.found) if r.found else None)) for r in got.collect()) == brute(points, rows, direction, exact)
    assert not re.search("NestedLoop|Cartesian|Python", plan_of(got))


def test_sides_may_be_empty(spark):
    left = spark.createDataFrame([("a", 1)], "k string, at long")
    right = spark.createDataFrame([], "k string, t long")
    assert [r.found for r in asof_join(left, right, ["k"], "at", "t").collect()] == [None]
    assert asof_join(left.limit(0), left, ["k"], "at", "at").count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "at", "t", direction="sideways")


def test_a_hot_key_carries_over_tasks(spark):
    """One key over all tasks, with a single early row to be found by all others."""
    left = spark.range(0, 50_000, 1, 16).select(F.lit("x").alias("k"), F.col("id").alias("at"))
    right = spark.createDataFrame([("x", 10, "first"), ("x", 40_000, "second")], "k string, t long, name string")
    got = asof_join(left, right, ["k"], "at", "t").groupBy("found.name").count().collect()
    assert {r.name: r["count"] for r in got} == {None: 10, "first": 39_990, "second": 10_000}


def test_covered_points(tables):
    points, spans, left, right = tables
    want = [(k, at, p, any(None not in (k, at, a) and k == q and a <= at <= b for q, a, b, _ in spans)) for k, at, p in points]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in covered(left, right.where("a <= b"), ["k"], "at", "a", "b").collect())
    merged = merged_intervals(right.where("k = 'hot' and a <= b"), ["k"], "a", "b").orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(merged, merged[1:]))
