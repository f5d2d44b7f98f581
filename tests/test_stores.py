"""Levels in the state store and the bucketed table, over several micro-batches."""

from __future__ import annotations

import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graspmeter.operators import grading
from graspmeter.sources.buckets import BucketStore, upsert_stream
from graspmeter.streaming import answers as stream
from graspmeter.streaming import levels

SCHEMA = "answer_id bigint, user_id bigint, ts timestamp, is_correct boolean"
T0 = datetime(2024, 1, 1)


def write(spark, folder, number, rows):
    """``rows``: (answer_id, user_id, minute, is_correct)."""
    full = [(i, u, None if m is None else T0 + timedelta(minutes=m), ok) for i, u, m, ok in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")


def run(spark, folder, store, **options):
    source = stream.answer_stream(spark, f"{folder}/part=*", SCHEMA, files_per_trigger=1)
    query, out = stream.write_table(levels.adaptive_states(source, **options), "update", store)
    return query, levels.levels_of(stream.latest(spark, out, ["user_id"]))


def table(df):
    return {r.user_id: (r.answered, r.level, r.right_streak, r.wrong_streak, r.late) for r in df.collect()}


def batch(spark, rows):
    full = [(i, u, T0 + timedelta(minutes=m), ok) for i, u, m, ok in rows]
    found = grading.adaptive_difficulty(spark.createDataFrame(full, SCHEMA), "user_id", ["ts", "answer_id"])
    return {r.user_id: (r.answered, r.level, r.right_streak, r.wrong_streak) for r in found.collect()}


def test_levels_equal_batch_and_survive_restarts(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [(i, i % 7, i, (i * i + i // 5) % 3 > 0) for i in range(300)]
    for number in range(3):
        write(spark, folder, number, rows[number * 50 : number * 50 + 50])
    first, _ = run(spark, folder, store)
    assert len(first.recentProgress) >= 3
    for number in range(3, 6):
        write(spark, folder, number, rows[number * 50 : number * 50 + 50])
    _, second = run(spark, folder, store)
    assert {u: v[:4] for u, v in table(second).items()} == batch(spark, rows)
    assert {v[4] for v in table(second).values()} == {0}
    _, again = run(spark, folder, store)
    assert table(again) == table(second)


def test_late_repeated_and_unusable_answers(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 0, [(1, 1, 0, True), (2, 1, 10, True), (2, 1, 10, True), (3, 2, 5, None), (4, None, 6, True), (5, 3, None, True)])
    write(spark, folder, 1, [(6, 1, 5, False), (2, 1, 10, True), (7, 1, 11, True), (8, 2, 5, False)])
    _, found = run(spark, folder, str(tmp_path / "store"))
    # User 1: two right, then late, repeated, and a third right one. User 2: a null counts as wrong; equal times go by id.
    assert table(found) == {1: (3, 4, 0, 0, 3), 2: (2, 2, 0, 0, 0)}


def test_only_touched_users_are_written(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    write(spark, folder, 0, [(i, i, i, True) for i in range(50)])
    write(spark, folder, 1, [(100, 7, 100, True)])
    query, _ = run(spark, folder, store)
    rows = spark.read.parquet(f"{store}/out").groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in rows if r["count"]} == {0: 50, 1: 1}
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert kept[-1] == 50


def test_idle_users_are_given_up(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    write(spark, folder, 0, [(1, 1, 0, True), (2, 1, 1, True), (3, 1, 2, True), (4, 2, 0, True)])
    write(spark, folder, 1, [(5, 2, 500, True)])
    write(spark, folder, 2, [(6, 2, 501, True)])
    write(spark, folder, 3, [(7, 1, 502, False)])
    run(spark, folder, store, idle_seconds=3600)
    rows = spark.read.parquet(f"{store}/out").where("user_id = 1").orderBy("batch_id").collect()
    found = [(r.expired, r.answered, r.state // 4 + 1) for r in rows]
    # Level 4 after three right ones, then given up; the new answer begins at level 3.
    assert found == [(False, 3, 4), (True, 3, 4), (False, 1, 3)]


CHANGES = "id long, version long, text string"


@pytest.fixture
def store(spark, tmp_path):
    schema = spark.createDataFrame([], CHANGES).schema
    return BucketStore(spark, str(tmp_path / "table"), schema, "id", "version", buckets=8)


def files_of(store):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{store.folder}/data") for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_its_own_buckets_only(spark, store):
    store.apply(spark.range(200).selectExpr("id", "1L version", "'old' text"), 0)
    before, generations = files_of(store), store.generations()
    store.apply(spark.createDataFrame([(5, 2, "new"), (5, 3, "newest"), (6, 0, "stale"), (900, 1, "more"), (None, 9, "no key")], CHANGES), 1)
    rows = {r.id: (r.version, r.text) for r in store.read().collect()}
    assert len(rows) == 201 and rows[5] == (3, "newest") and rows[6] == (1, "old") and rows[900] == (1, "more")
    after = store.generations()
    touched = {b for b in after if after[b] == 1}
    assert 1 <= len(touched) <= 3 and all(after[b] == generations[b] for b in after if b not in touched)
    assert before <= files_of(store) and len(files_of(store) - before) <= 3


def test_a_batch_that_is_run_again(spark, store):
    store.apply(spark.range(50).selectExpr("id", "1L version", "'old' text"), 0)
    change = spark.createDataFrame([(3, 2, "new"), (70, 1, "more")], CHANGES)
    store.apply(change, 1)
    first = sorted(map(tuple, store.read().collect()))
    store.apply(change, 1)
    assert sorted(map(tuple, store.read().collect())) == first
    # A batch that failed before its manifest: what it wrote does not count, and running it again puts it right.
    store.apply(spark.createDataFrame([(3, 5, "third")], CHANGES), 2)
    shutil.rmtree(f"{store.folder}/manifest/gen=2")
    assert sorted(map(tuple, store.read().collect())) == first
    store.apply(spark.createDataFrame([(3, 5, "third")], CHANGES), 2)
    assert {r.id: r.text for r in store.read().collect()}[3] == "third"


def test_empty_tables_and_batches(spark, store):
    assert store.read().count() == 0
    store.apply(spark.createDataFrame([], CHANGES), 0)
    assert store.read().count() == 0 and store.generations() == {}


def test_a_stream_of_ten_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for number in range(10):
        rows = [(number * 10 + i, (number * 10 + i) % 23, number, i % 2 == 0) for i in range(10)]
        write(spark, folder, number, rows)
    source = stream.answer_stream(spark, f"{folder}/part=*", SCHEMA, files_per_trigger=1)
    target = str(tmp_path / "out")
    store = upsert_stream(source, target, "user_id", "answer_id", buckets=8)
    want = spark.read.schema(SCHEMA).parquet(folder).groupBy("user_id").agg(F.max("answer_id").alias("answer_id"))
    assert sorted(map(tuple, store.read().select("user_id", "answer_id").collect())) == sorted(map(tuple, want.collect()))
    assert store.manifest().select("gen").distinct().count() == 10
    again = upsert_stream(source, target, "user_id", "answer_id", buckets=8)
    assert again.read().count() == 23 and again.manifest().select("gen").distinct().count() == 10
