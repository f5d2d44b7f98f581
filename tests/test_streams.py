"""Streams over several files give what the batch jobs give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graspmeter.functions.scores import n_right, percent
from graspmeter.operators import grading
from graspmeter.streaming import answers as stream

SCHEMA = "answer_id bigint, user_id bigint, ts timestamp, is_correct boolean"


@pytest.fixture(scope="module")
def log(spark, sf, tmp_path_factory):
    """Answers in time order, one file per time range, each file written by its own job."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("answer_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("is_correct"),
    )
    folder = str(tmp_path_factory.mktemp("log"))
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01")]):
        part = events.where((F.col("ts") >= lo) & (F.col("ts") < hi))
        part.coalesce(1).write.parquet(f"{folder}/part={i}")
    return folder, events


def source(spark, folder):
    return stream.answer_stream(spark, f"{folder}/part=*", SCHEMA, files_per_trigger=1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_running_scores_equal_batch(spark, log):
    folder, events = log
    query, out = stream.write_table(stream.running_scores(source(spark, folder), "60 days"), "update")
    got = stream.latest(spark, out, ["user_id"])
    want = events.groupBy("user_id").agg(
        n_right().alias("correct"), F.count("*").alias("answered"), percent(n_right(), F.count("*")).alias("score")
    )
    cols = ("user_id", "correct", "answered", "score")
    assert rows(got, *cols) == rows(want, *cols)
    assert len(query.recentProgress) >= 3
    assert stream.dropped_late(spark, out) == 0


def test_late_and_repeated_answers_do_not_count(spark, log, tmp_path):
    folder, events = log
    many = str(tmp_path / "late")
    for i in (1, 2):
        spark.read.parquet(f"{folder}/part={i}").coalesce(1).write.parquet(f"{many}/part={i}")
    # The same answers once more, and one far older than the watermark.
    old = spark.read.parquet(f"{folder}/part=0").orderBy("ts").limit(1)
    again = spark.read.parquet(f"{folder}/part=2").unionByName(old)
    again.coalesce(1).write.parquet(f"{many}/part=3")
    query, out = stream.write_table(stream.running_scores(source(spark, many), "1 day"), "update")
    total = stream.latest(spark, out, ["user_id"]).agg(F.sum("answered")).head()[0]
    assert total == events.where("ts >= '2024-01-10'").count()
    assert stream.dropped_late(spark, out) >= 1


def test_adaptive_levels_equal_batch(spark, log):
    folder, events = log
    got = stream.adaptive_levels(source(spark, folder))
    want = grading.adaptive_difficulty(events, "user_id", ["ts", "answer_id"])
    cols = ("user_id", "answered", "level")
    assert rows(got, *cols) == rows(want, *cols)


def test_daily_scores_equal_batch(spark, log):
    folder, events = log
    _, out = stream.write_table(stream.windowed_scores(source(spark, folder), "60 days", "1 day"), "update")
    got = stream.latest(spark, out, ["window_start", "window_end"])
    want = events.groupBy(F.window("ts", "1 day").alias("w")).agg(n_right().alias("correct"), F.count("*").alias("answered"))
    assert rows(got, "window_start", "correct", "answered") == rows(want, "w.start", "correct", "answered")


def test_upsert_stream_keeps_the_newest(spark, log):
    folder, events = log
    got = stream.upsert_stream(source(spark, folder), "user_id", "answer_id")
    want = events.groupBy("user_id").agg(F.max("answer_id").alias("answer_id"))
    assert rows(got, "user_id", "answer_id") == rows(want, "user_id", "answer_id")


def test_a_restart_without_new_data_gives_the_last_table(spark, log, tmp_path):
    folder, _ = log
    for number, run in enumerate(
        (
            lambda store: stream.adaptive_levels(source(spark, folder), store),
            lambda store: stream.upsert_stream(source(spark, folder), "user_id", "answer_id", store),
        )
    ):
        store = str(tmp_path / f"store{number}")
        first = sorted(map(str, run(store).collect()))
        assert first and sorted(map(str, run(store).collect())) == first
