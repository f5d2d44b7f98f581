"""What must not grow with the tables: broadcasts, and the rows of a task."""

import re

import pytest
from graspmeter.operators.grading import grade
from graspmeter.operators import py_blocks, ranges
from graspmeter.plans import catalog
from graspmeter.plans import driver_tables as D
from pyspark.sql import functions as F


def bank(spark, n=3):
    """Few bytes by Spark's reckoning, as those of a generated bank."""
    options = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(f"text {c}").alias("text"), F.lit(c == "B").alias("is_correct")) for c in "ABCD"])
    fixed = {"explanation": "because", "difficulty": 2, "file": "a.ts", "start_line": 1}
    return spark.range(n).select(F.col("id").alias("question_id"), options.alias("options"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("detailed", [False, True])
def test_option_texts_are_not_broadcast(spark, detailed):
    answers = spark.createDataFrame([(1, 0, "B"), (1, 1, "C"), (2, 2, "E"), (2, 7, "A")], "session_id long, question_id long, selected_label string")
    got = grade(answers, bank(spark), detailed)
    assert "Broadcast" not in plan(got)
    assert sorted((r.session_id, r.question_id, r.is_correct) for r in got.collect()) == [(1, 0, True), (1, 1, False), (2, 2, False)]


def test_files_of_a_small_table_are_dealt_out(spark, tmp_path):
    """A row of a few bytes is a file to parse, so tasks go by rows and not by bytes."""
    n = 3 * D.FILES_A_TASK - 5
    part = spark.range(1, n + 1, 1, 1).select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    files = D.code_files(spark, str(tmp_path))
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == 3 and max(sizes) < 1.2 * D.FILES_A_TASK
    assert files.select("file_id").distinct().count() == n


def test_tables_without_rows_or_keys_are_dealt_out(spark, tmp_path):
    none = spark.range(2 * D.FILES_A_TASK).select(F.lit(None).cast("long").alias("p_partkey"), F.lit("Brand#11").alias("p_brand"))
    none.write.parquet(f"{tmp_path}/nulls/part.parquet")
    none.limit(0).write.parquet(f"{tmp_path}/empty/part.parquet")
    assert D.code_files(spark, f"{tmp_path}/nulls").count() == 2 * D.FILES_A_TASK
    assert D.code_files(spark, f"{tmp_path}/empty").count() == 0


def spied(monkeypatch, module):
    """The frames that ``module`` writes, by name."""
    frames, write = {}, module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: write(frames.setdefault(name, df), name))
    return frames


def test_lines_that_end_no_block_are_left_out_early(spark, monkeypatch):
    text = "class A:\n" + "    x = 1\n" * 300 + "    def m(self):\n" + "        y = 2\n" * 300 + "z = 3\n" * 300
    frames = spied(monkeypatch, py_blocks)
    frame = spark.createDataFrame([("a.py", "python", text)], "file_id string, language string, content string")
    got = py_blocks.nested_blocks(frame).select("name", "start_line", "end_line", "parent_name").collect()
    assert sorted(map(tuple, got)) == [("A", 0, 600 + 1, None), ("m", 301, 601, "A")]
    lines = frames["lines"]
    assert (lines.select(F.explode("lines")) if "lines" in lines.columns else lines).count() < 10


@pytest.mark.parametrize("name", ["f5_function_extents", "f18_in_try_tables"])
def test_files_are_parsed_before_rows_are_dealt_out_by_ranges(spark, sf, monkeypatch, name):
    """Dealing out by ranges reads its input twice."""
    frames = spied(monkeypatch, ranges)
    catalog.QUERIES[name](spark, sf)
    assert "part.parquet" not in plan(frames["asof"])


def test_intervals_of_several_lengths_share_a_width(spark):
    """Points are dealt out once for each width that is used."""
    assert ranges._filed_levels({n: 2.0**n for n in range(1, 8)}) == dict.fromkeys(range(1, 8), 7)
    assert ranges._filed_levels({}) == {} and ranges._filed_levels({20: 1.0, 1: 1e12}) == {20: 20, 1: 1}
    far = ranges._filed_levels({n: 1.0 for n in range(0, 60, 6)})
    assert all(far[n] - n <= 6 for n in far)
    spans = spark.range(90).select(F.lit(1).alias("k"), (F.col("id") * 40).alias("a"), (F.col("id") * 41).alias("b"))
    points = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    met = ranges.interval_join(points, spans, ["k"], "at", "a", "b")
    assert met.count() == sum(i + 1 for i in range(90))
    assert len(re.findall(r"explode\(\[7\]\)", plan(met))) == 1
