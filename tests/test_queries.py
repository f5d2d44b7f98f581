"""Every registered query: runs, has a sound plan, and agrees with its check SQL."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graspmeter.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
BAD_NODES = re.compile(r"BroadcastNestedLoopJoin|CartesianProduct|ArrowEvalPython|BatchEvalPython|InPandas|InArrow")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_without_the_optional_folder():
    code = "import sys; sys.modules['graspmeter.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
    assert run.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not BAD_NODES.search(plan), plan
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", ["d13_detect_all", "f19_function_table", "p6_trace_paths", "b3_render_templates_v0"])
def test_code_jobs_do_not_shuffle(spark, sf, name):
    """From files to findings and questions there is no exchange but the spread of the few input rows."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange (\w+)\(p_partkey", plan)
    assert len(re.findall(r"Exchange ", plan)) == len(exchanges) <= 1


def test_scans_read_only_what_they_need(spark, sf):
    plan = QUERIES["r2_file_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    lineitem = next(line for line in plan.splitlines() if "l_quantity" in line and "FileScan" in line)
    assert "l_shipdate" not in lineitem and "l_extendedprice" not in lineitem
    assert "PushedFilters: [IsNotNull" in lineitem
