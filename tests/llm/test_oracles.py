"""Queries of the subpackage that SQL can express, and all of them by name."""

import re

import corpus_pipeline
import duckdb
import pytest
from graspmeter.llm.queries import ORACLES, QUERIES

import __spark_entry__ as entry


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = QUERIES[name](spark, sf)
    expected = con.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    rows = [tuple(row) for row in expected.project(", ".join(columns)).fetchall()]
    assert sorted(map(str, map(tuple, found.select(columns).collect()))) == sorted(map(str, rows))
