"""Operators that SQL can express, side by side with DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from veilmark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, sf)
    expected = c.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    rows = lambda names, data: sorted((tuple(dict(zip(names, r))[k] for k in order) for r in data), key=repr)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_one_query_an_operator():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, len(queries.QUERIES) + 1)]
