"""Every query with SQL, side by side with DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from veilmark.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (bool, str)):
        return value
    return float(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    expected = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert _rows(df.columns, df.collect()) == _rows(expected.columns, expected.fetchall())


def test_every_query_is_callable():
    assert set(registry.SQL) <= set(registry.QUERIES)
