"""Nearest neighbours and exact percentiles against brute force, and their spread over tasks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.operators import distance, knn, ranks


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    q = [(i, rnd.randrange(12), rnd.choice(["a", "b", None])) for i in range(70)]
    c = [(1000 + i, rnd.randrange(12), rnd.choice(["a", "b", "c", None])) for i in range(150)]
    schema = "rid long, x long, s string"
    return q, c, spark.createDataFrame(q, schema).repartition(3), spark.createDataFrame(c, schema).repartition(2)


def expression():
    return distance.record({"x": distance.numeric(F.col("q_x"), F.col("c_x"), 11), "s": F.when(F.col("q_s").eqNullSafe(F.col("c_s")), 0.0).otherwise(1.0)})


def brute(a, b):
    return round(math.sqrt(((abs(a[1] - b[1]) / 11.0) ** 2 + (a[2] != b[2])) / 2), 9)


@pytest.mark.parametrize("cell_rows", [1024, 5])
def test_neighbours_match_brute_force(tables, monkeypatch, cell_rows):
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    q, c, left, right = tables
    keys = ["x", "s"]
    for k in (1, 4, 200):
        got = knn.top_k(left, right, expression(), k, keys=keys).collect()
        expected = {(a[0], r + 1, b[0], brute(a, b)) for a in q for r, b in enumerate(sorted(c, key=lambda b: (brute(a, b), b[0]))[:k])}
        assert {(r["query_id"], r["rank"], r["cand_id"], r["dist"]) for r in got} == expected and len(got) == len(expected)
    own = knn.top_k(left, left, expression(), 3, exclude_self=True).collect()
    expected = {(a[0], r + 1, b[0]) for a in q for r, b in enumerate(sorted((b for b in q if b[0] != a[0]), key=lambda b: (brute(a, b), b[0]))[:3])}
    assert {(r["query_id"], r["rank"], r["cand_id"]) for r in own} == expected
    there, back = knn.nearest_both_ways(left, right, expression(), keys)
    least = {a[0]: min(brute(a, b) for b in c) for a in q}
    assert dict(there.collect()) == least == dict(knn.nearest(left, right, expression(), keys).collect())
    assert dict(back.collect()) == {b[0]: min(brute(a, b) for a in q) for b in c}
    assert dict(knn.nearest_other(left, expression(), keys).collect()) == {a[0]: min(brute(a, b) for b in q if b[0] != a[0]) for a in q}


def test_grid_is_spread_over_tasks(tables):
    _, _, left, right = tables
    p = knn.pairs(left, right, cell_rows=10)
    tasks = p.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 70 * 150
    assert len(tasks) > 30 and max(r["count"] for r in tasks) < 70 * 150 / 10


def test_empty_sides(tables):
    _, _, left, right = tables
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert knn.top_k(a, b, expression(), 2, keys=["x", "s"]).count() == 0 and knn.nearest(a, b, expression(), ["x", "s"]).count() == 0


def test_percentiles_match_numpy(spark, monkeypatch):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.random(), 0.25, rnd.random() * 1e-9, 1e6]) for _ in range(2000)]
    counts = spark.createDataFrame([(v,) for v in values], "value double").groupBy("value").agg(F.count("*").alias("n"))
    shares = (0.0, 0.1, 0.37, 0.5, 0.9, 1.0)
    for bins in (2048, 7):
        monkeypatch.setattr(ranks, "BINS", bins)
        assert ranks.percentiles(counts, shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert ranks.percentiles(counts.limit(0), (0.5,)) == [None]
