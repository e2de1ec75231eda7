"""Pruned neighbour search: the same neighbours as brute force, from a small share of the pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import knn, pruned, stages
from veilmark.operators.pruned import Category, Metric, Number, Opaque

SCHEMA = "rid long, x double, y double, leaf string, up string, tag string"


def metric():
    tag = F.when(F.col("q_tag").eqNullSafe(F.col("c_tag")), 0.0).otherwise(0.25)
    return Metric((Number("x", 20.0), Category(("leaf", "up"), lambda s: [F.col(f"{s}_leaf"), F.col(f"{s}_up")]), Number("y", 3.0, 2.0), Opaque(("tag",), tag, 0.5)))


def brute(a, b):
    edge = 0.0 if a[3] is not None and a[3] == b[3] else 0.5 if a[4] is not None and a[4] == b[4] else 1.0
    total = ((a[1] - b[1]) / 20) ** 2 + edge**2 + 2 * ((a[2] - b[2]) / 3) ** 2 + 0.5 * (0.0 if a[5] == b[5] else 0.25) ** 2
    return round(math.sqrt(total / 4), 9)


def table(rnd, n, first, nulls=True):
    rows = []
    for i in range(n):
        up = rnd.choice(["u", "v", "w"])
        leaf = None if nulls and rnd.random() < 0.05 else up + str(rnd.randrange(4))
        rows.append((first + i, float(rnd.randrange(-10, 11)), rnd.choice([-1.5, 0.0, 0.25, 1.5]), leaf, None if leaf is None else up, rnd.choice(["s", "t", None])))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(11)
    q, c = table(rnd, 90, 0), table(rnd, 260, 1000)
    return q, c, spark.createDataFrame(q, SCHEMA).repartition(3), spark.createDataFrame(c, SCHEMA).repartition(2)


@pytest.mark.parametrize(("block", "regions"), [(256, 4096), (10, 4096), (4, 5)])
def test_neighbours_match_brute_force(tables, monkeypatch, block, regions):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", block)
    monkeypatch.setattr(pruned, "REGIONS", regions)
    q, c, left, right = tables
    for k in (1, 3, 40):
        got = knn.top_k(left, right, metric(), k).collect()
        expected = {(a[0], r + 1, b[0], brute(a, b)) for a in q for r, b in enumerate(sorted(c, key=lambda b: (brute(a, b), b[0]))[:k])}
        assert {(r["query_id"], r["rank"], r["cand_id"], r["dist"]) for r in got} == expected and len(got) == len(expected)
    own = knn.top_k(left, left, metric(), 3, exclude_self=True).collect()
    expected = {(a[0], r + 1, b[0]) for a in q for r, b in enumerate(sorted((b for b in q if b[0] != a[0]), key=lambda b: (brute(a, b), b[0]))[:3])}
    assert {(r["query_id"], r["rank"], r["cand_id"]) for r in own} == expected
    there, back = knn.nearest_both_ways(left, right, metric())
    assert dict(there.collect()) == {a[0]: min(brute(a, b) for b in c) for a in q}
    assert dict(back.collect()) == {b[0]: min(brute(a, b) for a in q) for b in c}
    assert dict(knn.nearest_other(left, metric()).collect()) == {a[0]: min(brute(a, b) for b in q if b[0] != a[0]) for a in q}


def test_rows_that_must_not_meet_themselves_are_searched_once_a_combination(spark, tables, monkeypatch):
    """As many query rows as combinations, whatever repeats; each row is left out of its own neighbours alone."""
    q, _, left, _ = tables
    rows = [(a[0] * 40 + i, *a[1:]) for a in q[:30] for i in range(9)]
    asked, search = [], pruned.near_pairs
    monkeypatch.setattr(knn, "near_pairs", lambda q, *rest: asked.append(q.count()) or search(q, *rest))
    got = knn.top_k(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA), metric(), 12, exclude_self=True).collect()
    assert asked == [len({a[1:] for a in rows})]
    expected = {(a[0], r + 1, b[0], brute(a, b)) for a in rows for r, b in enumerate(sorted((b for b in rows if b[0] != a[0]), key=lambda b: (brute(a, b), b[0]))[:12])}
    assert {(r["query_id"], r["rank"], r["cand_id"], r["dist"]) for r in got} == expected and len(got) == len(expected)


def test_empty_sides_and_null_numbers(spark, tables):
    q, c, left, right = tables
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert knn.top_k(a, b, metric(), 2).count() == 0 and knn.nearest(a, b, metric()).count() == 0
    odd = spark.createDataFrame([(7, None, 0.0, "u1", "u", "s"), (8, 1.0, 0.0, "u1", "u", "s")], SCHEMA)
    assert dict(knn.nearest(odd, right, metric()).collect()) == {7: None, 8: min(brute((8, 1.0, 0.0, "u1", "u", "s"), b) for b in c)}
    assert dict(knn.nearest(left, odd, metric()).collect()) == {a[0]: brute(a, (8, 1.0, 0.0, "u1", "u", "s")) for a in q}


def test_few_pairs_are_seen_on_clustered_records(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(6000):
        cluster = rnd.randrange(60)
        up = "uvw"[cluster % 3]
        rows.append((i, cluster * 3.0 + rnd.random(), (cluster * 7 % 60) * 0.5 + rnd.random() * 0.1, up + str(cluster % 4), up, "s"))
    df = spark.createDataFrame(rows, SCHEMA)
    m = Metric((Number("x", 180.0), Category(("leaf", "up"), lambda s: [F.col(f"{s}_leaf"), F.col(f"{s}_up")]), Number("y", 30.0)))
    q = df.where("rid % 10 = 0").select(*[F.col(k).alias(f"q_{k}") for k in m.keys])
    c = df.where("rid % 10 <> 0").select(*[F.col(k).alias(f"c_{k}") for k in m.keys])
    index = pruned.Index(c, m)
    seen = pruned.visits(q, index, 5).join(index.rows.groupBy("__block").count(), "__block").agg(F.sum("count")).first()[0]
    assert seen < 0.08 * 600 * 5400


def test_few_pairs_are_seen_where_columns_are_independent(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.random() * 20, rnd.random() * 3, *(lambda u: (u + str(rnd.randrange(8)), u))("uvw"[rnd.randrange(3)]), "s") for i in range(12000)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = Metric((Number("x", 20.0), Category(("leaf", "up"), lambda s: [F.col(f"{s}_leaf"), F.col(f"{s}_up")]), Number("y", 3.0)))
    q = df.where("rid % 20 = 0").select(*[F.col(k).alias(f"q_{k}") for k in m.keys])
    index = pruned.Index(df.where("rid % 20 <> 0").select(*[F.col(k).alias(f"c_{k}") for k in m.keys]), m)
    seen = pruned.visits(q, index, 1).join(index.rows.groupBy("__block").count(), "__block").agg(F.sum("count")).first()[0]
    assert seen < 0.08 * 600 * 11400


def test_bounds_never_exceed_distances(tables, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 8)
    q, c, left, right = tables
    m = metric()
    index = pruned.Index(right.select("rid", *m.keys).toDF("c_rid", *[f"c_{k}" for k in m.keys]), m)
    rows = left.select(*[F.col(k).alias(f"q_{k}") for k in m.keys])
    blocks = index.regions().withColumnRenamed("__cregion", "__region")
    both = rows.join(blocks).join(index.rows, "__region")
    assert both.where(m.bound("r") > m.distance() + 1e-12).count() == 0


def test_staged_tables_are_read_back_and_released(spark):
    t = stages.staged(spark.range(5), "t")
    assert t.count() == 5
    stages.release(t)
    with pytest.raises(Exception):
        spark.read.parquet(*t.inputFiles()).count()
