"""A drawn table has as many rows as its original."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilmark.operators import synth
from veilmark.plans import registry


@pytest.mark.parametrize("name", ["synth_marginal", "synth_tree"])
def test_as_many_rows_as_the_original(spark, name):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    got = registry.QUERIES[name](spark, sf)
    assert n != 1000 and got.count() == got.select("rid").distinct().count() == n
    assert got.where("brand is null or type is null").count() == 0


def test_hook_sees_the_drawn_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    double = lambda t: t.withColumn("twice", F.col("n") * 2)
    for out in (synth.marginals(spark, df, ["s", "n"], 20, post=double), synth.tree(spark, df, {"s": None, "n": "s"}, 20, post=double)):
        assert out.count() == 20 and out.where("twice <> 2 * n").count() == 0


def _by_hand(rows, column, parent, drawn, seed):
    """Inverse distribution of one column by plain Python: the first value whose cumulative share exceeds the draw."""
    from collections import Counter
    from hashlib import md5

    tables = {}
    for r in rows:
        if r[column] is not None:
            tables.setdefault(r[parent] if parent else None, Counter())[r[column]] += 1
    out = {}
    for rid, of in drawn:
        table, u, sofar = tables.get(of), int(md5(f"{rid}|{column}|{seed}".encode()).hexdigest()[:8], 16), 0
        out[rid] = None
        for value in sorted(table or ()):
            sofar += table[value]
            if u < sofar / sum(table.values()) * 2**32:
                out[rid] = value
                break
    return out


def test_draws_equal_a_plain_inversion(spark):
    rows = [{"p": "hot" if i % 3 else f"p{i % 40}", "v": None if i % 11 == 0 else i * i % 701} for i in range(2000)] + [{"p": "childless", "v": None}] * 300
    df = spark.createDataFrame([(r["p"], r["v"]) for r in rows], "p string, v int")
    got = [tuple(r) for r in synth.tree(spark, df, {"p": None, "v": "p"}, 3000, 7).select("rid", "p", "v").collect()]
    assert len(got) == 3000 and any(v is None for _, _, v in got)
    assert {i: p for i, p, _ in got} == _by_hand(rows, "p", None, [(i, None) for i, _, _ in got], 7)
    assert {i: v for i, _, v in got} == _by_hand(rows, "v", "p", [(i, p) for i, p, _ in got], 7)


def test_shuffled_look_up_draws_the_same(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 1999).alias("v"), (F.col("id") % 3).alias("p"))
    draw = lambda: sorted(map(tuple, synth.tree(spark, df, {"p": None, "v": "p"}, 2000, 1).collect()))
    want = draw()
    monkeypatch.setattr(synth, "BROADCAST_LEAVES", 0)
    monkeypatch.setattr(synth, "CHUNKS", 3)
    assert draw() == want


def test_column_without_values_is_null(spark):
    df = spark.createDataFrame([], "s string, n int")
    assert synth.marginals(spark, df, ["s", "n"], 5).where("s is null and n is null").count() == 5
