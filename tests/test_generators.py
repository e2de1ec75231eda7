"""Networks, correlated numbers and the normal distribution behind them."""

from __future__ import annotations

import math
import random
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions.normal import distribution, quantile
from veilmark.operators import models, synth


def test_normal_distribution(spark):
    ps = [1e-12, 1e-5, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.97575, 0.9999999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", quantile(F.col("p")).alias("x")).withColumn("back", distribution(F.col("x"))).collect()
    for r in rows:
        assert r["x"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=2e-9, abs=2e-9) and r["back"] == pytest.approx(r["p"], rel=1e-7)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(quantile(F.col("p"))).collect()
    assert [r[0] for r in odd] == [None] * 3
    far = spark.createDataFrame([(-9.0,), (9.0,), (0.0,)], "x double").select(distribution(F.col("x"))).collect()
    assert [r[0] for r in far] == pytest.approx([NormalDist().cdf(-9.0), 1.0, 0.5])


def table(n=3000):
    rnd = random.Random(7)
    rows = []
    for _ in range(n):
        a, b = rnd.choice("xxy"), rnd.choice("uvw")
        c = {"xu": "p", "yv": "q"}.get(a + b, rnd.choice("pqr"))
        rows.append((a, b, c))
    return rows


def test_network_follows_its_conditional_tables(spark):
    rows = table()
    df = spark.createDataFrame(rows, "a string, b string, c string")
    out = [tuple(r)[1:] for r in synth.network(spark, df, {"c": ["a", "b"], "a": [], "b": ["a"]}, 6000, 3).select("rid", "a", "b", "c").collect()]
    assert len(out) == 6000
    seen, drawn = Counter(rows), Counter(out)
    assert set(drawn) <= set(seen) and all(abs(drawn[k] / 6000 - n / 3000) < 0.02 for k, n in seen.items())
    again = synth.network(spark, df.repartition(5), {"c": ["a", "b"], "a": [], "b": ["a"]}, 6000, 3).select("rid", "a", "b", "c").collect()
    assert Counter(tuple(r)[1:] for r in again) == drawn
    with pytest.raises(ValueError):
        synth.network(spark, df, {"a": ["b"], "b": ["a"]}, 5)


def test_unseen_parents_back_off(spark):
    df = spark.createDataFrame([("x", "u", "only xu")] * 4 + [("y", "v", "only yv")] * 4, "a string, b string, c string")
    out = synth.network(spark, df, {"a": [], "b": [], "c": ["a", "b"]}, 400, 1).collect()
    # x with v does not occur: what x alone has
    assert {(r["a"], r["b"], r["c"]) for r in out} == {("x", "u", "only xu"), ("x", "v", "only xu"), ("y", "u", "only yv"), ("y", "v", "only yv")}
    assert [tuple(r) for r in synth.network(spark, df.limit(0), {"a": [], "b": ["a"]}, 2).collect()] == [(0, None, None), (1, None, None)]


def test_numbers_keep_distributions_and_correlations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    rows = [(float(np.exp(v)), int(round(3 * v + rng.normal())), float(rng.random()), "ab"[int(v > 0)]) for v in x]
    df = spark.createDataFrame(rows, "p double, q long, r double, s string")
    out = synth.numbers(spark, df, ["p", "q", "r"], 4000, 9)
    new, old = out.toPandas(), df.toPandas()
    assert set(new["q"]) <= set(old["q"]) and new["q"].dtype == old["q"].dtype
    for c in "pqr":
        assert abs(new[c].mean() - old[c].mean()) < 0.06 * old[c].std() and abs(new[c].std() / old[c].std() - 1) < 0.12
    ranks = lambda t: t[["p", "q", "r"]].rank().corr().to_numpy()
    assert np.abs(ranks(new) - ranks(old)).max() < 0.04
    again = synth.numbers(spark, df.repartition(7), ["p", "q", "r"], 4000, 9).toPandas()
    assert again.sort_values("rid").reset_index(drop=True).equals(new.sort_values("rid").reset_index(drop=True))
    inside = synth.numbers(spark, df, ["p", "q"], 2000, 9, by="s").toPandas()
    assert (inside[inside["s"] == "a"]["p"] <= 1).all() and (inside[inside["s"] == "b"]["p"] > 1).all()


def test_numbers_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 5), (1.0, None, 5)], "a double, b double, c long")
    assert [tuple(r) for r in synth.numbers(spark, df, ["a", "b", "c"], 2).orderBy("rid").collect()] == [(0, 1.0, None, 5), (1, 1.0, None, 5)]
    assert synth.numbers(spark, df.limit(0), ["a"], 1).collect()[0]["a"] is None


def test_network_scores_take_one_job_a_round(spark, monkeypatch):
    df = spark.createDataFrame(table(400), "a string, b string, c string")
    states, calls = {"a": 2, "b": 3, "c": 3}, []
    inner = models._family_scores

    def counted(combos, columns, states, families):
        families = list(families)
        calls.append(len(families))
        found = inner(combos, columns, states, families)
        for child, parents in families:
            assert found[child, parents] == pytest.approx(models.k2_score(df, child, sorted(parents), states[child]))
        return found

    monkeypatch.setattr(models, "_family_scores", counted)
    up = models.network_parents(df, ["a", "b", "c"], states)
    edges = sum(map(len, up.values()))
    assert calls[0] == 9 and len(calls) <= edges + 2
    assert {frozenset((c, p)) for c, ps in up.items() for p in ps} >= {frozenset("ac"), frozenset("bc")} and math.isfinite(sum(calls))
