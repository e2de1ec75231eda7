"""Sums and extremes of distances without a look at every pair are those of the whole grid."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from veilmark.operators import knn, totals
from veilmark.operators.pruned import Category, Metric, Number, Opaque
from veilmark.plans import registry


def _metric() -> Metric:
    """There is no distance to level 7."""
    job = Category(("job", "branch"), lambda side: [F.col(f"{side}_job"), F.col(f"{side}_branch")])
    level = Opaque(("level",), F.when((F.col("q_level") != 7) & (F.col("c_level") != 7), F.abs(F.col("q_level") - F.col("c_level")) / 3.0), 2.0)
    return Metric((Number("age", 40.0), job, level, Number("income", 10.0, 0.5)))


def _people(spark, n, salt):
    h = lambda i, m: F.pmod(F.xxhash64(F.lit(salt), F.lit(i), "id"), F.lit(m))
    job = F.when(h(1, 12) < 11, h(1, 12))
    return spark.range(n).select(
        F.when(h(2, 50) > 0, h(2, 40)).alias("age"), F.concat(F.lit("j"), job.cast("string")).alias("job"), F.floor(job / 4).cast("string").alias("branch"), h(3, 9).alias("level"), (h(4, 90) / 7.0).alias("income"),
    )


def _rows(df):
    return sorted(([*r][:-3], [-1.0 if v is None else v for v in r[-3:]]) for r in df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in df.columns[:-3]}).collect())


def _never(*_):
    raise AssertionError("all pairs")


@pytest.mark.parametrize("kinds, places", [(1 << 22, 8192), (1 << 22, 60), (500, 60), (0, 8192)])
def test_totals_match_the_grid(spark, monkeypatch, kinds, places):
    metric, q, c = _metric(), _people(spark, 300, 1), _people(spark, 500, 2)
    plain = totals._grid(q.distinct(), c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")), metric)
    expected = _rows(plain.select(*[f"q_{k}" for k in metric.keys], "total", "least", "most"))
    for name, value in {"KINDS": kinds, "CAND_PLACES": places, "QUERY_PLACES": places, "SLICE": 16, "PAIR": 1e9}.items():
        monkeypatch.setattr(totals, name, value)
    monkeypatch.setattr(totals, "_grid", _never)
    got = _rows(totals.summary(q, c, metric))
    assert len(got) == len(expected) and any(v[0] == -1 for _, v in expected)
    for (a, x), (b, y) in zip(got, expected, strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-12, abs=1e-12)


def test_pairs_are_not_looked_at_where_places_repeat(spark, monkeypatch):
    """240,000 distinct records at 60 places: the grid would hold 5.8e10 pairs."""
    rows = spark.range(240_000).select((F.col("id") % 60).alias("x"), F.concat(F.lit("k"), F.floor(F.col("id") / 60) % 1000).alias("k"), F.lit("*").alias("g"))
    metric = Metric((Number("x", 59.0), Category(("k", "g"), lambda side: [F.col(f"{side}_k"), F.col(f"{side}_g")])))
    monkeypatch.setattr(knn, "pairs", _never)
    found = totals.summary(rows, rows, metric).where("q_k = 'k7'").collect()
    x = {r["q_x"]: r for r in found}
    assert len(found) == 60
    of = lambda d, e: ((d / 59) ** 2 / 2 + e / 2) ** 0.5
    total = sum(4 * (of(j, 0) + 999 * of(j, 0.25)) for j in range(60))
    assert x[0]["total"] == pytest.approx(total) and x[0]["least"] == 0 and x[0]["most"] == pytest.approx(of(59, 0.25))


def test_empty_sides_and_values_without_a_number(spark):
    metric, q = _metric(), _people(spark, 20, 1)
    assert totals.summary(q, q.limit(0), metric).count() == 0 == totals.summary(q.limit(0), q, metric).count()
    odd = q.withColumn("income", F.when(F.col("level") > 3, F.lit(float("nan"))).otherwise(F.col("income")))
    assert totals.summary(odd, odd, metric).count() == odd.distinct().count()


@pytest.mark.parametrize("name", ["record_distance", "distance_dispatch"])
def test_record_queries_match_their_sql_without_the_grid(spark, sf, monkeypatch, name):
    duck = duckdb.connect()
    duck.sql(f"create view part as select * from '{sf}/part.parquet'")
    expected = {r[0]: r[1:] for r in duck.sql(registry.SQL[name]).fetchall()}
    monkeypatch.setattr(totals, "PAIR", 1e9)
    monkeypatch.setattr(knn, "pairs", _never)
    got = {r["rid"]: (r["total"], r["least"], r["most"]) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got.keys() == expected.keys()
    for rid, found in got.items():
        assert found == pytest.approx([float(v) for v in expected[rid]], abs=2e-6)
