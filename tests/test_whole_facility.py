"""The facility queries take every supplier as a site."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from veilmark.operators import facility
from veilmark.plans import registry

SF = "/root/testdata/sf0.01"


def brute_km():
    """Kilometres of each zone (row) to each site (column), and the ids of sites and zones."""
    z = np.array(duckdb.sql(f"select n_nationkey from '{SF}/nation.parquet' order by 1").fetchall())[:, 0]
    s = np.array(duckdb.sql(f"select s_suppkey from '{SF}/supplier.parquet' order by 1").fetchall())[:, 0]
    a, b = np.radians(z * 3 % 50 + 20)[:, None], np.radians(s * 11 % 50 + 20)[None]
    lon = np.radians((s * 13 % 100 - 120)[None] - (z * 7 % 100 - 120)[:, None])
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(lon / 2) ** 2)), z, s


def test_all_suppliers_are_sites(spark):
    km, z, s = brute_km()
    assert len(s) > 40
    got = {(r["zone"], r["site"]): r["km"] for r in registry.QUERIES["haversine_matrix"](spark, SF).collect()}
    assert got == pytest.approx({(int(a), int(b)): km[i, j] for i, a in enumerate(z) for j, b in enumerate(s)}, abs=2e-6)
    need = {r["zone"]: r["weight"] for r in registry.QUERIES["zone_demand"](spark, SF).collect()}
    w = np.array([need.get(int(a), 0.0) for a in z])
    cost = lambda sites: float(w @ km[:, np.isin(s, sites)].min(axis=1))
    assert registry.QUERIES["facility_assignment_cost"](spark, SF).first()["cost"] == pytest.approx(cost(s[s % 4 == 0]), rel=1e-8)
    rows = registry.QUERIES["facility_greedy"](spark, SF).collect()
    chosen = [r["site"] for r in rows]
    assert len(set(chosen)) == 10 and all(r["cost"] == pytest.approx(cost(chosen), rel=1e-8) for r in rows)
    for out in chosen:  # no swap with any supplier is better
        rest = [x for x in chosen if x != out]
        assert all(cost([*rest, int(x)]) >= cost(chosen) * (1 - 2e-9) for x in s)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_median_is_the_exhaustive_optimum_within_its_bound(spark, seed):
    rnd = random.Random(seed)
    zones = [(i, rnd.uniform(1, 9)) for i in range(12)]
    places = [(rnd.random(), rnd.random()) for _ in zones]
    sites = [(rnd.random(), rnd.random()) for _ in range(9)]
    km = [(i, 100 + j, math.dist(a, b)) for i, a in enumerate(places) for j, b in enumerate(sites)]
    need, table = spark.createDataFrame(zones, "zone long, weight double"), spark.createDataFrame(km, "zone long, site long, km double")
    far = {(i, j): d for i, j, d in km}
    cost = lambda chosen: sum(w * min(far[i, j] for j in chosen) for i, w in zones)
    best = min(map(cost, itertools.combinations(range(100, 109), 3)))
    found = facility.p_median(need, table, p=3, gap=0.001, rounds=60)
    assert found.cost == pytest.approx(cost(found.sites)) and found.lower <= best * (1 + 1e-9)
    assert found.cost == pytest.approx(best) and found.gap < 0.03
    swapped = facility._swap(facility._zone_site_costs(need, table), [100, 101, 102])
    assert swapped[2] == pytest.approx(min(cost([*(s for s in (100, 101, 102) if s != o), j]) for o in (100, 101, 102) for j in range(103, 109)))


def test_no_zones_no_sites_and_one_site(spark):
    need, table = spark.createDataFrame([], "zone long, weight double"), spark.createDataFrame([], "zone long, site long, km double")
    assert facility.p_median(need, table, 2) == ([], 0.0, 0.0, 0)
    one = facility.p_median(spark.createDataFrame([(1, 2.0)], "zone long, weight double"), spark.createDataFrame([(1, 5, 3.0), (1, 6, 2.0)], "zone long, site long, km double"), 1)
    assert (one.sites, one.cost) == ([6], 4.0) and one.gap <= 0.01


def test_one_site_a_place(spark):
    """Copies of a site change neither choice nor bound: without the copies of a place the bound is the one of single sites."""
    rnd = random.Random(9)
    spots = [(float(rnd.randrange(20, 70)), float(rnd.randrange(-120, -20))) for _ in range(14)]
    zones = spark.createDataFrame([(i, rnd.uniform(20, 70), rnd.uniform(-120, -20)) for i in range(8)], "zone long, lat double, lon double")
    need = spark.createDataFrame([(i, 1.0 + i) for i in range(8)], "zone long, weight double")
    once = spark.createDataFrame([(100 + i, *s) for i, s in enumerate(spots)], "site long, lat double, lon double")
    often = spark.createDataFrame([(100 + 14 * c + i, *s) for c in range(30) for i, s in enumerate(spots)], "site long, lat double, lon double")
    assert sorted(facility.places(often, 3).collect()) == sorted(once.collect())
    a, b = (facility.p_median(need, facility.distance_table(zones, facility.places(x, 3)), 3) for x in (once, often))
    assert a == b and b.gap <= 0.05
    # fewer places than sites are wanted: copies fill up the choice
    assert facility.places(often.where("site % 14 < 2"), 3).count() == 6


def test_gap_of_the_suppliers_is_at_most_a_hundredth(spark):
    rows = registry.QUERIES["facility_median"](spark, SF).collect()
    km, z, s = brute_km()
    need = {r["zone"]: r["weight"] for r in registry.QUERIES["zone_demand"](spark, SF).collect()}
    w = np.array([need.get(int(a), 0.0) for a in z])
    assert len(rows) == 10 and rows[0]["cost"] == pytest.approx(float(w @ km[:, np.isin(s, [r["site"] for r in rows])].min(axis=1)), rel=1e-8)
    assert 0 <= rows[0]["gap"] <= 0.01 and rows[0]["lower_bound"] <= rows[0]["cost"]
