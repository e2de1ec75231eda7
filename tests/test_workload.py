"""Bit-set evaluation of a workload against counting by hand, in batches of any size."""

from __future__ import annotations

import random

import pytest

from veilmark.operators import counts

LEAVES = {"a": "pqrst", "b": "uvw"}
NODES = {"a": {**{x: x for x in "pqrst"}, "PQ": "pq", "RST": "rst", "*": "pqrst"}, "b": {**{x: x for x in "uvw"}, "*": "uvw"}}


def made(spark, seed):
    rnd = random.Random(seed)
    combos = {(rnd.choice(list(NODES["a"])), rnd.choice([*NODES["b"], None, "unknown"])): rnd.randint(1, 9) for _ in range(25)}
    asked = {q: {c: set(rnd.sample(LEAVES[c], rnd.randint(1, len(LEAVES[c])))) for c in rnd.sample(["a", "b"], rnd.randint(1, 2))} for q in rnd.sample(range(500), 90)}
    filters = spark.createDataFrame([(q, c, x) for q, by in asked.items() for c, xs in by.items() for x in xs], "query_id long, column string, leaf string")
    nodes = spark.createDataFrame([(c, n, x) for c in NODES for n, xs in NODES[c].items() for x in xs], "column string, node string, leaf string")
    frame = spark.createDataFrame([(*k, n) for k, n in combos.items()], "a string, b string, n long").repartition(3)
    expected = {}
    for q, by in asked.items():
        total = 0.0
        for k, n in combos.items():
            p = 1.0
            for c, v in zip("ab", k):
                if c in by:
                    under = NODES[c].get(v, "")
                    p *= len(by[c] & set(under)) / len(under) if under else 0.0
            total += n * p
        expected[q] = total
    return frame, filters, nodes, expected


@pytest.mark.parametrize("table_bytes", [64 << 20, 200])
def test_estimates_match_counting_by_hand(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(counts, "TABLE_BYTES", table_bytes)
    frame, filters, nodes, expected = made(spark, table_bytes)
    got = counts.estimate(frame, ["a", "b"], filters, nodes).collect()
    assert len(got) == len(expected) and {r["query_id"]: r["estimate"] for r in got} == pytest.approx(expected)


def test_tasks_send_one_sum_a_query(spark):
    frame, filters, nodes, _ = made(spark, 3)
    shares = counts._shares(filters, nodes)
    asked = {c: {r[0] for r in filters.where(filters["column"] == c).select("query_id").collect()} for c in "ab"}
    ids = sorted(asked["a"] | asked["b"])
    many = frame.union(frame).union(frame).repartition(2)
    sums = counts._total(many, ["a", "b"], ids, counts._tables(shares, ["a", "b"], ids, asked))
    plan = sums._jdf.queryExecution().toString()
    assert sums.count() == len(ids) and "Join" not in plan


def test_no_queries_no_rows_and_unknown_columns(spark):
    frame, filters, nodes, expected = made(spark, 5)
    assert counts.estimate(frame, ["a", "b"], filters.limit(0), nodes).collect() == []
    empty = counts.estimate(frame.limit(0), ["a", "b"], filters, nodes).collect()
    assert {r["query_id"]: r["estimate"] for r in empty} == dict.fromkeys(expected, 0.0)
    with pytest.raises(ValueError):
        counts.estimate(frame.select("a", "n"), ["a"], filters, nodes)
