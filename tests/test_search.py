"""Search of the lattice by bounds: the sweep's optimum from a part of the nodes."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from veilmark.operators import generalize, search
from veilmark.operators.hierarchy import Hierarchy


def ladder(spark, name, leaves, widths):
    """Leaves 0.., one level a width, and the root."""
    rows = [(str(v), *[f"{w}:{v // w}" for w in widths], "*") for v in range(leaves)]
    return Hierarchy(name, spark.createDataFrame(rows, ", ".join(f"l{i} string" for i in range(len(widths) + 2))), len(widths) + 2, leaves)


def people(spark, seed, n, sizes):
    rnd = random.Random(seed)
    rows = [tuple(str(min(int(rnd.expovariate(3 / s)), s - 1)) for s in sizes) for _ in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"a{i} string" for i in range(len(sizes))))


@pytest.mark.parametrize(("seed", "balance", "k"), [(1, 0.5, 4), (2, 0.25, 3), (3, 0.8, 8), (4, 0.0, 3)])
def test_same_optimum_as_the_sweep(spark, seed, balance, k):
    sizes, qid = (12, 6, 8), ["a0", "a1", "a2"]
    h = {"a0": ladder(spark, "a0", 12, (2, 4)), "a1": ladder(spark, "a1", 6, (3,)), "a2": ladder(spark, "a2", 8, (2, 4))}
    df = people(spark, seed, 150, sizes)
    classes = generalize.lattice_classes(generalize.distinct_combinations(df, qid), h, qid)
    loss = {r["node"]: r["loss"] for r in generalize.information_loss(classes, h, qid, k, balance).collect()}
    least = min(loss.values())
    best = min(node for node, x in loss.items() if x <= least + 1e-9)
    for batch in (3, 24):
        found = search.best_node(df, h, qid, k, balance, batch)
        assert found.loss == pytest.approx(least) and "_".join(str(found.vector[a]) for a in qid) == best
        assert found.nodes == len(loss) and found.evaluated <= len(loss)
    lost = {r["node"]: r["n_suppressed"] for r in generalize.lattice_statistics(classes, k).collect()}
    assert found.n_suppressed == lost[best]


def test_eight_attributes_end_in_time(spark):
    steps = [(2, 4, 8), (2, 4, 8), (2,), (2,), (2,), (3,), (3,), (2, 4)]
    qid = [f"a{i}" for i in range(8)]
    sizes = (16, 16, 4, 4, 4, 6, 6, 8)
    h = {a: ladder(spark, a, s, w) for a, s, w in zip(qid, sizes, steps)}
    df = people(spark, 8, 800, sizes).persist()
    began = time.perf_counter()
    found = search.best_node(df, h, qid, 5, batch=400)
    assert found.nodes == 24_300 and found.evaluated < 0.3 * found.nodes
    assert time.perf_counter() - began < 240
    # the same loss by the release itself
    vector = "_".join(str(found.vector[a]) for a in qid)
    classes = generalize.lattice_classes(generalize.distinct_combinations(df, qid), h, qid, [found.vector])
    assert {r["node"]: r["loss"] for r in generalize.information_loss(classes, h, qid, 5).collect()} == {vector: pytest.approx(found.loss)}
    # no neighbour on the lattice is better
    near = [{**found.vector, a: found.vector[a] + step} for a in qid for step in (-1, 1) if 0 <= found.vector[a] + step < h[a].depth]
    classes = generalize.lattice_classes(generalize.distinct_combinations(df, qid), h, qid, near)
    wanted = {"_".join(str(v[a]) for a in qid) for v in near}
    assert all(r["loss"] >= found.loss - 1e-9 for r in generalize.information_loss(classes, h, qid, 5).where(F.col("node").isin(list(wanted))).collect())
    df.unpersist()


def test_no_rows_and_too_many_nodes(spark, monkeypatch):
    h = {"a0": ladder(spark, "a0", 4, (2,))}
    found = search.best_node(people(spark, 1, 1, (4,)).limit(0), h, ["a0"], 2)
    assert found.evaluated == 0 and found.loss == 0.0
    monkeypatch.setattr(search, "NODES", 2)
    with pytest.raises(ValueError):
        search.best_node(people(spark, 1, 5, (4,)), h, ["a0"], 2)
