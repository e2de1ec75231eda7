"""The best node of the lattice without a look at all of them.

Two facts cut the search. A row never loses less when an attribute climbs, and
a node's mean and greatest shares of leaves follow from value counts alone: they
bound its loss from below. And a row that is suppressed at a node is suppressed
at every node below it, where it loses at least the difference to the greatest
share more: each node that was looked at raises the bounds of those. A round
looks at some nodes in the middle of what is left: a good one cuts what lies
above, one with much suppression what lies below. The classes of a node are
summed up from those of the smallest finished node below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .generalize import BROADCAST_LEAVES, distinct_combinations, small
from .hierarchy import Hierarchy
from .stages import release, staged

#: Nodes that a round looks at, and nodes of a lattice at most: the driver holds two numbers and the levels of each.
BATCH, NODES = 24, 5_000_000
#: Room for rounding when bounds are compared with losses.
ROOM = 1e-9


class Found(NamedTuple):
    vector: dict[str, int]
    loss: float
    n_suppressed: int
    #: nodes whose classes were made, of how many
    evaluated: int
    nodes: int


def _climbing(combos: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str]) -> DataFrame:
    """Combinations with ``up_<i>``: node and share of the domain's leaves on every level of attribute ``i``."""
    out = combos
    for i, a in enumerate(qid):
        h, width = hierarchies[a], max(hierarchies[a].size - 1, 1)
        frame = h.frame
        for level in h.levels:
            leaves = frame.groupBy(F.col(level).alias("__n")).agg(F.countDistinct("l0").alias(f"__{level}"))
            leaves = small(leaves, BROADCAST_LEAVES, h.size)
            frame = frame.join(leaves, frame[level] == leaves["__n"]).drop("__n")
        up = F.array(*[F.struct(F.col(level).alias("node"), ((F.col(f"__{level}") - 1) / F.lit(width)).alias("share")) for level in h.levels])
        look = small(frame.select(F.col("l0").alias("__leaf"), up.alias(f"up_{i}")), BROADCAST_LEAVES, h.size)
        out = out.join(look, out[a].cast("string") == look["__leaf"]).drop("__leaf")
    return out.select("n", *[f"up_{i}" for i in range(len(qid))])


def _shares(base: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str]) -> list[list[tuple[float, float]]]:
    """Mean and greatest share of every level of every attribute, from one pass."""
    total, each = F.sum("n"), []
    for i, a in enumerate(qid):
        for level in range(hierarchies[a].depth):
            share = F.col(f"up_{i}")[level]["share"]
            each += [F.coalesce(F.sum(share * F.col("n")) / total, F.lit(0.0)), F.coalesce(F.max(share), F.lit(0.0))]
    row = list(base.agg(*[c.alias(f"s{i}") for i, c in enumerate(each)]).first())
    out, at = [], 0
    for a in qid:
        depth = hierarchies[a].depth
        out.append([(row[at + 2 * level], row[at + 2 * level + 1]) for level in range(depth)])
        at += 2 * depth
    return out


def best_node(df: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], k: int, balance: float = 0.5, batch: int | None = None) -> Found:
    """The level vector of least loss (see ``generalize.information_loss``); of equal ones the first by name.

    Rows with a value that its hierarchy lacks are left out, as in the sweep.
    """
    qid, batch = list(qid), batch or BATCH
    depths = [hierarchies[a].depth for a in qid]
    if np.prod(depths, dtype=float) > NODES:
        raise ValueError(f"a lattice of more than {NODES} nodes")
    hidden, shown = min(1.0, 2 * balance), min(1.0, 2 - 2 * balance)
    base = staged(_climbing(distinct_combinations(df, qid), hierarchies, qid).withColumn("node", F.lit(-1)), "lattice")
    levels = np.array(list(product(*[range(d) for d in depths])))
    names = ["_".join(map(str, v)) for v in levels.tolist()]
    share, most = (sum(np.array(s)[levels[:, i]] for i, s in enumerate(_shares(base, hierarchies, qid))) / len(qid)).T
    # what a suppressed row adds at least to the loss that it would have if it stayed
    more = hidden - shown * most

    def least(lost: float, at: np.ndarray | slice) -> np.ndarray:
        """No node loses less of which this share of the rows is suppressed at least."""
        return shown * share[at] + np.where(more[at] >= 0, lost * more[at], more[at])

    bound = np.maximum(min(hidden, shown) * share, least(0.0, slice(None)))
    size, rows = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not rows:
        return Found(dict.fromkeys(qid, 0), 0.0, 0, 0, len(levels))
    #: finished nodes: number of classes, and the table that holds them
    done: dict[int, tuple[int, DataFrame]] = {-1: (size, base)}
    tables, lost = [base], {}
    best, best_at = float("inf"), -1
    open_ = np.ones(len(levels), bool)
    height = levels.sum(axis=1)
    while True:
        left = np.flatnonzero(open_ & (bound <= best + ROOM))
        if not len(left):
            break
        # the middle of what is left, the most promising first
        middle = np.median(height[left])
        order = np.lexsort((bound[left], np.abs(height[left] - middle)))
        chosen = left[order[:batch]].tolist()
        start: dict[int, list[int]] = {}
        for v in chosen:
            below = [u for u in done if u < 0 or (levels[u] <= levels[v]).all()]
            start.setdefault(min(below, key=lambda u: (done[u][0], u)), []).append(v)
        parts = []
        for table in {id(done[u][1]): done[u][1] for u in start}.values():
            own = {u: vs for u, vs in start.items() if done[u][1] is table}
            steps = df.sparkSession.createDataFrame([(u, v, [int(x) for x in levels[v]]) for u, vs in own.items() for v in vs], "node int, target int, at array<int>")
            parts.append(table.where(F.col("node").isin(list(own))).join(F.broadcast(steps), "node").drop("node"))
        reached = parts[0]
        for part in parts[1:]:
            reached = reached.unionByName(part)
        keys = [F.get(f"up_{i}", F.get("at", F.lit(i)))["node"].alias(f"k_{i}") for i in range(len(qid))]
        grouped = reached.groupBy(F.col("target").alias("node"), "at", *keys)
        classes = staged(grouped.agg(F.sum("n").alias("n"), *[F.first(f"up_{i}").alias(f"up_{i}") for i in range(len(qid))]), "lattice")
        tables.append(classes)
        mean = sum((F.get(f"up_{i}", F.get("at", F.lit(i)))["share"] for i in range(len(qid))), F.lit(0.0)) / len(qid)
        loss = F.when(F.col("n") < k, hidden).otherwise(mean * shown) * F.col("n")
        classes_ = classes.select("node", *[f"up_{i}" for i in range(len(qid))], "n")
        seen = classes.groupBy("node").agg((F.sum(loss) / rows).alias("loss"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("lost"), F.count(F.lit(1)).alias("size")).collect()
        for r in seen:
            v = r["node"]
            open_[v], lost[v], done[v] = False, r["lost"], (r["size"], classes_)
            if r["loss"] < best - ROOM or (r["loss"] <= best + ROOM and (best_at < 0 or names[v] < names[best_at])):
                best, best_at = min(best, r["loss"]), v
            below = np.flatnonzero(open_ & (levels <= levels[v]).all(axis=1))
            bound[below] = np.maximum(bound[below], least(r["lost"] / rows, below))
    release(*tables)
    return Found(dict(zip(qid, levels[best_at].tolist())), best, lost[best_at], len(done) - 1, len(levels))
