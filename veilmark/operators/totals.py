"""Sum, least and greatest distance of every record to all records of another table, without a look at every pair.

The squared distance is a sum over columns. Columns that few values describe
(categories, given distances) are told by tables of their values, and some of
them are taken together as the record's *kind*: between two kinds there are
few distances ``v``. What is left of a record, its *place* (numbers and the
other tables' values), repeats as well. With ``H_v`` the records of each place
whose kind is at ``v`` from a kind, and ``K_v = sqrt((places' part + v) / m)``
between places, the totals of all kinds are the sum of the products ``K_v H_v``:
the work follows distinct places, not pairs of records.

The least and the greatest follow from the same ``H_v``: among places that
differ in one number only, the nearest ones below and above, and the two at the
ends. Places are dealt to blocks in order, and each pair of blocks is one
task's work. Where places hardly repeat, all pairs of distinct records are
looked at in the grid of ``knn``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn
from .pruned import Metric, Number
from .stages import release, staged

# executors need not have this package: what tasks use of this module travels with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distances of a column's table at most; distances times pairs of kinds, and kinds of a side at most.
TABLE, KINDS, SIDE = 1 << 20, 1 << 22, 1024
#: Places of a block of queries and of candidates at most, query places that are compared at a time, and numbers that tell a block of candidates.
QUERY_PLACES, CAND_PLACES, SLICE, HELD = 4096, 8192, 256, 1 << 24
#: Rough nanoseconds: a pair in the grid; a pair of places, more for a kind; a record against the places along one number.
PAIR, PLACE, KIND, EXTREME = 500.0, 10.0, 0.2, 50.0
#: Pairs of blocks at least, if there are as many slices, and tasks at most.
CELLS, MOST_TASKS = 64, 2000


@dataclass(frozen=True)
class _Plan:
    """``step``: kinds' distance, as an index of ``values`` (-1: none); ``tables``: squared distances of the places' codes; ``scales``: of the places' numbers, the searched one last."""

    step: np.ndarray
    values: np.ndarray
    tables: tuple[np.ndarray, ...]
    scales: tuple[float, ...]
    parts: int

    def apart(self, q: np.ndarray, c: np.ndarray, oq: Sequence[np.ndarray], oc: Sequence[np.ndarray], numbers: int) -> np.ndarray:
        """Squared distances between places over the tables and the first ``numbers`` numbers."""
        out = np.zeros((len(q), len(c)))
        for k in range(numbers):
            z = q[:, k, None] - c[None, :, k]
            z *= z
            z *= self.scales[k]
            out += z
        for t, i, j in zip(self.tables, oq, oc, strict=True):
            out += t[i[:, None], j[None, :]]
        return out


def _codes(o: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    out = []
    for n in sizes[::-1]:
        out.append(o % n)
        o = o // n
    return out[::-1]


def _cell(plan: _Plan, q: np.ndarray, oq: np.ndarray, row: np.ndarray, kind: np.ndarray, c: np.ndarray, oc: np.ndarray, at: np.ndarray, own: np.ndarray, n: np.ndarray):
    """Totals, least and greatest distances of records (place ``row``, ``kind``) to ``n`` candidates each of places ``at`` and kinds ``own``."""
    last = len(plan.scales) - 1
    order = np.lexsort((*c.T[::-1], oc))
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    c, oc, at = c[order], oc[order], place[at]
    held = np.zeros((len(c), plan.step.shape[1]))
    np.add.at(held, (at, own), n)
    cq, cc = (_codes(o, [t.shape[i] for t in plan.tables]) for i, o in ((0, oq), (1, oc)))
    same = (oc[1:] == oc[:-1]) & (c[1:, :last] == c[:-1, :last]).all(axis=1)
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(c)]])
    heads = starts[:-1]
    outer = plan.apart(q, c[heads], cq, [i[heads] for i in cc], last)
    total, least, most = np.zeros((len(q), plan.step.shape[0])), np.full(len(row), np.inf), np.full(len(row), -np.inf)
    x, y, scale = q[:, last], c[:, last], plan.scales[last]
    at_v = [held @ (plan.step == v).T.astype(float) for v in range(len(plan.values))]
    for s in range(0, len(q), SLICE):
        squared = plan.apart(q[s : s + SLICE], c, [i[s : s + SLICE] for i in cq], cc, last + 1)
        none = np.isnan(squared) if any(np.isnan(t).any() for t in plan.tables) else None
        for h, value in zip(at_v, plan.values, strict=True):
            k = squared + value
            np.sqrt(k, out=k)
            if none is not None:
                k[none] = 0.0
            total[s : s + SLICE] += k @ h
    total /= math.sqrt(plan.parts)
    for h, value in zip(at_v, plan.values, strict=True):
        for g, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            there = h[a:b] > 0
            if not there.any():
                continue
            line, edge = y[a:b], np.full((1, there.shape[1]), np.inf)
            below = np.maximum.accumulate(np.vstack([-edge, np.where(there, line[:, None], -np.inf)]), axis=0)
            above = np.minimum.accumulate(np.vstack([np.where(there, line[:, None], np.inf), edge])[::-1], axis=0)[::-1]
            pos = np.searchsorted(line, x, side="right")[row]
            z = x[row]
            near = np.minimum(z - below[pos, kind], above[pos, kind] - z)
            far = np.maximum(z - above[0, kind], below[-1, kind] - z)
            rest = outer[row, g] + value
            least = np.fmin(least, rest + scale * near * near)
            most = np.fmax(most, np.where(far > -np.inf, rest + scale * far * far, -np.inf))
    found = np.isfinite(least)
    root = lambda d: np.sqrt(np.where(found, d, 0.0) / plan.parts)
    return total[row, kind], root(least), root(most), found


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """A row's number for every element of a column of lists, and all elements."""
    lists = t.column(name).combine_chunks()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _table(part, q: DataFrame, c: DataFrame):
    """Codes of a part's values on both sides and its squared, weighted distances (NaN: none), or None where there are too many."""
    sides = []
    for df, side in ((q, "q"), (c, "c")):
        values = df.select(*part.keys).distinct().limit(TABLE + 1).coalesce(1)
        sides.append(staged(_renamed(values, side).withColumn(f"__{side}", F.monotonically_increasing_id()), "values"))
    n, m = (s.count() for s in sides)
    if n * m > TABLE:
        return None
    d = part.distance()
    pdf = sides[0].crossJoin(F.broadcast(sides[1])).select("__q", "__c", (F.lit(float(part.weight)) * d * d).alias("d")).toPandas()
    out = np.full((n, m), np.nan)
    out[pdf["__q"].to_numpy(np.int64), pdf["__c"].to_numpy(np.int64)] = pdf["d"].to_numpy(float)
    return (*sides, out)


def _grid(q: DataFrame, c: DataFrame, metric: Metric) -> DataFrame:
    d = metric.distance()
    p = knn.pairs(q, c).groupBy(*[f"q_{k}" for k in metric.keys])
    return p.agg(F.sum(d * F.col("c_n")).alias("total"), F.min(d).alias("least"), F.max(d).alias("most"))


def summary(query: DataFrame, cand: DataFrame, metric: Metric) -> DataFrame:
    """``(q_keys, total, least, most)`` of every distinct record of ``query``: distances to all rows of ``cand``.

    Pairs without a distance count in none of the three, which are null where
    there is no other; without any row in ``cand`` there is no result.
    """
    keys = list(metric.keys)
    q = staged(query.select(*keys).distinct(), "queries")
    c = staged(cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "candidates")
    numbers = [p for p in metric.parts if isinstance(p, Number)]
    found = _factored(q, c, metric, numbers, [p for p in metric.parts if not isinstance(p, Number)])
    return _grid(q, c, metric) if found is None else found


def _factored(q: DataFrame, c: DataFrame, metric: Metric, numbers: list[Number], others: list) -> DataFrame | None:
    """:func:`summary` by kinds and places, or None where that is no gain."""
    xs = [F.col(p.name).cast("double") for p in numbers]
    odd = F.lit(False)
    for x in xs:
        odd = odd | F.coalesce(F.isnan(x) | (F.abs(x) == math.inf), F.lit(False))
    counts = [df.agg(F.count(F.lit(1)), F.count_if(odd), *[F.approx_count_distinct(x) for x in xs]).first() for df in (q, c)]
    if counts[0][1] or counts[1][1] or not counts[0][0] or not counts[1][0] or any(not p.width > 0 for p in numbers):
        return None
    tables = [(p, _table(p, q, c)) for p in others]
    if any(t is None for _, t in tables):
        return None
    tables.sort(key=lambda t: t[1][2].size)

    # kinds: as many tables as there is room for, the smallest first
    kinds, apart = 0, np.zeros((1, 1))
    for _, (*_, d) in tables:
        wider = (apart[:, None, :, None] + d[None, :, None, :]).reshape(apart.shape[0] * d.shape[0], -1) if max(apart.shape[0] * d.shape[0], apart.shape[1] * d.shape[1]) <= SIDE else None
        if wider is None or wider.size * len(np.unique(wider[~np.isnan(wider)])) > KINDS:
            break
        kinds, apart = kinds + 1, wider
    if math.prod(max(t[1][2].shape) for t in tables[kinds:]) > 1 << 62:  # a place's tables are told by one number
        return None
    values = np.unique(apart[~np.isnan(apart)])
    step = np.where(np.isnan(apart), -1, np.searchsorted(values, apart))
    searched = sorted(range(len(numbers)), key=lambda i: (counts[1][2 + i], i))
    names = [f"__x{i}" for i in range(max(1, len(numbers)))]
    scales = tuple(numbers[i].weight / float(numbers[i].width) ** 2 for i in searched) or (1.0,)
    plan = _Plan(step, values, tuple(t[1][2] for t in tables[kinds:]), scales, len(metric.parts))

    coded = []
    for side, df, axis in (("q", q, 0), ("c", c, 1)):
        out = df
        for i, (p, t) in enumerate(tables):
            look = F.broadcast(t[axis].withColumnRenamed(f"__{side}", f"__t{i}"))  # TABLE rows at most
            same = F.lit(True)
            for k in p.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"{side}_{k}"))
            out = out.join(look, same).drop(*[f"{side}_{k}" for k in p.keys])
        radix = lambda of: _radix([(f"__t{i}", t[2].shape[axis]) for i, (_, t) in of])
        every = list(enumerate(tables))
        out = out.withColumn("__a", radix(every[:kinds]).cast("int")).withColumn("__o", radix(every[kinds:]))
        for name, i in zip(names, searched or [None], strict=True):
            out = out.withColumn(name, F.lit(0.0) if i is None else xs[i] + F.lit(0.0))
        coded.append(out.drop(*[f"__t{i}" for i, _ in every]))
    # a record without one of its numbers is at no distance
    whole = [df.dropna(subset=names) for df in coded]
    place = ["__o", *names]
    packed = [
        staged(whole[0].groupBy(*place).agg(F.collect_list("__a").alias("__of")), "places"),
        staged(whole[1].groupBy(*place).agg(F.collect_list(F.struct("__a", "n")).alias("__of")), "places"),
    ]
    sizes = [p.count() for p in packed]
    lines = packed[1].select(*place[:-1]).distinct().count()
    work = len(values) * (sizes[0] * sizes[1] * (PLACE + KIND * step.shape[0]) + counts[0][0] * lines * EXTREME)
    if work > PAIR * counts[0][0] * counts[1][0]:
        return None
    cols = max(1, -(-sizes[1] // max(16, min(CAND_PLACES, HELD // max(1, len(values) * step.shape[0])))))
    rows = max(1, -(-sizes[0] // QUERY_PLACES), min(-(-sizes[0] // SLICE), -(-CELLS // cols)))
    blocks = [rows, cols]
    ranged = [staged(p.repartitionByRange(n, *place).withColumn("__block", F.spark_partition_id()), "blocks") for p, n in zip(packed, blocks, strict=True)]
    release(*packed)
    cells = blocks[0] * blocks[1]
    tasks = min(4 * cells, MOST_TASKS) if cells > 1 else 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ranged[0].withColumn("__other", each(blocks[1])).withColumn("__cell", F.col("__block") * blocks[1] + F.col("__other"))
    right = ranged[1].withColumn("__other", each(blocks[0])).withColumn("__cell", F.col("__other") * blocks[1] + F.col("__block"))
    # an explicit number of partitions is not merged again
    left, right = (d.select("__cell", *place, "__of").repartition(tasks, "__cell").groupBy("__cell") for d in (left, right))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in fields})
        (row, kind), (at, of) = _lists(a, "__of"), _lists(b, "__of")
        x, y = (np.stack([_column(t, n) for n in names], axis=1) for t in (a, b))
        o, kind = _column(a, "__o"), kind.to_numpy()
        total, least, most, ok = _cell(plan, x, o, row, kind, y, _column(b, "__o"), at, of.field("__a").to_numpy(), of.field("n").to_numpy().astype(float))
        columns = {"__o": o[row], **{n: x[row, i] for i, n in enumerate(names)}, "__a": kind, "total": total, "least": least, "most": most}
        return pa.table({n: pa.array(columns[n][ok], t) for n, t in fields})

    fields = [("__o", pa.int64()), *[(n, pa.float64()) for n in names], ("__a", pa.int32()), *[(n, pa.float64()) for n in ("total", "least", "most")]]
    schema = ", ".join(f"{n} {'int' if n == '__a' else 'long' if n == '__o' else 'double'}" for n, _ in fields)
    own = left.cogroup(right).applyInArrow(run, schema).groupBy(*place, "__a").agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return coded[0].join(own, [*place, "__a"], "left").select(*[F.col(k).alias(f"q_{k}") for k in metric.keys], "total", "least", "most")


def _radix(codes: Sequence[tuple[str, int]]):
    """One number for codes of the given ranges."""
    out = F.lit(0).cast("long")
    for name, n in codes:
        out = out * n + F.col(name)
    return out
