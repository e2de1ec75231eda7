"""Exact nearest neighbours that look at a small share of all pairs.

A distance that is told column by column (:class:`Metric`) has lower bounds:
between a record and a block of records, no pair is nearer than the gap to the
block's box of numbers and the lowest level at which the block's sets of
categories meet the record's own. Candidates are laid out along a curve that
interleaves all columns, cut into regions and these into blocks of
``BLOCK_ROWS``. A query record is compared

1. with the nearest block of its own region: the ``k``-th distance found there
   bounds the ``k``-th of all;
2. with every further block whose lower bound is within that bound. Regions
   are ruled out first, for all records of a query region together, then for
   each record, then the blocks of the regions that are left.

What is skipped cannot be among the ``k`` nearest, whatever the data is; the
layout only decides how much is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distance as D
from .stages import staged

#: Candidates of a block, and regions at most (the bound of what is broadcast).
BLOCK_ROWS, REGIONS = 256, 4096
#: Room for rounding when unrounded distances are compared with a bound.
ROOM = 1e-8
#: Bits of the curve; below them a hash spreads records that agree in all of these.
BITS, TIE_BITS = 45, 15


def _hash(value: Column, bits: int) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit((1 << bits) - 1))


@dataclass(frozen=True)
class Number:
    """``|x - y|`` over the width of the domain."""

    name: str
    width: float
    weight: float = 1.0

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.name,)

    def distance(self) -> Column:
        return D.numeric(F.col(f"q_{self.name}"), F.col(f"c_{self.name}"), self.width)

    def coordinate(self, side: str, bits: int) -> Column:
        return F.pmod(F.floor(F.col(f"{side}_{self.name}") / F.lit(float(self.width)) * ((1 << bits) - 1)), F.lit(1 << bits))

    def effects(self, bits: int) -> list[float]:
        """Distance that each bit of the coordinate decides, from the highest on."""
        return [0.5 ** (b + 1) for b in range(bits)]

    def summary(self, side: str) -> list[Column]:
        x = F.col(f"{side}_{self.name}")
        return [F.min(x).cast("double"), F.max(x).cast("double")]

    def merged(self) -> list[Callable[[Column], Column]]:
        return [F.min, F.max]

    def of_row(self, side: str) -> list[Column]:
        return [F.col(f"{side}_{self.name}").cast("double")] * 2

    def bound(self, q: list[Column], c: list[Column], row: bool) -> Column:
        gap = F.greatest(c[0] - q[1], q[0] - c[1], F.lit(0.0)) / F.lit(float(self.width))
        return F.coalesce(gap, F.lit(0.0))


@dataclass(frozen=True)
class Category:
    """Leaves by their ancestors: ``levels`` gives their columns for a side, leaf first and without the root."""

    keys: tuple[str, ...]
    levels: Callable[[str], Sequence[Column]]
    weight: float = 1.0

    def distance(self) -> Column:
        root = F.lit("*")
        return D.edge([*self.levels("q"), root], [*self.levels("c"), root])

    def coordinate(self, side: str, bits: int) -> Column:
        levels = list(self.levels(side))[::-1]
        own, out = max(1, bits // len(levels)), F.lit(0).cast("long")
        for i, level in enumerate(levels):
            n = own if i < len(levels) - 1 else max(bits - own * (len(levels) - 1), 1)
            out = F.shiftleft(out, n).bitwiseOR(_hash(level, n))
        return out

    def effects(self, bits: int) -> list[float]:
        n = len(self.levels("q"))
        own = max(1, bits // n)
        return [1 - min(b // own, n - 1) / n for b in range(bits)]

    def summary(self, side: str) -> list[Column]:
        return [F.collect_set(level) for level in self.levels(side)]

    def merged(self) -> list[Callable[[Column], Column]]:
        return [lambda c: F.array_distinct(F.flatten(F.collect_list(c)))] * len(self.levels("c"))

    def of_row(self, side: str) -> list[Column]:
        return list(self.levels(side))

    def bound(self, q: list[Column], c: list[Column], row: bool) -> Column:
        edges, out = 2 * len(q), F.lit(1.0)  # two each from the leaf to the root
        for m in range(len(q) - 1, -1, -1):
            meet = F.array_contains(c[m], q[m]) if row else F.arrays_overlap(q[m], c[m])
            out = F.when(meet, F.lit(2.0 * m / edges)).otherwise(out)
        return out


@dataclass(frozen=True)
class Opaque:
    """Any other distance of ``q_*`` and ``c_*`` columns: never negative, not bounded."""

    keys: tuple[str, ...]
    value: Column
    weight: float = 1.0

    def distance(self) -> Column:
        return self.value

    def coordinate(self, side: str, bits: int) -> Column:
        return F.xxhash64(*[F.col(f"{side}_{k}") for k in self.keys]).bitwiseAND(F.lit((1 << bits) - 1))

    def effects(self, bits: int) -> list[float]:
        return [0.0] * bits

    def summary(self, side: str) -> list[Column]:
        return []

    def merged(self) -> list[Callable[[Column], Column]]:
        return []

    def of_row(self, side: str) -> list[Column]:
        return []

    def bound(self, q: list[Column], c: list[Column], row: bool) -> Column:
        return F.lit(0.0)


@dataclass(frozen=True)
class Metric:
    """Record distance over parts: the root of the weighted mean of squares."""

    parts: tuple[Number | Category | Opaque, ...] = field(default_factory=tuple)

    @property
    def keys(self) -> list[str]:
        return [k for p in self.parts for k in p.keys]

    def distance(self) -> Column:
        return D.record({str(i): p.distance() for i, p in enumerate(self.parts)}, {str(i): p.weight for i, p in enumerate(self.parts)})

    def laid(self, df: DataFrame, side: str) -> DataFrame:
        """``df`` with ``__z``: bits of all columns above a hash of the record.

        Bits are ordered by the distance that they decide: another branch of a
        category is farther than half of a number's domain, and that is as far
        as another leaf of two levels. What has no bound comes last.
        """
        bits = max(1, min(12, BITS // len(self.parts)))
        named = df.select("*", *[F.coalesce(p.coordinate(side, bits).cast("long"), F.lit(0)).alias(f"__x{i}") for i, p in enumerate(self.parts)])
        order = [(-p.weight**0.5 * e, b, i) for i, p in enumerate(self.parts) for b, e in enumerate(p.effects(bits))]
        terms = [f"shiftleft(shiftright(__x{i}, {bits - 1 - b}) & 1L, {len(order) - 1 - at})" for at, (_, b, i) in enumerate(sorted(order))]
        record = F.struct(*[F.col(f"{side}_{k}") for k in self.keys])
        z = F.shiftleft(F.expr(" | ".join(terms)), TIE_BITS).bitwiseOR(_hash(record, TIE_BITS)).alias("__z")
        return named.select(*df.columns, z)

    def summaries(self, side: str, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{i}_{j}") for i, p in enumerate(self.parts) for j, c in enumerate(p.summary(side))]

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}{i}_{j}" for i, p in enumerate(self.parts) for j in range(len(p.of_row("q")))]

    def bound(self, block: str, other: str | None = None) -> Column:
        """Least distance that a candidate in the block may have from a query row, or from any row of a query block."""
        total = F.lit(0.0)
        for i, p in enumerate(self.parts):
            n = len(p.of_row("q"))
            c = [F.col(f"{block}{i}_{j}") for j in range(n)]
            q = p.of_row("q") if other is None else [F.col(f"{other}{i}_{j}") for j in range(n)]
            b = p.bound(q, c, other is None)
            total = total + F.lit(float(p.weight)) * b * b
        return F.sqrt(total / len(self.parts))


def _cuts(df: DataFrame, rows: int) -> tuple[int, list[int]]:
    """Number of rows, and where the curve is cut into regions of about ``rows`` rows, ``REGIONS`` at most."""
    shares = ", ".join(f"{i / REGIONS!r}D" for i in range(1, REGIONS))  # as text: one call instead of thousands
    n, at = df.agg(F.count(F.lit(1)), F.expr(f"percentile_approx(__z, array({shares}), {4 * REGIONS})")).first()
    parts = min(REGIONS, -(-n // rows))
    if parts < 2:
        return n, []
    return n, sorted({at[round(i * REGIONS / parts) - 1] for i in range(1, parts)})


def _region(z: Column, cuts: list[int]) -> Column:
    """Number of cuts up to ``z``, by binary search."""
    if not cuts:
        return F.lit(0)
    table, steps, width = F.expr(f"array({', '.join(f'{c}L' for c in cuts)})"), [], 1
    while width <= len(cuts):
        steps.insert(0, width)
        width *= 2
    move = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= z), at + step).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), move)


class Index:
    """Candidates in regions and blocks, with the summaries of both.

    A region is one block, unless there are more than ``REGIONS`` blocks.
    """

    def __init__(self, cand: DataFrame, metric: Metric) -> None:
        laid = staged(metric.laid(cand, "c"), "curve")
        self.metric = metric
        self.size, self.cuts = _cuts(laid, BLOCK_ROWS)
        rows = laid.withColumn("__region", _region(F.col("__z"), self.cuts).cast("long"))
        #: blocks of a region
        self.parts = max(1, -(-self.size // (BLOCK_ROWS * (len(self.cuts) + 1))) // 2)
        if self.parts > 1:
            edges = rows.groupBy("__region").agg(F.percentile_approx("__z", [i / self.parts for i in range(1, self.parts)], 4 * self.parts).alias("__edges"))
            rows = rows.join(F.broadcast(edges), "__region")  # REGIONS rows at most
            inner = F.size(F.filter("__edges", lambda e: e <= F.col("__z")))
            rows = staged(rows.select(*cand.columns, "__region", (F.shiftleft("__region", 32) + inner).alias("__block")), "blocked")
            self.blocks = staged(rows.groupBy("__region", "__block").agg(*metric.summaries("c", "b")), "blocks")
        else:
            self.blocks = None
        self.rows = rows.select(*cand.columns, "__region", F.col("__block" if self.parts > 1 else "__region").alias("__block"))

    def regions(self) -> DataFrame:
        """``__cregion`` and its summary."""
        if self.blocks is None:
            return self.rows.groupBy(F.col("__region").alias("__cregion")).agg(*self.metric.summaries("c", "r"))
        merged = [m(F.col(f"b{i}_{j}")).alias(f"r{i}_{j}") for i, p in enumerate(self.metric.parts) for j, m in enumerate(p.merged())]
        return self.blocks.groupBy(F.col("__region").alias("__cregion")).agg(*merged)


def visits(query: DataFrame, index: Index, k: int, apart: Column | None = None) -> DataFrame:
    """Query rows with ``__bound``, which their ``k``-th distance does not exceed, once for every ``__block`` that they must see."""
    metric = index.metric
    home = metric.laid(query, "q").select(*query.columns, _region(F.col("__z"), index.cuts).cast("long").alias("__home"))
    if index.blocks is None:
        own = home.withColumn("__block", F.col("__home"))
    else:
        # the nearest block of the region
        home = staged(home.withColumn("__q", F.monotonically_increasing_id()), "queries")
        best = home.join(index.blocks, F.col("__home") == F.col("__region")).groupBy("__q").agg(F.min_by("__block", F.struct(metric.bound("b"), "__block")).alias("__block"))
        own = home.join(best, "__q", "left").drop("__q")
    first = own.join(index.rows.drop("__region"), "__block", "left")
    distance = metric.distance() if apart is None else F.when(apart, metric.distance())
    # of a block's rows at most
    kth = F.min(distance) if k == 1 else F.get(F.sort_array(F.collect_list(distance)), F.lit(k - 1))
    rows = staged(first.groupBy(*query.columns, "__home").agg((kth + ROOM).alias("__bound")), "bounded")

    far = F.coalesce("__bound", F.lit(float("inf")))
    asking = rows.groupBy("__home").agg(F.max(far).alias("__most"), *metric.summaries("q", "a"))
    # REGIONS rows at most on either side
    near = asking.join(F.broadcast(index.regions()), metric.bound("r", "a") <= F.col("__most")).select("__home", "__cregion", *metric.names("r"))
    some = rows.join(near, "__home").where(metric.bound("r") <= far).select(*rows.columns, F.col("__cregion").alias("__region"))
    if index.blocks is None:
        return some.select(*query.columns, "__bound", F.col("__region").alias("__block"))
    return some.join(index.blocks, "__region").where(metric.bound("b") <= far).select(*query.columns, "__bound", "__block")


def near_pairs(query: DataFrame, cand: DataFrame, metric: Metric, k: int = 1, apart: Column | None = None) -> DataFrame:
    """``q_*``, ``c_*`` and ``dist`` of all pairs that may be among a query row's ``k`` nearest, and few others.

    ``apart`` says which pairs count at all; each candidate row counts once.
    """
    index = Index(cand, metric)
    met = visits(query, index, k, apart).join(index.rows.drop("__region"), "__block").drop("__block")
    if apart is not None:
        met = met.where(apart)
    met = met.withColumn("dist", metric.distance())
    return met.where(F.col("__bound").isNull() | (F.col("dist") <= F.col("__bound"))).select(*query.columns, *cand.columns, "dist")
