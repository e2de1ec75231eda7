"""Synthetic tables: independent marginals, trees and networks of conditional distributions, and correlated numbers.

Draws are inverse-distribution look-ups with seeded hashes, so a rerun gives
the same table. The look-up is an equality join: [0, 2**32) is cut into slots,
at least one for each value of a distribution; a value is entered in every slot
that its share touches, and a draw meets the few values of its own slot. Draws
are uniform, so no slot is hot, whatever the shares are; a frequent parent has
more slots. Deep generators are not part of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions.draws import SCALE, seeded
from veilmark.functions.normal import distribution, quantile

from .generalize import BROADCAST_LEAVES, small
from .stages import staged

#: Slots shared out among the distributions of a column by their rows, beside one a value.
SLOTS = 1024
#: Ranges of values that running totals are made of, and values that their bounds are chosen from.
CHUNKS, BOUND_SAMPLE = 64, 4096

Hook = Callable[[DataFrame], DataFrame]


def _chunk(counts: DataFrame) -> Column:
    """Which range of values a row lies in. Any bounds give the same totals, so a sample of values will do."""
    seen = sorted(r[0] for r in counts.select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(BOUND_SAMPLE).collect())
    bounds = sorted(set(seen[:: max(1, len(seen) // CHUNKS)]))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("value"))) if bounds else F.lit(0)


def _shares(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``(*keys, value, lo, end, slots)``: each value's part of [0, 2**32), in order of values, and the slots of its distribution."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    counts = counts.withColumn("chunk", _chunk(counts))
    chunks = counts.groupBy(*keys, "chunk").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("values"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = F.sum("sum").over(own.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
    slots = F.sum("values").over(own) + F.ceil(F.sum("sum").over(own) * SLOTS / total)
    placed = chunks.select(*keys, "chunk", before.alias("before"), F.sum("sum").over(own).alias("all"), slots.alias("slots"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "chunk")]
    both = counts.alias("c").join(placed.alias("p"), same).select(*[f"c.{k}" for k in (*keys, "value", "chunk", "n")], "before", "all", "slots")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = lambda n: F.ceil(n / F.col("all") * SCALE)
    return both.select(*keys, "value", edge(upto - F.col("n")).alias("lo"), edge(upto).alias("end"), "slots")


def _slot(u: Column) -> Column:
    return F.shiftright(u * F.col("slots"), 32)


def _entered(shares: DataFrame, key: Column) -> DataFrame:
    """``(key, value, lo, end, slots, slot)``: every value in each slot that its share touches."""
    touched = F.explode(F.sequence(_slot(F.col("lo")), _slot(F.col("end") - 1))).alias("slot")
    return shares.where("lo < end").select(key.alias("key"), "value", "lo", "end", "slots", touched)


def _found(drawn: DataFrame, entered: DataFrame, column: str) -> DataFrame:
    """``row.*`` and the value of each row's draw ``u`` in the distribution ``of``, whose slots are ``slots``; null where there is none."""
    look = small(entered.drop("slots"), BROADCAST_LEAVES)
    drawn = drawn.withColumn("at", _slot(F.col("u")))
    found = drawn.join(look, (drawn["of"] == look["key"]) & (drawn["at"] == look["slot"]) & (drawn["u"] >= look["lo"]) & (drawn["u"] < look["end"]), "left")
    return found.select("row.*", F.col("value").alias(column))


def _drawn(out: DataFrame, df: DataFrame, column: str, parent: str | None, seed: int) -> DataFrame:
    """``out`` with ``column`` drawn from its distribution in ``df``, given the value of ``parent``; null where there is none."""
    key = F.lit(0) if parent is None else F.col(parent)
    entered = staged(_entered(_shares(df, [parent] if parent else [], column), key), "shares")
    sizes = small(entered.select("key", "slots").distinct(), BROADCAST_LEAVES)
    drawn = out.select(F.struct(*out.columns).alias("row"), key.alias("of"), seeded(F.col("rid"), column, seed).alias("u"))
    return _found(drawn.join(sizes, drawn["of"] == sizes["key"], "left").drop("key"), entered, column)


def _drawn_given(out: DataFrame, df: DataFrame, column: str, parents: Sequence[str], seed: int) -> DataFrame:
    """``out`` with ``column`` drawn given all of ``parents``.

    A combination of parents that ``df`` does not hold backs off to the
    parents without the last one, and so on to the column alone.
    """
    key = lambda j: F.array(F.lit(str(j)), *[F.coalesce(F.col(p).cast("string"), F.lit("\0")) for p in parents[:j]])
    entered = None
    for j in range(len(parents) + 1):
        own = _entered(_shares(df, list(parents[:j]), column), key(j))
        entered = own if entered is None else entered.unionByName(own)
    entered = staged(entered, "shares")
    sizes = small(entered.select("key", "slots").distinct(), BROADCAST_LEAVES)
    drawn = out.select(F.struct(*out.columns).alias("row"), seeded(F.col("rid"), column, seed).alias("u"), *[key(j).alias(f"of_{j}") for j in range(len(parents) + 1)])
    for j in range(len(parents), -1, -1):
        level = sizes.select(F.col("key").alias(f"key_{j}"), F.col("slots").alias(f"slots_{j}"))
        drawn = drawn.join(level, drawn[f"of_{j}"] == level[f"key_{j}"], "left")
    deepest = range(len(parents), -1, -1)
    of = F.coalesce(*[F.when(F.col(f"slots_{j}").isNotNull(), F.col(f"of_{j}")) for j in deepest])
    return _found(drawn.select("row", "u", of.alias("of"), F.coalesce(*[F.col(f"slots_{j}") for j in deepest]).alias("slots")), entered, column)


def marginals(spark: SparkSession, df: DataFrame, columns: Sequence[str], n: int, seed: int = 0, post: Hook | None = None) -> DataFrame:
    """``n`` rows whose columns follow the observed distributions, independently.

    ``post`` is applied to the drawn table, such as to derive a column from
    others. A column without values is null.
    """
    return tree(spark, df, dict.fromkeys(columns), n, seed, post)


def tree(spark: SparkSession, df: DataFrame, parents: dict[str, str | None], n: int, seed: int = 0, post: Hook | None = None) -> DataFrame:
    """``n`` rows drawn along a tree: each column given its parent's value. Parents come before children; ``post`` as for :func:`marginals`."""
    out = spark.range(n).withColumnRenamed("id", "rid")
    for c, parent in parents.items():
        out = _drawn(out, df, c, parent, seed)
    return post(out) if post else out


def network(spark: SparkSession, df: DataFrame, parents: Mapping[str, Sequence[str]], n: int, seed: int = 0, post: Hook | None = None) -> DataFrame:
    """``n`` rows drawn along a directed network: each column given all its parents, ancestors first.

    The order of a column's parents is that in which they back off, the last
    one first; ``post`` as for :func:`marginals`.
    """
    out = spark.range(n).withColumnRenamed("id", "rid")
    for c in ancestors_first(parents):
        out = _drawn_given(out, df, c, list(parents[c]), seed)
    out = out.select("rid", *parents)
    return post(out) if post else out


def ancestors_first(parents: Mapping[str, Sequence[str]]) -> list[str]:
    """The columns in an order that puts parents before children."""
    order: list[str] = []
    while len(order) < len(parents):
        free = [c for c, up in parents.items() if c not in order and set(up) <= set(order)]
        if not free:
            raise ValueError(f"a cycle, or a parent that is no column, among {sorted(set(parents) - set(order))}")
        order += free
    return order


def numbers(spark: SparkSession, df: DataFrame, columns: Sequence[str], n: int, seed: int = 0, by: str | None = None, post: Hook | None = None) -> DataFrame:
    """``n`` rows of numbers with the observed distributions and rank correlations (a Gaussian copula).

    Each value has a normal score by its rank (ties share the middle); the
    scores' correlations, from one aggregate, shape seeded normal draws, and a
    draw's probability is looked up among the observed values, so whole numbers
    stay whole. With ``by``, a category that is drawn first, distributions and
    scores are those inside its values. A column without values is null;
    ``post`` as for :func:`marginals`.
    """
    keys = [by] if by else []
    key = F.col(by) if by else F.lit(0)
    out = spark.range(n).withColumnRenamed("id", "rid")
    if by:
        out = _drawn(out, df, by, None, seed)
    shares, scored = {}, df.select(*keys, *columns)
    for c in columns:
        shares[c] = staged(_shares(df, keys, c), "shares")
        score = quantile((F.col("lo") + F.col("end")) / F.lit(2.0 * SCALE))
        table = shares[c].where("lo < end").select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("value").alias("__v"), score.alias(f"__z_{c}"))
        same = (scored[c] == table["__v"]) if not by else (scored[c] == table["__v"]) & scored[by].eqNullSafe(table[f"__k_{by}"])
        scored = scored.join(small(table, BROADCAST_LEAVES), same, "left").drop("__v", *[f"__k_{k}" for k in keys])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]

    def correlation(a: Column, b: Column) -> Column:
        spread = [F.var_pop(F.when(y.isNotNull(), x)) for x, y in ((a, b), (b, a))]
        return F.covar_pop(a, b) / F.nullif(F.sqrt(spread[0] * spread[1]), F.lit(0.0))  # null where a column is constant

    row = scored.agg(F.lit(0), *[correlation(F.col(f"__z_{columns[i]}"), F.col(f"__z_{columns[j]}")) for i, j in pairs]).first()
    matrix = np.eye(len(columns))
    for (i, j), r in zip(pairs, row[1:]):
        matrix[i, j] = matrix[j, i] = 0.0 if r is None or r != r else r
    # the nearest matrix that is positive definite, where rounding or missing pairs left none
    values, vectors = np.linalg.eigh(matrix)
    matrix = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
    shape = np.linalg.cholesky(matrix / np.sqrt(np.outer(np.diag(matrix), np.diag(matrix))))
    normal = {c: quantile((seeded(F.col("rid"), f"normal {c}", seed) + 0.5) / F.lit(float(SCALE))).alias(f"__g_{c}") for c in columns}
    out = out.select("*", *normal.values())
    for i, c in enumerate(columns):
        z = sum((F.lit(float(shape[i, j])) * F.col(f"__g_{columns[j]}") for j in range(i + 1)), F.lit(0.0))
        u = F.least(F.floor(distribution(z) * SCALE), F.lit(SCALE - 1)).cast("long")
        entered = staged(_entered(shares[c], key), "shares")
        sizes = small(entered.select("key", "slots").distinct(), BROADCAST_LEAVES)
        drawn = out.select(F.struct(*out.columns).alias("row"), key.alias("of"), u.alias("u"))
        out = _found(drawn.join(sizes, drawn["of"] == sizes["key"], "left").drop("key"), entered, c)
    out = out.select("rid", *keys, *columns)
    return post(out) if post else out


def mutual_information(df: DataFrame, a: str, b: str) -> float:
    """Mutual information of two columns in nats: their joint entropy less from the sum of their own, by aggregates of counts alone."""
    joint = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("__c"))
    parts = [(joint, -1.0), *[(joint.groupBy(c).agg(F.sum("__c").alias("__c")), 1.0) for c in (a, b)]]
    total, n = 0.0, 0
    for counts, sign in parts:
        row = counts.agg(F.sum("__c"), F.sum(F.col("__c") * F.ln("__c"))).first()
        n = row[0] or 0
        total += sign * (0.0 if not n else float(np.log(n)) - row[1] / n)
    return total


def dependency_tree(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Maximum spanning tree of mutual information (Chow and Liu), rooted at the first column."""
    parents: dict[str, str | None] = {columns[0]: None}
    weight = {(a, b): mutual_information(df, a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    info = lambda a, b: weight.get((a, b), weight.get((b, a), 0.0))
    while len(parents) < len(columns):
        _, child, parent = max((info(a, b), b, a) for a in parents for b in columns if b not in parents)
        parents[child] = parent
    return parents
