"""Gradient boosting of numbers and of any number of classes over Spark ML's regression trees.

Each round fits one tree an output (one for a number or for two classes, one a
class otherwise) to the negative gradients ``g`` of the loss, weighted by its
second derivatives ``h``: a regression tree over targets ``g / h`` with weights
``h`` splits where the loss falls most, and its leaves are Newton steps
``sum(g) / sum(h)``. A node holds a summed ``h`` of ``MIN_WEIGHT`` at least.

A tree sees a feature only through its thresholds (``BINS`` at most), so rows
that lie between the same thresholds everywhere, a *cell*, share margins and
steps. Rows are counted by cell once, by Spark; rounds read cells with their
counts, whose number follows the values of the features and not the rows.
:func:`counted` makes the counts from columns, before any vector is made. Up
to ``TREE_CELLS`` cells an output's tree of a round is one task's work, and a
round is two jobs. Where there are more cells, Spark ML grows the trees over
the rows, level by level. Margins are written once a round, so no round's plan
holds the rounds before it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .generalize import BROADCAST_LEAVES, small
from .stages import release, staged

# executors need not have this package: what tasks use of this module travels with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rounds, greatest depth of a tree and learning rate of the surveyed models (fixed values).
ROUNDS, DEPTH, RATE = 30, 15, 0.2
#: Least summed second derivative of a node, and of a row.
MIN_WEIGHT, LEAST = 1.0, 1e-6
#: Trees of a round that are fitted at a time, and rows that are worth a task.
AT_ONCE, TASK_ROWS = 8, 10_000
#: Thresholds of a feature at most (as many as Spark ML takes), and cells up to which a task grows a whole tree (some 60 MB).
BINS, TREE_CELLS = 31, 500_000


class _Guesses:
    """What models of either kind say; they have ``classes`` and ``margins``."""

    def predict(self, df: DataFrame, guess: str = "__g", features: str = "__x") -> DataFrame:
        """``df`` with the number or the index of the likeliest class (the first of equal ones)."""
        out = self.margins(df, features=features)
        m = F.col("__margins")
        if self.classes == 0:
            value = m[0]
        elif self.classes == 2:
            value = (m[0] > 0).cast("double")
        else:
            value = (F.array_position(m, F.array_max(m)) - 1).cast("double")
        return out.withColumn(guess, value).drop("__margins")


@dataclass(frozen=True)
class Boosted(_Guesses):
    """``start`` and one ensemble an output; ``classes`` is 0 for a number."""

    start: tuple[float, ...]
    ensembles: tuple[GBTRegressionModel, ...]
    classes: int

    def margins(self, df: DataFrame, name: str = "__margins", features: str = "__x") -> DataFrame:
        out, names = df, [f"__m{k}" for k in range(len(self.start))]
        for n, e in zip(names, self.ensembles, strict=True):
            out = e.setFeaturesCol(features).setPredictionCol(n).transform(out)
        return out.withColumn(name, F.array(*[F.col(n) + F.lit(s) for n, s in zip(names, self.start, strict=True)])).drop(*names)


@dataclass(frozen=True)
class Counted(_Guesses):
    """A model of cells: thresholds of every feature, and the trees of every output as arrays of nodes.

    No draw has a part in it, so fits of the same rows are one model.
    """

    start: tuple[float, ...]
    cuts: tuple[np.ndarray, ...]
    trees: tuple[tuple[tuple[np.ndarray, ...], ...], ...]
    rate: float
    classes: int

    def margins(self, df: DataFrame, name: str = "__margins", features: str = "__x") -> DataFrame:
        if not any(self.trees):
            return df.withColumn(name, F.array(*map(F.lit, self.start)).cast("array<double>"))
        rows = df.withColumn("__cell", _cell(self.cuts)(vector_to_array(features)))
        start = F.array(*map(F.lit, self.start)).cast("array<double>")
        # trees are walked once a cell
        found = staged(rows.select("__cell").distinct().select("__cell", _moved(self.trees, self.rate)("__cell", start).alias(name)), "margins")
        return rows.join(small(found, BROADCAST_LEAVES), "__cell").drop("__cell")


def probabilities(margins: Column, classes: int) -> Column:
    """Probability of every class; of the second alone for two."""
    if classes == 2:
        return F.array(1 / (1 + F.exp(-margins[0])))
    top = F.array_max(margins)
    e = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, v: t + v))


def _steps(y: Column, margins: Column, classes: int) -> Column:
    """``g`` and ``h`` of every output."""
    if classes == 0:
        return F.array(F.struct((y - margins[0]).alias("g"), F.lit(1.0).alias("h")))
    p = probabilities(margins, classes)
    if classes == 2:
        return F.transform(p, lambda x: F.struct((y - x).alias("g"), F.greatest(x * (1 - x), F.lit(LEAST)).alias("h")))
    own = lambda k: (y == k).cast("double")
    return F.transform(p, lambda x, k: F.struct((own(k) - x).alias("g"), F.greatest(2 * x * (1 - x), F.lit(LEAST)).alias("h")))


def loss(y: Column, margins: Column, classes: int) -> Column:
    """Mean squared error, or mean negative log-likelihood, of a table."""
    if classes == 0:
        return F.avg((y - margins[0]) * (y - margins[0]))
    p = probabilities(margins, classes)
    own = F.when(y == 1, p[0]).otherwise(1 - p[0]) if classes == 2 else F.get(p, y.cast("int"))
    return F.avg(-F.log(F.greatest(own, F.lit(1e-15))))


def _cuts(rows: DataFrame, features: int | None = None) -> tuple[np.ndarray, ...]:
    """Thresholds of every feature: between any two neighbouring values if these are few, else quantiles (approximate ones).

    ``features`` is the length of the arrays ``__a``; unless it is known, the rows are asked for it.
    """
    values = staged(rows.select(F.posexplode("__a").alias("i", "v")).where(~F.isnan("v")).distinct(), "values")
    counts = {r["i"]: r["count"] for r in values.groupBy("i").count().collect()}
    few = [i for i, n in counts.items() if n <= BINS + 1]
    known: dict[int, list[float]] = {i: [] for i in few}
    for r in values.where(F.col("i").isin(few)).orderBy("v").collect() if few else []:
        known[r["i"]].append(r["v"])
    release(values)
    cuts = {i: (np.array(v[1:]) + np.array(v[:-1])) / 2 for i, v in known.items()}
    if many := sorted(set(counts) - set(few)):
        shares = [i / (BINS + 1) for i in range(1, BINS + 1)]
        found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("__a")[i]), F.col("__a")[i]), shares, 10_000) for i in many]).first()
        cuts |= {i: np.unique(v) for i, v in zip(many, found, strict=True)}
    if features is None:
        features = rows.select(F.max(F.size("__a"))).first()[0] or 0
    return tuple(cuts.get(i, np.empty(0)) for i in range(features))


def binned(rows: DataFrame, numeric: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``__b_<column>`` for every number: how many of the thresholds of ``rows`` lie below it.

    A tree splits these codes where it splits the numbers. Without a number
    (null or NaN) all thresholds count.
    """
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric}
    cuts = _cuts(rows.select(F.array(*values.values()).alias("__a")), len(numeric)) if numeric else ()
    codes = {f"__b_{c}": sum(((v > float(t)).cast("int") for t in at), F.lit(0)).cast("double") for (c, v), at in zip(values.items(), cuts, strict=True)}
    return lambda df: df.withColumns(codes) if codes else df


def counted(rows: DataFrame, keys: Sequence[str], label: str, number: bool) -> DataFrame:
    """Distinct ``keys`` with their rows ``__n``: by class, or with the sums ``__s`` of a number and ``__q`` of its squares."""
    y = F.col(label).cast("double")
    sums = [F.sum(y).alias("__s"), F.sum(y * y).alias("__q")] if number else []
    by = list(dict.fromkeys([*keys, *([] if number else [label])]))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("__n"), *sums)


def _cell(cuts: Sequence[np.ndarray]):
    """A row's cell: a byte a feature, the number of its thresholds below the value."""

    @pandas_udf("binary")
    def cell(a: pd.Series) -> pd.Series:
        x, n = np.stack(a.to_numpy()) if len(a) else np.empty((0, len(cuts))), len(cuts)
        codes = np.stack([np.searchsorted(at, x[:, i]) for i, at in enumerate(cuts)], axis=1).astype(np.uint8).tobytes()
        return pd.Series([codes[i * n : i * n + n] for i in range(len(a))])

    return cell


def _codes(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)


def _grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> list[np.ndarray]:
    """A regression tree over ``g / h`` weighted by ``h``: feature (-1: a leaf), greatest code of the left, left child (the right one follows) and value of every node.

    All nodes of a level are split together, from sums by node, feature and code.
    """
    least, bins = min(0.49 * h.sum(), MIN_WEIGHT), codes.max(axis=0).astype(int) + 1
    nodes, size = [], 1
    rows, at, m = np.arange(len(g)), np.zeros(len(g), int), 1
    for level in range(depth + 1):
        own_g, own_h = g[rows], h[rows]
        total_g, total_h, spread = (np.bincount(at, v, m) for v in (own_g, own_h, own_g * own_g / own_h))
        best, feature, cut = spread * 1e-12, np.full(m, -1), np.zeros(m, int)  # less is rounding
        for f in np.flatnonzero(bins > 1) if level < depth else ():
            key = at * bins[f] + codes[rows, f]
            left_g, left_h = (np.bincount(key, v, m * bins[f]).reshape(m, -1).cumsum(axis=1)[:, :-1] for v in (own_g, own_h))
            right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
            room = (left_h >= least) & (right_h >= least)
            gain = np.where(room, left_g**2 / np.where(room, left_h, 1) + right_g**2 / np.where(room, right_h, 1) - (total_g**2 / total_h)[:, None], -np.inf)
            j = gain.argmax(axis=1)
            gained = gain[np.arange(m), j]
            better = gained > best
            best, feature, cut = np.where(better, gained, best), np.where(better, f, feature), np.where(better, j, cut)
        inner = feature >= 0
        place = np.cumsum(inner) - 1
        nodes.append((feature, cut, np.where(inner, size + 2 * place, -1), total_g / total_h))
        size += 2 * int(inner.sum())
        if not inner.any():
            break
        go = inner[at]
        rows, at = rows[go], at[go]
        at, m = 2 * place[at] + (codes[rows, feature[at]] > cut[at]), 2 * int(inner.sum())
    return [np.concatenate(v) for v in zip(*nodes, strict=True)]


def _moved(trees: Sequence[Sequence[Sequence[np.ndarray]]], rate: float):
    """Margins of a cell after the trees of every output."""

    @pandas_udf("array<double>")
    def moved(cell: pd.Series, margins: pd.Series) -> pd.Series:
        codes, out = _codes(cell), np.stack(margins.to_numpy()).copy() if len(cell) else np.empty((0, len(trees)))
        every = np.arange(len(cell))
        for k, own in enumerate(trees):
            for feature, cut, left, value in own:
                at = np.zeros(len(cell), int)
                while len(at) and (inner := feature[at] >= 0).any():
                    at = np.where(inner, left[at] + (codes[every, feature[at]] > cut[at]), at)
                out[:, k] += rate * value[at]
        return pd.Series(list(out))

    return moved


_TREE = "k int, feature array<int>, cut array<int>, left array<int>, value array<double>"


def _cell_steps(classes: int) -> Column:
    """``g`` and ``h`` of every output, summed over the rows of a cell: those of :func:`_steps`."""
    n, c, f = F.col("n"), F.col("c"), F.col("f")
    if classes == 0:
        return F.array(F.struct((c[0] - n * f[0]).alias("g"), n.alias("h")))
    p = probabilities(f, classes)
    if classes == 2:
        return F.transform(p, lambda x: F.struct((c[1] - n * x).alias("g"), (n * F.greatest(x * (1 - x), F.lit(LEAST))).alias("h")))
    return F.transform(p, lambda x, k: F.struct((F.get(c, k) - n * x).alias("g"), (n * F.greatest(2 * x * (1 - x), F.lit(LEAST))).alias("h")))


def _cell_loss(classes: int) -> Column:
    """:func:`loss` from cells."""
    n, c, f = F.col("n"), F.col("c"), F.col("f")
    if classes == 0:
        return F.sum(c[1] - 2 * f[0] * c[0] + n * f[0] * f[0]) / F.sum("n")
    p = probabilities(f, classes)
    both = F.array(1 - p[0], p[0]) if classes == 2 else p
    each = F.zip_with(c, both, lambda m, x: -m * F.log(F.greatest(x, F.lit(1e-15))))
    return F.sum(F.aggregate(each, F.lit(0.0), lambda t, v: t + v)) / F.sum("n")


def fit(train: DataFrame, classes: int, label: str = "__y", features: str = "__x", rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, seed: int = 7, losses: list | None = None, counts: DataFrame | None = None) -> Boosted | Counted:
    """A model of ``label``: a number (``classes`` 0), or a class index below ``classes``.

    ``losses`` receives the training loss before the first round and after
    each; that costs a pass a round. One class is a constant guess, and a table
    without rows gives a model that guesses 0. ``counts`` are the rows of
    ``train`` as :func:`counted` sums them up, with ``features``; they are then
    read instead. ``seed`` has a say, and ``train`` is read beside ``counts``,
    only where the rows have more than ``TREE_CELLS`` cells.
    """
    outputs = 1 if classes in (0, 2) else classes
    y = F.col(label).cast("double") if counts is None or classes else F.lit(0.0)
    n, s, q = (F.lit(1.0), y, y * y) if counts is None else (F.col("__n"), F.col("__n") * y, F.lit(0.0)) if classes else map(F.col, ("__n", "__s", "__q"))
    source = (train if counts is None else counts).select(vector_to_array(features).alias("__a"), y.alias("__label"), n.alias("__n"), s.alias("__s"), q.alias("__q"))
    base = staged(source.dropna(subset=["__label"]), "rows")
    rows, total = base.agg(F.sum("__n"), F.sum("__s")).first()
    mean = total / rows if rows else None
    if classes == 0:
        start = [mean or 0.0]
    elif classes == 2:
        start = [math.log(max(mean or 0.5, 1e-6) / max(1 - (0.5 if mean is None else mean), 1e-6))]
    else:
        start = [0.0] * outputs
    cuts, trees = _cuts(base), [[] for _ in range(outputs)]
    if classes == 0:
        held = F.array(F.sum("__s"), F.sum("__q"))
    else:
        held = F.array(*[F.sum(F.when(F.col("__label") == k, F.col("__n")).otherwise(0.0)) for k in range(max(classes, 2))])
    zero = F.array(*map(F.lit, start)).cast("array<double>")
    by_cell = base.withColumn("cell", _cell(cuts)("__a")).groupBy("cell")
    state = staged(by_cell.agg(F.sum("__n").alias("n"), held.alias("c")).withColumn("f", zero), "boost")
    release(base)
    cells = state.count()
    if cells > TREE_CELLS:
        release(state)
        return _fit_rows(train, classes, label, features, rounds, depth, rate, seed, losses)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = _grow(_codes(pdf["cell"]), pdf["g"].to_numpy(), pdf["h"].to_numpy(), depth)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], **{n: [list(v)] for n, v in zip(("feature", "cut", "left", "value"), tree, strict=True)}})

    spread = max(1, -(-cells // TASK_ROWS))
    for _ in range(rounds if rows and classes != 1 else 0):
        if losses is not None:
            losses.append(state.agg(_cell_loss(classes)).first()[0])
        long = state.select("cell", F.posexplode(_cell_steps(classes)).alias("k", "s")).select("cell", "k", "s.g", "s.h")
        # cells in a fixed order, so that reruns add up alike; an explicit number of partitions is not merged again
        found = long.repartition(outputs, "k").sortWithinPartitions("k", "cell").groupBy("k").applyInPandas(grow, _TREE).collect()
        own: list[list] = [[] for _ in range(outputs)]
        for r in found:
            own[r["k"]].append((*(np.array(r[n], np.int32) for n in ("feature", "cut", "left")), np.array(r["value"])))
            trees[r["k"]].append(own[r["k"]][0])
        after = staged(state.coalesce(spread).withColumn("f", _moved(own, rate)("cell", "f")), "boost")
        release(state)
        state = after
    if losses is not None:
        losses.append(state.agg(_cell_loss(classes)).first()[0])
    release(state)
    return Counted(tuple(start), cuts, tuple(map(tuple, trees)), rate, classes)


def _fit_rows(train: DataFrame, classes: int, label: str, features: str, rounds: int, depth: int, rate: float, seed: int, losses: list | None) -> Boosted:
    """:func:`fit` by Spark ML's trees over the rows, whatever the number of cells is."""
    spark = train.sparkSession
    y = F.col("__label")
    base = train.select(F.col(features).alias("__x"), F.col(label).cast("double").alias("__label")).dropna(subset=["__label"])
    outputs = 1 if classes in (0, 2) else classes
    n, mean = base.agg(F.count(F.lit(1)), F.avg("__label")).first()
    mean = mean if classes in (0, 2) else None
    base = base.coalesce(max(1, -(-n // TASK_ROWS)))  # a level of a tree is a job: few rows need few tasks
    if classes == 0:
        start = [mean or 0.0]
    elif classes == 2:
        start = [math.log(max(mean or 0.5, 1e-6) / max(1 - (0.5 if mean is None else mean), 1e-6))]
    else:
        start = [0.0] * outputs
    trees: list[list] = [[] for _ in range(outputs)]
    state = staged(base.withColumn("__f", F.array(*map(F.lit, start)).cast("array<double>")), "boost")
    with ThreadPoolExecutor(min(outputs, AT_ONCE)) as pool:
        for r in range(rounds):
            if classes == 1 or (mean is None and classes in (0, 2)):
                break
            if losses is not None:
                losses.append(state.agg(loss(y, F.col("__f"), classes)).first()[0])
            steps = state.withColumn("__s", _steps(y, F.col("__f"), classes)).persist()
            weight = steps.agg(*[F.sum(F.col("__s")[k]["h"]) for k in range(outputs)]).first()

            def tree(k: int, steps: DataFrame = steps, weight: Sequence[float] = weight, r: int = r):
                least = min(0.49, MIN_WEIGHT / weight[k]) if weight[k] else 0.0
                s = F.col("__s")[k]
                rows = steps.select("__x", (s["g"] / s["h"]).alias("t"), s["h"].alias("h"))
                return DecisionTreeRegressor(featuresCol="__x", labelCol="t", weightCol="h", maxDepth=depth, minWeightFractionPerNode=least, seed=seed + r).fit(rows)

            fitted = list(pool.map(tree, range(outputs)))
            out = state
            for k, t in enumerate(fitted):
                trees[k].append(t)
                out = t.setPredictionCol(f"__t{k}").transform(out)
            moved = F.array(*[F.col("__f")[k] + rate * F.col(f"__t{k}") for k in range(outputs)])
            after = staged(out.select("__x", "__label", moved.alias("__f")), "boost")
            steps.unpersist()
            release(state)
            state = after
    if losses is not None:
        losses.append(state.agg(loss(y, F.col("__f"), classes)).first()[0])
    release(state)
    return Boosted(tuple(start), tuple(_ensemble(spark, ts, rate, seed) for ts in trees), classes)


def _ensemble(spark, trees: list, rate: float, seed: int) -> GBTRegressionModel:
    """Spark ML's own sum of weighted trees."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kind = jvm.org.apache.spark.ml.regression
    if not trees:  # a tree that says 0
        zero = spark.range(1).select(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"))
        from pyspark.ml.feature import VectorAssembler

        trees = [DecisionTreeRegressor(featuresCol="v", labelCol="t", maxDepth=1, seed=seed).fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(zero))]
    array = gateway.new_array(kind.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        array[i], weights[i] = t._java_obj, rate
    return GBTRegressionModel(kind.GBTRegressionModel(f"boosted-{id(trees)}", array, weights))
