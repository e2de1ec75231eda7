"""Distances between records of mixed type, as column expressions.

Whether a column holds original values only is decided for the whole compared
column (``*_original`` arguments), not for each pair. With ``normalized=False``
a mismatch of generalised values counts as the undivided width of the domain
(numeric) or ``2 * levels - 2`` (categorical). Numbers that are null, such as
text that stands for no range, give a null distance, never a mismatch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(x: Column, y: Column, width: float) -> Column:
    """``|x - y|`` over the width of the domain."""
    return F.abs(x - y) / F.lit(float(width))


def numeric_covered(x: Column, lo: Column, hi: Column, width: float, normalized: bool = False) -> Column:
    """An original number against a range: the mean distance of two draws from the range if it covers the number."""
    n = hi - lo + 1
    known = x.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return F.when((x >= lo) & (x <= hi), (n * n - 1) / (3 * n * width)).when(known, F.lit(1.0 if normalized else float(width)))


def numeric_ranges(lo1: Column, hi1: Column, lo2: Column, hi2: Column, width: float, normalized: bool = False) -> Column:
    """Two generalised numbers: equal or a mismatch."""
    known = lo1.isNotNull() & hi1.isNotNull() & lo2.isNotNull() & hi2.isNotNull()
    return F.when((lo1 == lo2) & (hi1 == hi2), 0.0).when(known, F.lit(1.0 if normalized else float(width)))


def edge(x: Sequence[Column], y: Sequence[Column]) -> Column:
    """Two leaves by their ancestors, level by level: ``2 m / (2 L - 2)`` for the lowest common level ``m``."""
    levels = len(x)
    out = F.when(x[0] == y[0], 0.0)
    for m in range(1, levels):
        out = out.when(x[m] == y[m], F.lit(2.0 * m / (2 * levels - 2)))
    return out.otherwise(F.lit(1.0))


def edge_covered(x: Sequence[Column], node: Column, normalized: bool = False) -> Column:
    """A leaf (with its ancestors) against a node: the edges up to it, or a mismatch if it is no ancestor."""
    levels = len(x)
    out = F.when(x[0] == node, 0.0)
    for m in range(1, levels):
        out = out.when(x[m] == node, F.lit(float(m) / (2 * levels - 2)))
    return out.otherwise(F.lit(1.0 if normalized else 2.0 * levels - 2))


def nodes(x: Column, y: Column, levels: int, normalized: bool = False) -> Column:
    """Two generalised categories: equal or a mismatch."""
    return F.when(x == y, 0.0).otherwise(F.lit(1.0 if normalized else 2.0 * levels - 2))


def with_matrix(pairs: DataFrame, matrix: DataFrame, column: str, name: str = "matrix_distance") -> DataFrame:
    """Attach a given distance to pairs with ``q_<column>`` and ``c_<column>``.

    ``matrix`` has ``a, b, d`` with each unordered pair once; equal values are
    at distance 0, a missing pair gives null.
    """
    x, y = F.col(f"q_{column}").cast("string"), F.col(f"c_{column}").cast("string")
    low, high = F.least(F.col("a").cast("string"), F.col("b").cast("string")), F.greatest(F.col("a").cast("string"), F.col("b").cast("string"))
    look = matrix.select(low.alias("__a"), high.alias("__b"), F.col("d").alias("__d"))
    joined = pairs.join(look, (F.least(x, y) == look["__a"]) & (F.greatest(x, y) == look["__b"]), "left")
    return joined.withColumn(name, F.when(x == y, 0.0).otherwise(F.col("__d"))).drop("__a", "__b", "__d")


def record(parts: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """``sqrt(sum of weighted squares / number of columns)``."""
    weights = weights or {}
    total = F.lit(0.0)
    for name, d in parts.items():
        total = total + F.lit(float(weights.get(name, 1.0))) * d * d
    return F.sqrt(total / len(parts))
