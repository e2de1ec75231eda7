"""Preparation: imputation, splits, samples and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.draws import fraction, seeded

from .ranks import values_at
from .stages import staged


def tens(value: Column) -> Column:
    """Rounded to tens, halves to the even ten."""
    return F.bround(value, -1)


def crosstab(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(*keys, value, share)``: share of each value inside its group; null values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    return counts.withColumn("share", F.col("__c") / F.sum("__c").over(Window.partitionBy(*keys))).drop("__c")


def impute_mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Fill nulls with the group's most frequent value; at a tie with the smallest.

    Counts are combined in tasks before a group meets, and the fill is joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("__c"), F.col(value).alias("__v"))).alias("__b"))
    joined = df.alias("d").join(best.alias("b"), [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return joined.select(*[F.coalesce(F.col(f"d.{c}"), F.col("__b.__v")).alias(c) if c == value else F.col(f"d.{c}") for c in df.columns])


def impute_mean(df: DataFrame, keys: Sequence[str], value: str, digits: int = 1) -> DataFrame:
    """Fill nulls with the group's mean, rounded half to even."""
    means = df.groupBy(*keys).agg(F.bround(F.avg(value), digits).alias("__m"))
    joined = df.alias("d").join(means.alias("b"), [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return joined.select(*[F.coalesce(F.col(f"d.{c}"), F.col("__m")).alias(c) if c == value else F.col(f"d.{c}") for c in df.columns])


def split_holdout(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and holdout by a seeded hash of the key: no order of rows, no shuffle, exact complements."""
    inside = fraction(F.col(key), seed) < share
    return df.where(inside), df.where(~F.coalesce(inside, F.lit(False)))


def split_exact(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train of exactly ``round(share * rows)`` rows and its complement, by the order of a seeded hash; ``key`` is unique.

    The hash at the cut comes from counts by range, so no task sorts all rows.
    """
    place = seeded(F.col(key), seed)
    size = round(share * df.count())
    if not size:
        return df.limit(0), df
    counts = df.groupBy(place.cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "counts")
    cut = int(values_at(counts, [size - 1])[size - 1])
    below = counts.where(F.col("value") < cut).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows of one 32-bit hash
    ties = [r[0] for r in df.where(place == cut).select(key).orderBy(key).limit(size - below).collect()]
    inside = (place < cut) | F.col(key).isin(ties)
    return df.where(inside), df.where(~inside)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by the order of a seeded hash; Spark keeps ``n`` rows a task."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def bucket_count(std: float, lo: float, hi: float) -> int:
    """Number of buckets of width ``3.49 + std * 1000 ** (-1/3)``."""
    return max(1, round((hi - lo) / (3.49 + std * 1000 ** (-1 / 3))))


def bucketize(value: Column, lo: float, hi: float, n: int) -> Column:
    """Index from 0 of the equal-width bucket, closed on the left; the last edge lies 0.1 % of the range farther out.

    The edges belong to the original table and are used for releases too; what lies beyond them has no bucket (null).
    """
    at = F.floor((value - lo) / F.lit((hi - lo) / n)).cast("long")
    return F.when((value >= lo) & (value < hi + 0.001 * (hi - lo)), F.least(at, F.lit(n - 1)))


def banded(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the half-open band ``[edge, next edge)`` that holds a number; the first is open below, the last above. Null stays null."""
    if len(names) != len(edges) + 1 or list(edges) != sorted(set(edges)):
        raise ValueError("bands need ascending edges and one name more")
    out = F.when(value < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:]):
        out = out.when(value < edge, name)
    return out.when(value.isNotNull(), names[-1])


def integral_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of booleans: whether a numeric column holds whole numbers only."""
    return df.agg(*[F.coalesce(F.every(F.col(c) % 1 == 0), F.lit(True)).alias(c) for c in columns])


def sample_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.stddev_samp(c).alias(c) for c in columns])


def entropy_weights(df: DataFrame, column: str, numeric: bool = False) -> DataFrame:
    """``(entropy, weight)``: entropy in nats of the value distribution, and its inverse. Numbers are rounded first, halves to even."""
    value = F.bround(F.col(column), 0) if numeric else F.col(column)
    counts = df.groupBy(value.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    whole = counts.agg(F.sum("__c").alias("__n"))  # one row
    p = counts.crossJoin(F.broadcast(whole)).select((F.col("__c") / F.col("__n")).alias("p"))
    h = F.sum(-F.col("p") * F.ln(F.col("p") + 1e-16))
    return p.agg(h.alias("entropy")).withColumn("weight", 1 / F.col("entropy"))


def cast_integral(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that hold whole numbers only become ``long``; the others stay."""
    found = integral_columns(df, columns).first()
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns and found[c] else F.col(c) for c in df.columns])


def clean_patients(df: DataFrame) -> DataFrame:
    """Fill smoking status and body-mass index of ``age, gender, smoking_status, bmi`` rows.

    Children below ten never smoked, whatever is written; other gaps take the
    most frequent status and the mean index of gender and age in tens.
    """
    status = F.when(F.col("age") < 10, "never smoked").otherwise(F.col("smoking_status"))
    rows = df.withColumn("smoking_status", status).withColumn("__tens", tens(F.col("age")))
    keys = ["gender", "__tens"]
    return impute_mean(impute_mode(rows, keys, "smoking_status"), keys, "bmi").drop("__tens")
