"""Privacy metrics over nearest-neighbour frames and attribute inference."""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .generalize import BROADCAST_LEAVES, small
from .ranks import between, percentiles, values_by
from .stages import release, staged

THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5)


def _counted(nn: DataFrame) -> DataFrame:
    """Distinct distances with counts: every later step reads these only."""
    counts = nn.groupBy(F.col("dist").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    return staged(counts, "counts")


def _bounds(counts: DataFrame) -> tuple[float, float]:
    """The 10th and 90th percentile, rounded (NaN for a table without rows)."""
    return tuple(float("nan") if p is None else round(p, 9) for p in percentiles(counts, (0.1, 0.9)))


def _mean(of: Column) -> Column:
    return F.sum(of * F.col("n")) / F.sum(F.when(of.isNotNull(), F.col("n")))


def distance_summary(nn: DataFrame) -> DataFrame:
    """Mean, median, least and greatest distance, over all rows and over those between the percentiles."""
    counts = _counted(nn)
    p10, p90 = _bounds(counts)
    kept = F.col("value").between(p10, p90)
    (median,), (median_inner,) = percentiles(counts, (0.5,)), percentiles(counts.where(kept), (0.5,))
    value, inner = F.col("value"), F.when(kept, F.col("value"))
    return counts.agg(
        _mean(value).alias("mean"), F.lit(median).cast("double").alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        _mean(inner).alias("mean_1090"), F.lit(median_inner).cast("double").alias("median_1090"), F.min(inner).alias("min_1090"), F.max(inner).alias("max_1090"),
    )


def close_value_ratio(nn: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``(threshold, ratio, ratio_1090)``: share of rows nearer than each threshold."""
    counts = _counted(nn)
    p10, p90 = _bounds(counts)
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = counts.select("value", "n", F.col("value").between(p10, p90).alias("inner"), each)
    near = (F.col("value") < F.col("threshold")).cast("double")
    return rows.groupBy("threshold").agg(_mean(near).alias("ratio"), _mean(F.when(F.col("inner"), near)).alias("ratio_1090"))


def similarity_ratio(to_release: DataFrame, to_self: DataFrame) -> DataFrame:
    """Share of rows nearer to the release than to any other row of their own table."""
    both = to_release.select("query_id", F.col("dist").alias("a")).join(to_self.select("query_id", F.col("dist").alias("b")), "query_id")
    return both.agg(F.avg((F.col("a") < F.col("b")).cast("double")).alias("similarity_ratio"))


def adversarial_accuracy(t_p: DataFrame, t_t: DataFrame, p_t: DataFrame, p_p: DataFrame) -> DataFrame:
    """Half the share of rows farther from the release than from their own, plus the same seen from the release."""

    def farther(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        both = a.select("query_id", F.col("dist").alias("a")).join(b.select("query_id", F.col("dist").alias("b")), "query_id")
        return both.agg(F.avg((F.col("a") > F.col("b")).cast("double")).alias(name))

    return farther(t_p, t_t, "x").crossJoin(farther(p_t, p_p, "y")).select(((F.col("x") + F.col("y")) / 2).alias("nn_accuracy"))


def neighbour_scores(records: DataFrame, columns: Mapping[Hashable, tuple[str, ...]]) -> dict[Hashable, dict[str, dict[str, float | None]]]:
    """The four metrics above for several pairs of tables, from their distinct records.

    ``columns`` names, for each pair of a table and a release, ``n, t_p, t_t``
    (rows of the table, their distances to the release and to their own others)
    and ``m, p_t, p_p`` (the same seen from the release). Result: metric,
    attribute (``''`` if there is one only), value.
    """

    def share(n: str, a: str, b: str, holds: Column, name: str) -> Column:
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        return (F.sum(F.when(known, F.col(n) * holds.cast("int"))) / F.sum(F.when(known, F.col(n)))).alias(name)

    groups = list(columns)
    shares, each = [], []
    for g, own in enumerate(columns.values()):
        n, t_p, t_t, m, p_t, p_p = own
        shares += [share(n, t_p, t_t, F.col(t_p) < F.col(t_t), f"near{g}"), share(n, t_p, t_t, F.col(t_p) > F.col(t_t), f"far{g}"), share(m, p_t, p_p, F.col(p_t) > F.col(p_p), f"back{g}")]
        each.append(F.struct(F.lit(g).alias("g"), F.col(t_p).cast("double").alias("value"), F.col(n).alias("n")))
    long = records.select(F.explode(F.array(*each)).alias("e")).select("e.*").where("n > 0 and value is not null")
    with ThreadPoolExecutor(1) as pool:
        of = pool.submit(lambda: records.agg(*shares).first())
        counts = staged(long.groupBy("g", "value").agg(F.sum("n").alias("n")), "counts")
        of = of.result()

    ends = {r["g"]: r for r in counts.groupBy("g").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    wanted = {g: [s * (r["n"] - 1) for s in (0.1, 0.5, 0.9)] for g, r in ends.items()}
    whole = lambda at: [k for x in at for k in (int(x), math.ceil(x))]
    found = values_by(counts, {g: (ends[g]["lo"], ends[g]["hi"], 0, whole(at)) for g, at in wanted.items()}, "g")
    p10, p50, p90 = ({g: between(found[g], at[i]) for g, at in wanted.items()} for i in range(3))

    bound = lambda of: F.get(F.array(*[F.lit(round(of[g], 9) if g in of else None).cast("double") for g in range(len(groups))]), F.col("g"))
    value, low, high = F.col("value"), bound(p10), bound(p90)
    inner = value.between(low, high)
    told = [_mean(value).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")]
    kept = F.when(inner, value)
    told += [_mean(kept).alias("mean_1090"), F.min(kept).alias("min_1090"), F.max(kept).alias("max_1090"), F.sum(F.when(inner, F.col("n"))).alias("kept"), F.coalesce(F.sum(F.when(value < low, F.col("n"))), F.lit(0)).alias("below")]
    for i, t in enumerate(THRESHOLDS):
        close = (value < t).cast("double")
        told += [_mean(close).alias(f"close{i}"), _mean(F.when(inner, close)).alias(f"inner{i}")]
    rows = {r["g"]: r for r in counts.groupBy("g").agg(*told).collect()}
    middle = {g: 0.5 * (r["kept"] - 1) for g, r in rows.items() if r["kept"]}
    found = values_by(counts, {g: (rows[g]["min_1090"], rows[g]["max_1090"], rows[g]["below"], [rows[g]["below"] + k for k in whole([at])]) for g, at in middle.items()}, "g")
    release(counts)

    out = {}
    for g, name in enumerate(groups):
        r = rows[g].asDict() if g in rows else {}
        r["median"], r["median_1090"] = p50.get(g), between(found[g], rows[g]["below"] + middle[g]) if g in middle else None
        far, back = of[f"far{g}"], of[f"back{g}"]
        out[name] = {
            "nn_distance": {c + end: r.get(c + end) for end in ("", "_1090") for c in ("mean", "median", "min", "max")},
            "close_value_ratio": {f"{t}{end}": r.get(f"{c}{i}") for i, t in enumerate(THRESHOLDS) for end, c in (("", "close"), ("_1090", "inner"))},
            "similarity_ratio": {"": of[f"near{g}"]},
            "nn_accuracy": {"": None if far is None or back is None else (far + back) / 2},
        }
    return out


def overlap_scores(truth: Column, guess: Column, truth_std: Column, guess_std: Column) -> tuple[Column, Column, Column]:
    """Absolute error, overlap of the ranges ``[max(0, v - s), v + s]`` over the longer one, and whether the guess lies in the truth's."""
    lo1, hi1 = F.greatest(F.lit(0.0), truth - truth_std), truth + truth_std
    lo2, hi2 = F.greatest(F.lit(0.0), guess - guess_std), guess + guess_std
    longer = F.greatest(hi1 - lo1, hi2 - lo2)
    overlap = F.when(longer > 0, F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2)) / longer).otherwise((truth == guess).cast("double"))
    return F.abs(truth - guess), overlap, ((guess >= lo1) & (guess <= hi1)).cast("double")


def category_scores(truth: Column, guess: Column, truth_group: Column, guess_group: Column, group_size: Column) -> tuple[Column, Column, Column]:
    """Equality, 0, and being in the truth's first-level group over that group's size."""
    return (truth == guess).cast("double"), F.lit(0.0), F.when(truth_group == guess_group, 1 / group_size).otherwise(0.0)


def neighbour_guess(knn: DataFrame, cand: DataFrame, cand_id: str, attribute: str, numeric: bool) -> DataFrame:
    """``(query_id, guess)``: the mean of the neighbours' values, or the largest code of a category."""
    value = cand.select(F.col(cand_id).alias("cand_id"), F.col(attribute).alias("__v"))
    agg = F.avg("__v") if numeric else F.max("__v")
    return knn.join(value, "cand_id").groupBy("query_id").agg(agg.alias("guess"))


def generalization_score(truth_in_guess: Column, n_leaves: Column) -> Column:
    """``1 / leaves`` of a guessed node that covers the truth, else 0."""
    return F.when(truth_in_guess, 1 / n_leaves).otherwise(0.0)


def attribute_kinds(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], most: int = 200) -> DataFrame:
    """``(attribute, kind)``: number, category, or other for a category of more than ``most`` values."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in categorical])
    rows = [F.struct(F.lit(c).alias("attribute"), F.lit("number").alias("kind")) for c in numeric]
    rows += [F.struct(F.lit(c).alias("attribute"), F.when(F.col(c) > most, "other").otherwise("category").alias("kind")) for c in categorical]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: sorted distinct values, numbered from 0, so that all releases share codes."""
    # as many rows as the attribute's domain
    return df.select(F.col(column).alias("value")).distinct().withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("long"))


def encode(df: DataFrame, column: str, codes: DataFrame, name: str | None = None) -> DataFrame:
    """``df`` with the code of each value of ``column`` (see :func:`value_codes`); a value without one fails the query, a null stays null."""
    look = small(codes.select(F.col("value").alias("__value"), F.col("code").alias("__code")), BROADCAST_LEAVES)
    joined = df.join(look, df[column] == look["__value"], "left")
    unknown = F.raise_error(F.concat(F.lit(f"{column}: no code for "), F.col(column).cast("string"))).cast("bigint")
    code = F.when(F.col("__code").isNotNull() | F.col(column).isNull(), F.col("__code")).otherwise(unknown)
    return joined.withColumn(name or column, code).drop("__value", "__code")
