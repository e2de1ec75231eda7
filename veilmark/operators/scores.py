"""Scores of predictions as plain aggregates, and long results to wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``mse, mae, rmse, r2``; the sum of squares about the mean comes from moments in the same pass."""
    e = F.col(truth) - F.col(guess)
    out = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("__v"))
    return out.select("mse", "mae", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.col("__v")).alias("r2"))


def classification_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``accuracy`` and support-weighted ``precision, recall, f1``, with ``support``, from one confusion table."""
    table = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    classes = table.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(0).alias("side"), (F.col("t") == F.col("g")).alias("ok")), F.struct(F.col("g").alias("c"), F.lit(1).alias("side"), (F.col("t") == F.col("g")).alias("ok")))).alias("x"), "n")
    per = classes.groupBy("x.c").agg(
        F.sum(F.when((F.col("x.side") == 0) & F.col("x.ok"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.side") == 0, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.side") == 1, F.col("n")).otherwise(0)).alias("said"),
    )
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    s = F.sum("support")
    return per.agg(
        (F.sum("tp") / s).alias("accuracy"), (F.sum(p * F.col("support")) / s).alias("precision"), (F.sum(r * F.col("support")) / s).alias("recall"), (F.sum(f * F.col("support")) / s).alias("f1"), s.alias("support")
    )


def condense(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Long results as one row a release and target; a missing metric is null.

    A column is named ``metric`` or ``metric__attribute``. The original
    release belongs to the synthetic (``s``) and to the anonymised (``a``)
    table; ``family`` tells them apart.
    """
    name = F.concat_ws("__", "metric", F.when(F.col("attribute") != "", F.col("attribute")))
    family = F.when(F.col("release") == "train", F.array(F.lit("a"), F.lit("s"))).when(F.col("release").startswith("anon"), F.array(F.lit("a"))).otherwise(F.array(F.lit("s")))
    long = results.withColumn("__name", name).withColumn("family", F.explode(family))
    keys = ["dataset", "family", "target", "scope", "release"]
    return long.groupBy(*keys).pivot("__name", metrics).agg(F.first("value"))


def relative_cost(results: DataFrame) -> DataFrame:
    """Each release's cost over that of the original release."""
    base = results.where("release = 'train'").select("dataset", F.col("value").alias("base"))
    return results.join(base, "dataset").select("dataset", "release", (F.col("value") / F.col("base")).alias("ratio"))
