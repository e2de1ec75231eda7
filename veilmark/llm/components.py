"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, join_by_key, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the least of the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = join_by_key(both, materialize(least, "least"), "u", "n", "v").where("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    moved = join_by_key(down, least, "u", "n", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge.

    ``edges`` holds integer columns ``u`` and ``v``; loops, repeats and nulls
    are ignored. The component is its smallest node, which is included.
    Minima per node are combined inside tasks, and the edges of a hot node
    meet its minimum in as many tasks as their number asks for; each round is
    written to the shared folder and its predecessor dropped.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "cc")
    mark = None
    for _ in range(limit):
        row = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
        if not row[0]:
            break
        then = materialize(_small_star(materialize(_large_star(now), "cc")), "cc")
        drop_materialized(now)
        now = then
    else:
        raise RuntimeError(f"components have not settled after {limit} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
