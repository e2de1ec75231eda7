"""Generalisation hierarchies: one row a leaf, columns ``l0`` (leaf) to ``l{k}`` (root)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.ranges import interval_text

ROOT = "*"


@dataclass(frozen=True)
class Hierarchy:
    """``frame`` has one row a leaf, so it is as small as the attribute's domain; ``leaves`` is their number where it is known."""

    attribute: str
    frame: DataFrame
    depth: int
    leaves: int | None = None

    @cached_property
    def size(self) -> int:
        """Number of leaves, counted once if at all."""
        return self.frame.select("l0").distinct().count() if self.leaves is None else self.leaves

    @property
    def levels(self) -> list[str]:
        return [f"l{i}" for i in range(self.depth)]

    def check(self) -> Hierarchy:
        """Raise unless there are two levels at least, one root, and one row a leaf."""
        if self.depth < 2:
            raise ValueError(f"{self.attribute}: a hierarchy has at least two levels")
        row = self.frame.agg(F.countDistinct(self.levels[-1]).alias("roots"), F.count("*").alias("n"), F.countDistinct("l0").alias("leaves")).first()
        if row["roots"] != 1 or row["n"] != row["leaves"]:
            raise ValueError(f"{self.attribute}: {row['roots']} roots, {row['n']} rows for {row['leaves']} leaves")
        return self


def interval_hierarchy(spark: SparkSession, attribute: str, lo: int, hi: int, base: int = 5, fanouts: tuple[int, ...] = (2, 2, 2)) -> Hierarchy:
    """Integers ``lo..hi``, intervals of ``base`` and then of ``fanout`` times the width before, and the root."""
    v = F.col("v").cast("long")
    widths = [base]
    for f in fanouts:
        widths.append(widths[-1] * f)
    cols = [v.cast("string").alias("l0"), *[interval_text(v, w, lo, hi + 1).alias(f"l{i}") for i, w in enumerate(widths, 1)], F.lit(ROOT).alias(f"l{len(widths) + 1}")]
    return Hierarchy(attribute, spark.range(lo, hi + 1).toDF("v").select(*cols), len(widths) + 2, hi - lo + 1)


def redaction_hierarchy(values: DataFrame, attribute: str, width: int) -> Hierarchy:
    """Texts of ``width`` characters, masked from the right one by one."""
    z = F.col(attribute).cast("string")
    cols = [F.concat(F.substring(z, 1, width - k), F.lit("*" * k)).alias(f"l{k}") for k in range(width)]
    return Hierarchy(attribute, values.select(attribute).distinct().select(*cols, F.lit(ROOT).alias(f"l{width}")), width + 1)


def order_hierarchy(values: DataFrame, attribute: str, group: Column) -> Hierarchy:
    """Leaves, a group of each leaf, and the root. A group may bear a leaf's name."""
    frame = values.select(attribute).distinct().select(F.col(attribute).cast("string").alias("l0"), group.cast("string").alias("l1"), F.lit(ROOT).alias("l2"))
    return Hierarchy(attribute, frame, 3)


def default_hierarchy(values: DataFrame, attribute: str) -> Hierarchy:
    """Leaves below the root, for attributes without a hierarchy of their own."""
    return Hierarchy(attribute, values.select(F.col(attribute).cast("string").alias("l0")).distinct().withColumn("l1", F.lit(ROOT)), 2)


def leaf_nodes(h: Hierarchy) -> DataFrame:
    """``(attribute, level, node, leaf)``: every node of every level with each leaf below it."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("node")) for i, c in enumerate(h.levels)])
    return h.frame.select(F.lit(h.attribute).alias("attribute"), F.explode(levels).alias("n"), F.col("l0").alias("leaf")).select("attribute", "n.level", "n.node", "leaf")


def node_leaves(h: Hierarchy) -> DataFrame:
    """``(node, level, leaves array, n_leaves)``; a name used on several levels stands for the highest of them."""
    per = leaf_nodes(h).groupBy("node", "level").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    best = per.groupBy("node").agg(F.max(F.struct("level", "leaves")).alias("b"))
    return best.select("node", "b.level", "b.leaves", F.size("b.leaves").cast("long").alias("n_leaves"))


def parents(h: Hierarchy) -> DataFrame:
    """``(level, node, parent)`` of all nodes below the root."""
    steps = F.array(*[F.struct(F.lit(i).alias("level"), F.col(a).alias("node"), F.col(b).alias("parent")) for i, (a, b) in enumerate(zip(h.levels, h.levels[1:]))])
    return h.frame.select(F.explode(steps).alias("s")).select("s.*").distinct()


def first_level(h: Hierarchy) -> DataFrame:
    """``(leaf, group, group_size)``: the node above each leaf, and how many leaves it has."""
    sizes = h.frame.groupBy(F.col("l1").alias("group")).agg(F.countDistinct("l0").alias("group_size"))
    return h.frame.select(F.col("l0").alias("leaf"), F.col("l1").alias("group")).distinct().join(sizes, "group").select("leaf", "group", "group_size")
