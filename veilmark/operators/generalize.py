"""Full-domain generalisation, k-anonymity with suppression, and statistics of releases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.draws import seeded

from .hierarchy import ROOT, Hierarchy, node_leaves
from .stages import staged

#: Rows up to which a hierarchy is broadcast; a larger one is joined by shuffle.
BROADCAST_LEAVES = 200_000


def small(df: DataFrame, rows: int, known: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows: as many as is ``known``, else counted no further."""
    size = df.limit(rows + 1).count() if known is None else known
    return F.broadcast(df) if size <= rows else df


def generalize(df: DataFrame, hierarchies: Mapping[str, Hierarchy], vector: Mapping[str, int], suffix: str = "") -> DataFrame:
    """Replace each attribute by its ancestor at the vector's level; a value without one becomes null."""
    out = df
    for a, level in vector.items():
        if level == 0 and not suffix:
            continue
        look = small(hierarchies[a].frame.select(F.col("l0").alias("__leaf"), F.col(f"l{level}").alias("__node")), BROADCAST_LEAVES, hierarchies[a].size)
        out = out.join(look, out[a].cast("string") == look["__leaf"], "left").withColumn(f"{a}{suffix}", F.col("__node")).drop("__leaf", "__node")
    return out


def class_size(qid: Sequence[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*qid))


def suppress(df: DataFrame, qid: Sequence[str], k: int) -> DataFrame:
    """k-anonymity: the quasi-identifiers of rows in classes below ``k`` become ``*``; ``suppressed`` marks them.

    Class sizes come from one combined aggregate, in which a class of any size
    costs one row a task; adaptive execution broadcasts them where they are few.
    """
    sizes = df.groupBy(*qid).agg(F.count(F.lit(1)).alias("__size"))
    joined = df.alias("d").join(sizes.alias("s"), [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in qid])
    hidden = F.col("__size") < k
    return joined.select(*[F.when(hidden, ROOT).otherwise(F.col(f"d.{c}").cast("string")).alias(c) if c in qid else F.col(f"d.{c}") for c in df.columns], hidden.alias("suppressed"))


def distinct_combinations(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Distinct quasi-identifiers with their count: all that the lattice needs of the rows."""
    return df.groupBy(*qid).agg(F.count(F.lit(1)).alias("n"))


def lattice(hierarchies: Mapping[str, Hierarchy], qid: Sequence[str]) -> list[dict[str, int]]:
    """All level vectors, in the order of the attributes."""
    return [dict(zip(qid, v)) for v in product(*[range(hierarchies[a].depth) for a in qid])]


def parameter_grid(**values: Sequence) -> list[dict]:
    """All combinations of configuration values, the last name varying fastest."""
    return [dict(zip(values, v)) for v in product(*values.values())]


def lattice_classes(combos: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], vectors: Sequence[Mapping[str, int]] | None = None) -> DataFrame:
    """``(node, <qid>, n)``: the classes of every level vector, from the distinct combinations alone.

    Attributes climb one after another: the classes over the levels of the
    attributes so far, with the others still at their leaves, are what the next
    one starts from. So a node is summed up from classes below it, not from
    all combinations again. Of ``vectors``, only their prefixes are made.
    """
    wanted = None if vectors is None else [tuple(v[a] for a in qid) for v in vectors]
    out = combos.withColumn("__at", F.lit(""))
    for i, a in enumerate(qid):
        h = hierarchies[a]
        steps = F.explode(F.array(*[F.struct(F.lit(str(level)).alias("level"), F.col(f"l{level}").alias("node")) for level in range(h.depth)])).alias("s")
        look = small(h.frame.select(F.col("l0").alias("__leaf"), steps).select("__leaf", "s.level", "s.node"), BROADCAST_LEAVES, h.size * h.depth)
        step = out.join(look, out[a].cast("string") == look["__leaf"])
        at = F.col("level") if i == 0 else F.concat("__at", F.lit("_"), F.col("level"))
        climbed = step.select(at.alias("__at"), *[F.col("node").alias(a) if c == a else F.col(c) for c in qid], "n")
        if wanted is not None:
            climbed = climbed.where(F.col("__at").isin(sorted({"_".join(map(str, v[: i + 1])) for v in wanted})))
        out = climbed.groupBy("__at", *qid).agg(F.sum("n").alias("n"))
    return out.withColumnRenamed("__at", "node")


def record_error(
    df: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], k: int, middles: Mapping[str, Column] | None = None, widths: Mapping[str, float] | None = None
) -> DataFrame:
    """``(node, record_error)``: mean over rows of the mean squared distance of a row from its released form.

    A number lies ``(value - middle of its node) / width`` away, for the
    attributes that ``middles`` (of ``node``) and ``widths`` name; any other
    value by the share of levels climbed; a suppressed row lies at the root
    in every attribute. Attributes climb one after another from their leaves,
    so each class carries the sum of its rows' errors along.
    """
    out = distinct_combinations(df, qid).withColumn("__at", F.lit("")).withColumn("__e", F.lit(0.0)).withColumn("__root", F.lit(0.0))
    for i, a in enumerate(qid):
        h = hierarchies[a]
        numeric = bool(middles) and a in middles
        gap = (F.col("__leaf").cast("double") - middles[a]) / F.lit(float(widths[a])) if numeric else F.col("level").cast("int") / F.lit(h.depth - 1)
        steps = F.explode(F.array(*[F.struct(F.lit(str(level)).alias("level"), F.col(f"l{level}").alias("node")) for level in range(h.depth)])).alias("s")
        look = h.frame.select(F.col("l0").alias("__leaf"), steps).select("__leaf", "s.level", "s.node").withColumn("__own", gap * gap)
        root = look.where(F.col("level") == str(h.depth - 1)).select(F.col("__leaf").alias("__l"), F.col("__own").alias("__top"))
        look = look.join(root, F.col("__leaf") == F.col("__l")).drop("__l")
        step = out.join(small(look, BROADCAST_LEAVES, h.size * h.depth), out[a].cast("string") == look["__leaf"])
        at = F.col("level") if i == 0 else F.concat("__at", F.lit("_"), F.col("level"))
        climbed = step.select(
            at.alias("__at"), *[F.col("node").alias(a) if c == a else F.col(c) for c in qid], "n",
            (F.col("__e") + F.col("n") * F.col("__own")).alias("__e"), (F.col("__root") + F.col("n") * F.col("__top")).alias("__root"),
        )
        out = climbed.groupBy("__at", *qid).agg(*[F.sum(c).alias(c) for c in ("n", "__e", "__root")])
    whole = F.sum(F.when(F.col("n") < k, F.col("__root")).otherwise(F.col("__e"))) / (F.sum("n") * len(qid))
    return out.groupBy(F.col("__at").alias("node")).agg(whole.alias("record_error"))


def lattice_statistics(classes: DataFrame, k: int) -> DataFrame:
    """Per node: rows, suppressed rows, number and sizes of the classes that stay, discernibility.

    Discernibility charges a row with the size of its class, and a suppressed
    row with the size of the table.
    """
    kept = F.col("n") >= k
    size = F.sum("n")
    out = classes.groupBy("node").agg(
        size.alias("n_rows"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("n_suppressed"),
        F.count(F.when(kept, 1)).alias("n_classes"),
        F.min(F.when(kept, F.col("n"))).alias("min_class"),
        F.max(F.when(kept, F.col("n"))).alias("max_class"),
        F.avg(F.when(kept, F.col("n"))).alias("avg_class"),
        F.sum(F.when(kept, F.col("n") * F.col("n")).otherwise(F.col("n") * F.lit(0))).alias("__squares"),
    )
    return out.withColumn("discernibility", F.col("__squares") + F.col("n_suppressed") * F.col("n_rows")).drop("__squares")


def information_loss(classes: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], k: int, balance: float = 0.5) -> DataFrame:
    """``(node, loss)``: mean over attributes and rows of (leaves - 1) / (domain - 1); suppressed rows lose all.

    ``balance`` weighs suppression against generalisation: below a half
    suppression counts ``2 * balance``, above it generalisation counts
    ``2 - 2 * balance``, and what is not reduced counts in full.
    """
    out, hidden, shown = classes, min(1.0, 2 * balance), min(1.0, 2 - 2 * balance)
    for a in qid:
        counts = node_leaves(hierarchies[a]).select(F.col("node").alias("__node"), F.col("n_leaves").alias(f"__n_{a}"))
        domain = hierarchies[a].size
        out = out.join(small(counts, 2 * BROADCAST_LEAVES, hierarchies[a].size * hierarchies[a].depth), out[a] == counts["__node"], "left").drop("__node")
        share = (F.col(f"__n_{a}") - 1) / F.lit(max(domain - 1, 1))
        out = out.withColumn(f"__n_{a}", F.when(F.col("n") < k, hidden).otherwise(share * shown))
    whole = sum((F.col(f"__n_{a}") for a in qid), F.lit(0.0)) / len(qid)
    return out.groupBy("node").agg((F.sum(whole * F.col("n")) / F.sum("n")).alias("loss"))


def precision(vector: Mapping[str, int], hierarchies: Mapping[str, Hierarchy]) -> float:
    """Sweeney's precision of a full-domain release: one less the mean share of levels climbed."""
    return 1 - sum(level / (hierarchies[a].depth - 1) for a, level in vector.items()) / len(vector)


def table_precision(classes: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], k: int) -> DataFrame:
    """``(node, precision)`` of the released rows: one less the mean share of levels climbed, which a suppressed row climbs all."""
    climbed = F.aggregate(
        F.zip_with(F.split("node", "_"), F.array(*[F.lit(hierarchies[a].depth - 1) for a in qid]), lambda level, top: level.cast("int") / top), F.lit(0.0), lambda t, x: t + x
    ) / len(qid)
    return classes.groupBy("node").agg((1 - F.sum(F.col("n") * F.when(F.col("n") < k, 1.0).otherwise(climbed)) / F.sum("n")).alias("precision"))


def nonuniform_entropy(df: DataFrame, hierarchies: Mapping[str, Hierarchy], vector: Mapping[str, int]) -> DataFrame:
    """``(attribute, entropy)``: sum over rows of ``-log2(n(leaf) / n(node))``."""
    parts = None
    for a, level in vector.items():
        h = hierarchies[a].frame
        leaf = df.groupBy(F.col(a).cast("string").alias("l0")).agg(F.count(F.lit(1)).alias("__c"))
        both = leaf.join(h.select("l0", F.col(f"l{level}").alias("node")), "l0")
        node = both.groupBy("node").agg(F.sum("__c").alias("t"))
        one = both.join(node, "node").agg(F.sum(-F.col("__c") * F.log2(F.col("__c") / F.col("t"))).alias("entropy")).select(F.lit(a).alias("attribute"), "entropy")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def chosen_nodes(statistics: DataFrame) -> DataFrame:
    """Nodes worth publishing: those with rows left, and the first of those that are wholly suppressed.

    The order is that of the level vectors.
    """
    place = F.transform(F.split("node", "_"), lambda x: x.cast("int"))
    gone = statistics.where("n_suppressed = n_rows").agg(F.min(F.struct(place.alias("place"), "node"))["node"].alias("__first"))  # one row
    return statistics.crossJoin(F.broadcast(gone)).where((F.col("n_suppressed") < F.col("n_rows")) | (F.col("node") == F.col("__first"))).drop("__first")


def level_columns(df: DataFrame, qid: Sequence[str], name: str = "node") -> DataFrame:
    """``df`` with ``level_<attribute>`` parsed from a node's name (``1_0_2``), -1 where the name is none."""
    parts = F.split(name, "_")
    vector = F.col(name).rlike(r"^\d+(_\d+)*$") & (F.size(parts) == len(qid))
    return df.select("*", *[F.when(vector, F.get(parts, F.lit(i)).cast("int")).otherwise(-1).alias(f"level_{a}") for i, a in enumerate(qid)])


def attribute_levels(df: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], middles: Mapping[str, Column] | None = None) -> DataFrame:
    """``(attribute, level, entropy, squared_error)`` of every level of every attribute, each from its value counts alone.

    ``middles`` gives, for numeric attributes, the number that stands for
    ``node``; the error is the mean squared distance from the value.
    """
    parts = None
    for a in qid:
        h = hierarchies[a]
        counts = df.groupBy(F.col(a).cast("string").alias("l0")).agg(F.count(F.lit(1)).alias("c"))
        levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"l{i}").alias("node")) for i in range(h.depth)])).alias("x")
        each = counts.join(small(h.frame, BROADCAST_LEAVES, h.size), "l0").select("l0", "c", levels).select("l0", "c", "x.level", "x.node")
        sizes = each.groupBy("level", "node").agg(F.sum("c").alias("t"))
        error = F.lit(None).cast("double")
        if middles and a in middles:
            gap = F.col("l0").cast("double") - middles[a]
            error = F.sum(F.col("c") * gap * gap) / F.sum("c")
        one = each.join(sizes, ["level", "node"]).groupBy("level").agg(F.sum(-F.col("c") * F.log2(F.col("c") / F.col("t"))).alias("entropy"), error.alias("squared_error"))
        one = one.select(F.lit(a).alias("attribute"), "level", "entropy", "squared_error")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def node_profile(df: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str], k: int, middles: Mapping[str, Column] | None = None) -> DataFrame:
    """One row a level vector with all statistics of a release, and its levels by attribute.

    Class counts are exact; quality is by the published definitions: Sweeney's
    precision, Iyengar's loss, discernibility, ambiguity, non-uniform entropy
    (summed over attributes) and squared error of attributes (mean over the
    numeric ones).
    """
    classes = staged(lattice_classes(distinct_combinations(df, qid), hierarchies, qid), "classes")
    out = level_columns(lattice_statistics(classes, k), qid)
    total = sum((F.col(f"level_{a}") for a in qid), F.lit(0))
    climbed = sum((F.col(f"level_{a}") / (hierarchies[a].depth - 1) for a in qid), F.lit(0.0))
    out = out.withColumn("k", F.lit(k)).withColumn("total_level", total).withColumn("precision", 1 - climbed / len(qid))
    out = out.join(information_loss(classes, hierarchies, qid, k), "node").join(ambiguity(classes, hierarchies, qid), "node")
    levels = staged(attribute_levels(df, hierarchies, qid, middles), "levels")
    for a in qid:
        look = levels.where(F.col("attribute") == a).select(F.col("level").alias(f"level_{a}"), F.col("entropy").alias(f"__e_{a}"), F.col("squared_error").alias(f"__q_{a}"))
        out = out.join(F.broadcast(look), f"level_{a}")  # a row for each level
    errors = F.array_compact(F.array(*[F.col(f"__q_{a}") for a in qid]))
    mean = F.aggregate(errors, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(errors), F.lit(0))
    out = out.withColumn("entropy", sum((F.col(f"__e_{a}") for a in qid), F.lit(0.0))).withColumn("squared_error", mean)
    return out.drop(*[f"__e_{a}" for a in qid], *[f"__q_{a}" for a in qid])


def ambiguity(classes: DataFrame, hierarchies: Mapping[str, Hierarchy], qid: Sequence[str]) -> DataFrame:
    """``(node, ambiguity)``: mean over rows of the number of leaf combinations that the class stands for."""
    out = classes
    for a in qid:
        counts = node_leaves(hierarchies[a]).select(F.col("node").alias("__node"), F.col("n_leaves").alias(f"__n_{a}"))
        out = out.join(small(counts, 2 * BROADCAST_LEAVES, hierarchies[a].size * hierarchies[a].depth), out[a] == counts["__node"], "left").drop("__node")
    cells = F.lit(1.0)
    for a in qid:
        cells = cells * F.col(f"__n_{a}")
    return out.groupBy("node").agg((F.sum(cells * F.col("n")) / F.sum("n")).alias("ambiguity"))


def classification_metric(df: DataFrame, qid: Sequence[str], target: Column) -> DataFrame:
    """Share of rows outside their class's majority target; suppressed rows form an ordinary class."""
    per = df.groupBy(*qid, target.alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    cls = per.groupBy(*qid).agg((F.sum("__c") - F.max("__c")).alias("wrong"), F.sum("__c").alias("n"))
    return cls.agg((F.sum("wrong") / F.sum("n")).alias("cm"))


def sample_to_original(df: DataFrame, hierarchies: Mapping[str, Hierarchy], columns: Sequence[str], row_id: str, seed: int = 0) -> DataFrame:
    """Replace each generalised value by one of its leaves, drawn by a seeded hash of row and attribute.

    The draw is seeded by ``row|attribute|seed``, so another engine can repeat it.
    """
    out = df
    for a in columns:
        leaves = small(node_leaves(hierarchies[a]).select(F.col("node").alias("__node"), F.col("leaves").alias("__leaves")), 2 * BROADCAST_LEAVES, hierarchies[a].size * hierarchies[a].depth)
        draw = seeded(F.col(row_id), a, seed)
        out = out.join(leaves, out[a] == leaves["__node"], "left")
        out = out.withColumn(a, F.when(F.col("__leaves").isNotNull(), F.element_at("__leaves", (F.pmod(draw, F.size("__leaves")) + 1).cast("int")))).drop("__node", "__leaves")
    return out


def generalize_like(df: DataFrame, train: DataFrame, hierarchies: Mapping[str, Hierarchy], vector: Mapping[str, int], categorical: Sequence[str]) -> DataFrame:
    """Apply a release's levels to other data; a categorical value that training does not have becomes ``*``."""
    out = generalize(df, hierarchies, vector)
    for a in categorical:
        seen = train.select(F.col(a).alias("__seen")).distinct()
        out = out.join(small(seen, BROADCAST_LEAVES), out[a] == seen["__seen"], "left").withColumn(a, F.when(F.col("__seen").isNull(), ROOT).otherwise(F.col(a))).drop("__seen")
    return out


def generalize_as_released(df: DataFrame, train: DataFrame, hierarchies: Mapping[str, Hierarchy], levels: Sequence[int], qid: Sequence[str]) -> DataFrame:
    """:func:`generalize_like` with the levels that a release's name tells (see ``sources.read_releases``), in the order of ``qid``."""
    if len(levels) != len(qid) or any(not 0 <= level < hierarchies[a].depth for a, level in zip(qid, levels)):
        raise ValueError(f"levels {list(levels)} do not fit {list(qid)}")
    return generalize_like(df, train, hierarchies, dict(zip(qid, levels)), qid)
