"""Nearest neighbours between two tables under any distance expression.

Both sides are dealt to blocks, and each cell of the grid of blocks is one
task's work: memory is bounded by a block whatever the sizes, and the number of
tasks follows the number of cells, not the bytes of the inputs. Where records
repeat, distances are computed between distinct combinations of the compared
columns only. Aggregates over cells are combined inside tasks.

Where the distance is given as a :class:`~veilmark.operators.pruned.Metric`,
its lower bounds rule out most of the pairs instead (see there); a distance
that is a bare expression has no bounds and takes the whole grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pruned import Metric, near_pairs
from .stages import staged

#: Rows of a block, and tasks of one grid at most.
CELL_ROWS, MOST_TASKS = 1024, 20_000
#: Groups of candidates whose minima bound the k-th distance.
GROUPS = 64
#: Room for rounding when unrounded distances are compared with a bound.
ROOM = 1e-8


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _grid(query: DataFrame, cand: DataFrame, cell_rows: int) -> DataFrame:
    """Every row of ``query`` with every row of ``cand``; columns keep their names."""
    rows, cols = (max(1, -(-d.count() // cell_rows)) for d in (query, cand))
    tasks = min(rows * cols, MOST_TASKS)
    deal = lambda d, n: F.pmod(F.xxhash64(*d.columns), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = query.withColumn("__row", deal(query, rows)).withColumn("__col", each(cols))
    right = cand.withColumn("__col", deal(cand, cols)).withColumn("__row", each(rows))
    cell = (F.col("__row") * cols + F.col("__col")).alias("__cell")
    # an explicit number of partitions is not merged again
    left, right = (d.select(*names, cell).repartition(tasks, "__cell") for d, names in ((left, query.columns), (right, cand.columns)))
    return left.join(right.hint("shuffle_hash"), "__cell").drop("__cell")


def pairs(query: DataFrame, cand: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every query row (columns ``q_*``) with every candidate row (columns ``c_*``).

    Meant for distinct value combinations or bounded query sets: its cost is
    the product of the sizes.
    """
    return _grid(_renamed(query, "q"), _renamed(cand, "c"), cell_rows)


def _same(names: Sequence[str], left: str = "", right: str = "q_") -> list[Column]:
    return [F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}")) for n in names]


def _rounded(d: Column, digits: int | None) -> Column:
    return d if digits is None else F.round(d, digits)


def top_k(
    query: DataFrame, cand: DataFrame, distance: Column | Metric, k: int, query_id: str = "rid", cand_id: str = "rid", digits: int | None = 9, exclude_self: bool = False, keys: Sequence[str] | None = None
) -> DataFrame:
    """``(query_id, rank, cand_id, dist)``: the ``k`` nearest candidates, ties by the candidate's id.

    ``distance`` refers to ``q_*`` and ``c_*`` columns of ``keys`` (default:
    all shared columns but the ids) and is rounded, so that ties do not depend
    on the order of additions. Of a metric, only pairs within its bounds are
    looked at. Of an expression, a first pass over the grid takes the minimum of
    ``GROUPS`` groups of candidates; the ``k``-th smallest of these bounds the
    ``k``-th distance, and only pairs within the bound are ranked in a second
    pass. Candidates that agree in all keys count as one, with their least ids;
    so do queries. A query that must not meet itself is dropped from the
    ``k + 1`` nearest of its combination, so its search is that of the others.
    """
    pruned = isinstance(distance, Metric)
    names = distance.keys if pruned else list(keys) if keys is not None else [c for c in query.columns if c in cand.columns and c not in (query_id, cand_id)]
    most = k + 1 if exclude_self else k
    # tasks keep ``most`` ids of a combination before the shuffle
    first = Window.partitionBy(*names).orderBy(cand_id)
    few = cand.select(*names, cand_id).withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= most)
    c = few.groupBy(*names).agg(F.sort_array(F.collect_list(cand_id)).alias("ids"))
    q, c = _renamed(query.select(*names).distinct(), "q"), _renamed(c, "c").withColumn("c_first", F.element_at("c_ids", 1))
    by = q.columns
    near = near_pairs(q, c, distance, most) if pruned else _within_bound(q, c, distance, most, F.lit(True))
    each = near.select(*by, _rounded(F.col("dist"), digits).alias("dist"), F.explode("c_ids").alias("cand_id"))
    w = Window.partitionBy(*by).orderBy("dist", "cand_id")
    best = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    if exclude_self:
        # ``most`` of a combination
        ranked = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "cand_id", "dist"))).alias("__best"))
        others = F.slice(F.filter("__best", lambda b: b["cand_id"] != F.col("query_id")), 1, k)
        rows = query.select(F.col(query_id).alias("query_id"), *names).join(ranked, _same(names)).select("query_id", F.posexplode(others).alias("rank", "b"))
        out = rows.select("query_id", F.col("rank") + 1, "b.cand_id", "b.dist").toDF("query_id", "rank", "cand_id", "dist")
    else:
        out = query.select(F.col(query_id).alias("query_id"), *names).join(best, _same(names)).select("query_id", "rank", "cand_id", "dist")
    return out.withColumn("rank", F.col("rank").cast("long"))


def _within_bound(q: DataFrame, c: DataFrame, distance: Column, k: int, apart: Column) -> DataFrame:
    """All pairs of the grid whose distance is within the bound of the query's ``k``-th."""
    by = q.columns
    group = F.pmod(F.xxhash64("c_first"), F.lit(GROUPS))
    least = _grid(q, c, CELL_ROWS).where(apart).groupBy(*by, group.alias("__group")).agg(F.min(distance).alias("d"))
    bound = least.groupBy(*by).agg(F.sort_array(F.collect_list("d")).alias("d"))  # GROUPS numbers at most
    bound = bound.select(*[F.col(n).alias(f"b_{n}") for n in by], F.when(F.size("d") >= k, F.get("d", F.lit(k - 1)) + ROOM).alias("bound"))
    bounded = q.join(bound, _same(by, right="b_")).select(*by, "bound")
    near = _grid(bounded, c, CELL_ROWS).where(apart).withColumn("dist", distance)
    return near.where(F.col("bound").isNull() | (F.col("dist") <= F.col("bound")))


def _combinations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def _spread(df: DataFrame, keys: Sequence[str], found: DataFrame, row_id: str) -> DataFrame:
    """``(query_id, dist)`` for every row, from ``(q_keys, dist)``; nulls are values too."""
    return df.select(F.col(row_id).alias("query_id"), *keys).join(found, _same(keys)).select("query_id", "dist")


def nearest(query: DataFrame, cand: DataFrame, distance: Column | Metric, keys: Sequence[str] | None = None, query_id: str = "rid", digits: int | None = 9) -> DataFrame:
    """``(query_id, dist)``: the least distance only, by hash aggregates without a sort.

    A combination is as near to the candidates as each of its rows, so the
    grid holds combinations of the compared columns, not rows.
    """
    if isinstance(distance, Metric):
        keys, least = distance.keys, F.min("dist")
        p = near_pairs(_renamed(query.select(*keys).distinct(), "q"), _renamed(cand.select(*keys).distinct(), "c"), distance)
    else:
        least = F.min(distance)
        p = pairs(query.select(*keys).distinct(), cand.select(*keys).distinct())
    found = p.groupBy(*[f"q_{c}" for c in keys]).agg(_rounded(least, digits).alias("dist"))
    return _spread(query, keys, found, query_id)


def nearest_both_ways(query: DataFrame, cand: DataFrame, distance: Column | Metric, keys: Sequence[str] | None = None, row_id: str = "rid", digits: int | None = 9) -> tuple[DataFrame, DataFrame]:
    """:func:`nearest` from ``query`` to ``cand`` and back.

    Of an expression both minima are taken side by side from one grid, which
    is written; a metric is searched once each way, as it sees few pairs.
    """
    if isinstance(distance, Metric):
        return nearest(query, cand, distance, query_id=row_id, digits=digits), nearest(cand, query, distance, query_id=row_id, digits=digits)
    left, right = [f"q_{c}" for c in keys], [f"c_{c}" for c in keys]
    p = pairs(query.select(*keys).distinct(), cand.select(*keys).distinct()).withColumn("__d", distance)
    both = p.groupingSets([[F.col(c) for c in left], [F.col(c) for c in right]], *left, *right)
    minima = both.agg(F.min("__d").alias("dist"), F.grouping(left[0]).alias("back")).withColumn("dist", _rounded(F.col("dist"), digits))
    minima = staged(minima, "minima")
    there = minima.where("back = 0").select(*left, "dist")
    back = minima.where("back = 1").select(*[F.col(f"c_{c}").alias(f"q_{c}") for c in keys], "dist")
    return _spread(query, keys, there, row_id), _spread(cand, keys, back, row_id)


def nearest_other(df: DataFrame, distance: Column | Metric, keys: Sequence[str] | None = None, row_id: str = "rid", digits: int | None = 9) -> DataFrame:
    """``(query_id, dist)``: the least distance to another row of the same table, 0 where a combination repeats."""
    pruned = isinstance(distance, Metric)
    keys = distance.keys if pruned else keys
    c = _combinations(df, keys)
    if pruned:
        # a combination that repeats is at distance 0 already
        single = _renamed(c.where("__n = 1").drop("__n"), "q")
        p = near_pairs(single, _renamed(c.drop("__n"), "c"), distance, 1, ~_all(_same(keys, "c_")))
    else:
        p = pairs(c, c.drop("__n")).where(~_all(_same(keys, "c_"))).withColumn("dist", distance)
    other = p.groupBy(*[f"q_{k}" for k in keys]).agg(_rounded(F.min("dist"), digits).alias("dist"))
    single = c.select(*[F.col(k).alias(f"c_{k}") for k in keys], "__n").join(other, _same(keys, "c_"), "left")
    found = single.select(*[F.col(f"c_{k}").alias(f"q_{k}") for k in keys], F.when(F.col("__n") > 1, 0.0).otherwise(F.col("dist")).alias("dist")).where("dist is not null")
    return _spread(df, keys, found, row_id)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
