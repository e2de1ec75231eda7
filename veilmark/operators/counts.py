"""Count queries: exact on original data, estimated on generalised data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.draws import seeded

from .stages import staged

#: Queries of one workload, and bytes of the bit sets and shares that tasks hold at once.
WORKLOAD, TABLE_BYTES = 2000, 64 << 20


def random_workload(leaves: DataFrame, n: int = WORKLOAD, seed: int = 69) -> DataFrame:
    """``(query_id, column, leaf)``: ``n`` conjunctions of IN lists, each over 1 to all columns and 1 to all leaves of each.

    ``leaves`` has ``column, leaf``. Columns and leaves are chosen by the order
    of seeded hashes, so another engine can repeat the workload. The result is
    as large as workload times domains.
    """
    q = F.col("query_id")
    asked = leaves.distinct().withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    column = seeded(F.concat_ws("|", q, "column"), seed)
    drawn = asked.withColumn("c", column).withColumn("x", seeded(F.concat_ws("|", q, "column", "leaf"), seed))
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("c", "column"))
    nth = F.row_number().over(Window.partitionBy("query_id", "column").orderBy("x", "leaf"))
    placed = drawn.withColumn("rank", rank).withColumn("nth", nth)
    per = leaves.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("size"))
    columns = per.agg(F.count(F.lit(1)).alias("columns"))  # one row
    sized = placed.join(F.broadcast(per), "column").crossJoin(F.broadcast(columns))  # a row for each column
    few = F.col("rank") <= F.pmod(seeded(q, "columns", seed), F.col("columns")) + 1
    return sized.where(few & (F.col("nth") <= F.pmod(seeded(F.concat_ws("|", q, "column"), "leaves", seed), F.col("size")) + 1)).select("query_id", "column", "leaf")


def _shares(filters: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, column, node, p)``: the share of a node's leaves that the IN list holds.

    ``nodes`` has ``column, node, leaf``; the result is as large as workload times domain.
    """
    sizes = nodes.groupBy("column", "node").agg(F.count_distinct("leaf").alias("n"))
    hits = filters.join(nodes.distinct(), ["column", "leaf"]).groupBy("query_id", "column", "node").agg(F.count_distinct("leaf").alias("k"))
    return hits.join(sizes, ["column", "node"]).select("query_id", "column", "node", (F.col("k") / F.col("n")).alias("p"))


def _tables(shares: DataFrame, columns: Sequence[str], ids: Sequence[int], asked: Mapping[str, set[int]]) -> dict[str, tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]]:
    """For every column: the row of each node, its bit set of queries, the row of its shares (-1: all are 1), and these shares.

    The last bit set is that of nodes which no query names: the queries that
    do not ask the column.
    """
    place = {q: i for i, q in enumerate(ids)}
    found: dict[str, dict[str, list]] = {c: {} for c in columns}
    rows = shares.groupBy("column", "node").agg(F.collect_list(F.struct("query_id", "p")).alias("hits"))
    for r in rows.collect():
        found[r["column"]][r["node"]] = r["hits"]
    out = {}
    for c in columns:
        row = {node: i for i, node in enumerate(found[c])}
        hit = np.zeros((len(row) + 1, len(ids)), bool)
        hit[:, [i for q, i in place.items() if q not in asked.get(c, ())]] = True
        part, own = np.full(len(row) + 1, -1), []
        for node, i in row.items():
            at = [place[h["query_id"]] for h in found[c][node]]
            hit[i, at] = True
            if any(h["p"] < 1 for h in found[c][node]):
                part[i] = len(own)
                p = np.ones(len(ids))
                p[at] = [h["p"] for h in found[c][node]]
                own.append(p)
        out[c] = row, np.packbits(hit, axis=1), part, np.array(own).reshape(-1, len(ids))
    return out


def _total(combos: DataFrame, columns: Sequence[str], ids: Sequence[int], tables: Mapping[str, tuple]) -> DataFrame:
    """``(query_id, estimate)`` of combinations and one batch of queries: a task sends one sum a query."""

    def run(batches):
        total, seen = np.zeros(len(ids)), False
        for batch in batches:
            n = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(float)
            rows = []
            for k, c in enumerate(columns):
                own = batch.column(k).dictionary_encode()
                names = np.array([tables[c][0].get(v, len(tables[c][0])) for v in own.dictionary.to_pylist()] + [len(tables[c][0])])
                rows.append(names[own.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)])
            for at in range(0, len(n), 2048):
                part = [r[at : at + 2048] for r in rows]
                bits = tables[columns[0]][1][part[0]]
                for k in range(1, len(columns)):
                    bits &= tables[columns[k]][1][part[k]]
                combo, query = np.nonzero(np.unpackbits(bits, axis=1, count=len(ids)))
                weight = n[at : at + 2048][combo]
                for k, c in enumerate(columns):
                    fraction = tables[c][2][part[k][combo]]
                    some = np.flatnonzero(fraction >= 0)
                    weight[some] *= tables[c][3][fraction[some], query[some]]
                total += np.bincount(query, weight, minlength=len(ids))
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.array(total)], names=["query_id", "estimate"])

    rows = combos.select(*[F.col(c).cast("string") for c in columns], "n")
    return rows.mapInArrow(run, "query_id long, estimate double").groupBy("query_id").agg(F.sum("estimate").alias("estimate"))


def estimate(combos: DataFrame, columns: Sequence[str], filters: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, estimate)``: sum over value combinations of count times the product of shares.

    ``combos`` has one row a combination of ``columns`` with its count ``n``.
    For every column and node there is a bit set of the queries that hold a
    leaf of it or do not ask the column. A task ANDs the bit sets of a
    combination's nodes and multiplies shares only for the queries that are
    left, so predicates on original columns filter first; it sends one sum a
    query, whatever the number of combinations is. Queries are taken in batches
    whose bit sets and shares stay within ``TABLE_BYTES``. On original data
    every share is 0 or 1 and the estimate is the exact count.
    """
    asked: dict[str, set[int]] = {}
    # a row for each query and column
    for r in filters.select("query_id", "column").distinct().collect():
        asked.setdefault(r["column"], set()).add(r["query_id"])
    if unknown := set(asked) - set(columns):
        raise ValueError(f"queries ask for unknown columns {sorted(unknown)}")
    ids = sorted(set().union(*asked.values()))
    if not ids:
        return filters.select("query_id", F.lit(0.0).alias("estimate")).limit(0)
    shares = staged(_shares(filters, nodes), "shares")
    size = shares.groupBy("column", "node").agg(F.min("p").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") < 1).alias("parts")).first()
    batch = max(1, int(TABLE_BYTES // (size["n"] + 8 * size["parts"] + 1)))
    out = None
    for at in range(0, len(ids), batch):
        some = ids[at : at + batch]
        tables = _tables(shares.where(F.col("query_id").between(some[0], some[-1])), columns, some, asked)
        part = _total(combos, columns, some, tables)
        out = part if out is None else out.unionByName(part)
    every = filters.select("query_id").distinct()
    return every.join(out, "query_id", "left").select("query_id", F.coalesce("estimate", F.lit(0.0)).alias("estimate"))


def exact(df: DataFrame, predicates: dict[int, Column], batch: int = 100) -> DataFrame:
    """``(query_id, count)`` of arbitrary predicates: one scan for each batch of queries."""
    ids, out = sorted(predicates), None
    for k in range(0, len(ids), batch):
        part = ids[k : k + batch]
        row = df.agg(*[F.count_if(predicates[q]).alias(str(q)) for q in part])
        long = row.select(F.explode(F.array(*[F.struct(F.lit(q).cast("long").alias("query_id"), F.col(str(q)).alias("count")) for q in part])).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out


def relative_error(real: DataFrame, estimated: DataFrame) -> DataFrame:
    """Mean of ``|real - estimate| / real`` over the queries whose real count is not 0."""
    both = real.select("query_id", F.col("estimate").alias("real")).join(estimated, "query_id")
    return both.agg(F.avg(F.when(F.col("real") != 0, F.abs(F.col("real") - F.col("estimate")) / F.col("real"))).alias("relative_error"))
