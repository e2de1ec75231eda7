"""Near-duplicates by MinHash: minima, bands, signatures, full sets, components.

A document's set holds its distinct runs of five words, lower-cased in A-Z;
with fewer words the whole sequence is the one element; without words the set
is empty and takes no part. Documents link when
``100 * |A & B| >= threshold * |A | B|``.

How links are found without pairs inside large groups:

1. documents with equal sets form a class; one node stands for a class;
2. nodes that share a band are a bucket. In a bucket of at most ``SMALL``
   nodes all pairs are candidates. In a larger one the node with the fewest
   *own* elements (elements that no other node of any large bucket has) is
   the pivot and pairs with each other node;
3. candidates are kept if their signatures agree in ``Plan.near`` of the
   minima, and become links if the full sets say so;
4. nodes of a large bucket that then lie in different components are compared
   in blocks, by signature and then by full sets; a block returns the links
   that join components, not all. Nodes that cannot reach the threshold with
   anyone (too many own elements) are left out: this bound is exact.

Bands and ``near`` follow from the threshold (:func:`plan_for`): two sets just
at it share no band with a probability of at most ``MISS``, and agree in fewer
than ``near`` minima with at most ``MISS``; above it both are rarer.

Cases: rows with a null id get their set size, no component and
``kept = false``; rows that share an id are one node, whose texts all count.
"""

from __future__ import annotations

from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialize, ready
from .components import connected_components

WORDS = 5
MINIMA = 120
#: Greatest probability that two sets just at the threshold share no band, and that the signature check drops them.
MISS = 1e-6
#: Largest bucket of which all pairs are candidates.
SMALL = 8
#: Nodes in one block of the comparison of what is left in large buckets.
BLOCK, BLOCK_SHINGLES = 1500, 2_000_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_MIX = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Plan(NamedTuple):
    rows: int
    bands: int
    near: int


@cache
def plan_for(percent: int) -> Plan:
    """Rows of a band, number of bands, and least number of equal minima, for a threshold in per cent.

    The longest bands of ``MINIMA`` that share none with a probability of at
    most ``MISS`` at the threshold; minima agree there with a binomial law.
    """
    s = percent / 100
    if not 0 < s <= 1 or (1 - s) ** MINIMA > MISS:
        raise ValueError(f"{MINIMA} minima do not find links at {percent} per cent with a miss of {MISS} at most")
    rows = max(r for r in range(1, MINIMA + 1) if MINIMA % r == 0 and (1 - s**r) ** (MINIMA // r) <= MISS)
    near, below = 0, 0.0
    while near < MINIMA and (below := below + comb(MINIMA, near) * s**near * (1 - s) ** (MINIMA - near)) <= MISS:
        near += 1
    return Plan(rows, MINIMA // rows, near)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's shingles."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    if len(h) < words:
        x = np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))], np.uint64)
    else:
        n = len(h) - words + 1
        x = h[:n] * _MIX[0]
        for j in range(1, words):
            x += h[j : j + n] * _MIX[j]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each universal hash ``a * x + b`` over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (_A[:, None] * x[None, k : k + 4096] + _B[:, None]).min(axis=1), out=out)
    return out


def _sketch(df: DataFrame, id_column: str, text_column: str, words: int, plan: Plan) -> DataFrame:
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            n, digest, keys, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    keys.append(None)
                    sigs.append(None)
                    continue
                m = minima(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append([_band_key(m, j, plan.rows) for j in range(plan.bands)])
                sigs.append(m.view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int32()))],
                names=["id", "n", "digest", "bands", "sig"],
            )

    return source.mapInArrow(run, "id long, n long, digest binary, bands array<long>, sig array<int>")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """``(id, n, shingles, sig)`` of ``(id, text)``."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([minima(s).view(np.int32) for s in sets], pa.list_(pa.int32()))],
                names=["id", "n", "shingles", "sig"],
            )

    return df.mapInArrow(run, "id long, n long, shingles array<long>, sig array<int>")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)``, least first, whose signatures and then full sets agree. Many pairs may share ``v``, few share ``u``."""
    side = lambda s, e: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{e}"), F.col("shingles").alias(f"s{e}"), F.col("sig").alias(f"g{e}"))
    degree = materialize(pairs.groupBy("v").agg(F.count("*").alias("pairs")), "degree")
    # signatures alone first: sets travel for the pairs that pass
    close = pairs.join(side("u", 1).select("u", "g1"), "u")
    close = join_by_key(close, degree.join(side("v", 2).select("v", "g2"), "v"), "v", "pairs", "u")
    same = F.aggregate(F.zip_with("g1", "g2", lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, x: t + x)
    close = materialize(close.where(same >= plan_for(percent).near).select("u", "v"), "close")
    both = close.join(side("u", 1).drop("g1"), "u")
    both = join_by_key(both, degree.join(side("v", 2).drop("g2"), "v"), "v", "pairs", "u")
    common = F.size(F.array_intersect("s1", "s2"))
    good = both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("n1") + F.col("n2") - F.col("common")))
    return good.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _band_key(minima_: np.ndarray, band: int, rows: int) -> int:
    part = np.ascontiguousarray(minima_[band * rows : (band + 1) * rows])
    return xxhash.xxh64_intdigest(part.tobytes(), band) - (1 << 63)


def _joins_between(pdf, percent: int):
    """Verified links of one pair of blocks that join two components: at most one a node.

    A pair is looked at in the first band that it shares. Components grow as
    links are found, so pairs inside one are skipped.
    """
    import pandas as pd

    plan = plan_for(percent)
    g = np.stack(pdf.sig.to_numpy())
    bands = g.reshape(len(g), plan.bands, plan.rows)
    band = next(j for j in range(plan.bands) if _band_key(g[0], j, plan.rows) == pdf.key.iloc[0])
    n, own, root, ids, sets = (pdf[c].to_numpy() for c in ("n", "own", "component", "id", "shingles"))
    root = root.copy()
    left, right = (np.flatnonzero(pdf.block == pdf[c].iloc[0]) for c in ("i", "j"))
    u, v = [], []
    for k in left:
        most = np.minimum(n[k] - own[k], n[right] - own[right])
        able = right[(root[right] != root[k]) & (100 * most >= percent * (n[k] + n[right] - most))]
        able = able[(g[able] == g[k]).sum(axis=1) >= plan.near]
        able = able[~(bands[able, :band] == bands[k, :band]).all(axis=2).any(axis=1)]
        for o in able:
            if root[o] == root[k]:
                continue
            common = len(np.intersect1d(sets[k], sets[o], assume_unique=True))
            if 100 * common >= percent * (n[k] + n[o] - common):
                root[root == root[o]] = root[k]
                u.append(min(ids[k], ids[o]))
                v.append(max(ids[k], ids[o]))
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside large buckets, block by block.

    ``members`` holds ``key, id, n, own, component``. A bucket of *k* blocks
    becomes k(k+1)/2 groups of two blocks at most; a block holds few enough
    nodes and shingles for one task.
    """
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks")
    size = members.groupBy("key").agg(blocks, F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size"))
    dealt = (
        join_by_key(members, materialize(size.where("c1 < c2").select("key", "blocks", "size"), "size"), "key", "size", "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "own", "component")
        .join(sets.select("id", "n", "sig", "shingles"), "id")
    )
    return dealt.groupBy("key", "i", "j").applyInPandas(lambda pdf: _joins_between(pdf, percent), "u long, v long").distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85, words: int = WORDS) -> DataFrame:
    """``(id_column, n_shingles, component_id, kept)``, one row a document of ``df``."""
    spark = ready(df.sparkSession)
    sketch = materialize(_sketch(df, id_column, text_column, words, plan_for(percent)), "sketch")
    live = sketch.where("id is not null and n > 0")
    classes = materialize(live.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("size")), "classes")
    member = materialize(join_by_key(live.select("id", "n", "digest"), classes, "digest", "size", "id").select("id", "n", "node"), "member")

    heads = live.join(classes, (live["digest"] == classes["digest"]) & (live["id"] == classes["node"]), "left_semi")
    banded = materialize(heads.select("id", F.explode("bands").alias("key")).distinct(), "banded")
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    bucket = materialize(join_by_key(banded, shared, "key", "size", "id").select("id", "key", "size"), "bucket")

    wanted = bucket.select("id").distinct()
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sets = materialize(_sets(source.join(wanted.hint("shuffle_hash"), "id", "left_semi"), words), "sets").where("n > 0")

    few = bucket.where(F.col("size") <= SMALL)
    other = few.select("key", F.col("id").alias("v"))
    all_pairs = few.select("key", F.col("id").alias("u")).join(other, "key").where("u < v").select("u", "v")

    large = bucket.where(F.col("size") > SMALL).select("key", "id")
    hot = sets.join(large.select("id").distinct(), "id", "left_semi")
    own = (
        hot.select("id", F.explode("shingles").alias("x")).groupBy("x")
        .agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
        .groupBy("id").agg(F.count("*").alias("own"))
    )
    rated = hot.select("id", "n").join(own, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).cast("long").alias("own"))
    rated = materialize(rated.where(f"100 * (n - own) >= {percent} * n"), "rated")
    able = materialize(large.join(rated, "id"), "able")
    pivot = materialize(able.groupBy("key").agg(F.min(F.struct("own", "id"))["id"].alias("pivot"), F.count("*").alias("size")), "pivot")
    stars = join_by_key(able, pivot, "key", "size", "id").where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v"))

    links = _links(materialize(all_pairs.union(stars).distinct(), "pairs"), sets, percent)
    # rows that share an id hold its classes together
    split = member.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("m")).where("u < m")
    same = member.join(split.select("id", "u"), "id").select("u", F.col("node").alias("v"))
    edges = materialize(links.union(same), "links")
    found = materialize(connected_components(edges), "component")

    placed = able.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = materialize(_rest(placed, sets, percent), "links")
    if more.limit(1).count():
        found = materialize(connected_components(edges.union(more)), "component")

    # a class's node is its least id and a component its least node, so the component is its least id
    roots = classes.select("node", "size").groupBy("node").agg(F.sum("size").alias("size")).join(found, "node", "left")
    roots = materialize(roots.select("node", "size", F.coalesce("component", "node").alias("component_id")), "roots")
    filled = materialize(join_by_key(member, roots, "node", "size", "id").select("id", "n", "component_id"), "filled")
    # a text without words counts to its id's other rows, if it has any
    wordless = sketch.where("id is not null and n = 0").select("id", "n")
    others = filled.join(wordless.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("component_id"))
    empty = wordless.join(others, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    nameless = sketch.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    return filled.union(empty).union(nameless).select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"),
    )
