"""Near-duplicates by SimHash, compared in vertical bit planes.

A document's words (A-Z lower-cased) give shingles of three words, repeats
included, joined by a space; with fewer words the whole sequence is the one
shingle. A bit of the fingerprint is 1 if it is set in over half of the
shingles' XXH64 (seed 42). Documents link when their fingerprints differ in
``radius`` bits at most; without words the fingerprint is zero and links like
any other.

How links are found:

1. equal fingerprints are one node, counted inside tasks first, so copies of
   any number cost one row;
2. ``radius`` differing bits lie in at most ``radius`` of the eight bytes. For
   every choice of so many bytes the others are a key: two fingerprints within
   the radius share one of these keys. Keys leave ``8 * radius`` bits free,
   which bounds a group by ``2 ** (8 * radius)`` fingerprints, whatever the
   corpus is; the rows are dealt by key, in order;
3. the members of groups lie end to end in lanes, 64 to a block, each block
   as 64 words, one a bit plane. A member meets every block of its group that
   has later members: for each plane the lanes that differ are added to
   carry-save counters, distances of 64 lanes at once, and every
   ``LOOK`` planes the blocks are abandoned in which all lanes exceed the
   radius;
4. a link is kept under the first of the keys that it shares. A fingerprint
   has at most 136 partners in a group at radius 2, so links grow with nodes;
5. components are joined by alternating large-star and small-star.

This is exact: no candidate is capped, sampled or missed.

Cases: null texts count as empty; texts of any length are hashed whole;
repeated rows and rows that share an id get a row each; rows with a null id
link like others, but give no component its name (null if no row with an id is
reachable); an empty table gives no rows; further columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import join_by_key, materialize, ready
from .components import connected_components

WORDS, SEED, RADIUS = 3, 42, 2
#: Planes between two looks at which blocks may be abandoned.
LOOK = 8
#: Pairs (member, block) that are compared at once, and rows gathered before they are.
PAIRS, ROWS = 1 << 18, 1 << 15

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    stops = np.cumsum(sizes) - 1
    starts = stops - sizes + 1
    if len(parts) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    shingles = [joined[a:b] for a, b in zip(starts[: len(parts) - words + 1].tolist(), stops[words - 1 :].tolist())]
    return majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # as many ones as a byte can count
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """``(id_column, print long)``, the fingerprint's 64 bits as a signed number, one row a document."""
    ready(df.sparkSession)
    source = df.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["__id", "print"])

    return source.mapInArrow(run, f"__id {df.schema[id_column].dataType.simpleString()}, print long").withColumnRenamed("__id", id_column)


def key_masks(radius: int = RADIUS) -> np.ndarray:
    """For every choice of ``radius`` bytes, the mask of the other bytes."""
    if not 0 <= radius <= 2:
        raise ValueError("a radius of 0, 1 or 2 keeps groups bounded")
    return np.array([_ALL ^ np.uint64(sum(0xFF << 8 * b for b in gone)) for gone in combinations(range(8), radius)], np.uint64)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """``planes[block, k]``: bit k of the block's 64 fingerprints, one a lane."""
    blocks = -(-len(prints) // 64)
    padded = np.zeros(blocks * 64, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def within(planes: np.ndarray, prints: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Of ``lanes`` those of ``block`` that differ from ``prints`` in ``radius`` bits at most, for many pairs at once."""
    out = np.zeros(len(prints), np.uint64)
    at, alive = np.arange(len(prints)), lanes.copy()
    digits = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length() or 1)]
    for k in range(64):
        carry = planes[block[at], k] ^ (np.uint64(0) - (prints[at] >> np.uint64(k) & np.uint64(1)))
        for d in digits:  # one more for the lanes that differ
            carry, d[:] = d & carry, d ^ carry
        alive &= ~carry
        if k % LOOK == LOOK - 1:
            more, equal = np.zeros_like(alive), np.full_like(alive, _ALL)
            for bit in range(len(digits) - 1, -1, -1):  # counters above the radius
                if radius >> bit & 1:
                    equal &= digits[bit]
                else:
                    more |= equal & digits[bit]
                    equal &= ~digits[bit]
            alive &= ~more
            left = np.flatnonzero(alive)
            if len(left) < len(at):
                at, alive, digits = at[left], alive[left], [d[left] for d in digits]
    out[at] = alive
    return out


def close_in_groups(prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(p, q)``, p < q, of all fingerprints of one group within the radius; groups lie end to end up to ``ends``."""
    size = np.diff(ends, prepend=0)
    end = np.repeat(ends, size)
    planes = bit_planes(prints)
    member = np.flatnonzero(np.arange(len(prints)) + 1 < end)
    first, last = (member + 1) >> 6, (end[member] - 1) >> 6
    met = np.cumsum(last - first + 1)
    u, v, at = [], [], 0
    while at < len(member):
        to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS, "right")))
        blocks = last[at:to] - first[at:to] + 1
        p, block = np.repeat(member[at:to], blocks), ragged(first[at:to], blocks)
        low, high = np.maximum(p + 1 - 64 * block, 0), np.minimum(end[p] - 64 * block, 64)
        lanes = (_ALL << low.astype(np.uint64)) & (_ALL >> (64 - high).astype(np.uint64))
        near = within(planes, prints[p], block, lanes, radius)
        hit = np.flatnonzero(near)
        row, lane = np.nonzero(np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        u.append(p[hit[row]])
        v.append(64 * block[hit[row]] + lane)
        at = to
    none = np.empty(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted rows ``(table, part, ...)``, ``ROWS`` and more at a time, cut between groups; a group is bounded by its free bits."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        rows += batch.num_rows
        if rows < ROWS:
            continue
        cols = tuple(np.concatenate(c) for c in zip(*held))
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield tuple(c[:cut] for c in cols)
        held = [tuple(c[cut:] for c in cols)]
        rows = 0  # wait for as many new rows, so that a long group is not joined anew for each batch
    if held and len(held[0][0]) + rows:
        yield tuple(np.concatenate(c) for c in zip(*held))


def close_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v, distance)``: every pair of the distinct fingerprints in column ``print`` within the radius, once."""
    ready(prints.sparkSession)
    masks = key_masks(radius)
    # the table's number and the bytes kept
    choices = F.array(*[F.struct(F.lit(t).alias("table"), F.col("print").bitwiseAND(F.lit(int(m.astype(np.int64)))).alias("part")) for t, m in enumerate(masks)])
    keyed = prints.select("print", F.explode(choices).alias("key")).select("key.table", "key.part", "print")
    dealt = keyed.repartition("table", "part").sortWithinPartitions("table", "part", "print")

    def run(batches):
        for table, part, x in _whole_groups(batches):
            new = np.flatnonzero((table[1:] != table[:-1]) | (part[1:] != part[:-1])) + 1
            ends = np.append(new, len(x))
            size = np.diff(ends, prepend=0)
            several = np.repeat(size > 1, size)
            own, of = x[several].view(np.uint64), table[several]
            p, q = close_in_groups(own, np.cumsum(size[size > 1]), radius)
            differ = own[p] ^ own[q]
            first = ((differ[:, None] & masks[None, :]) == 0).argmax(axis=1)
            keep = first == of[p]
            p, q, differ = p[keep], q[keep], differ[keep]
            distance = np.unpackbits(differ.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[p].view(np.int64)), pa.array(own[q].view(np.int64)), pa.array(distance)], names=["u", "v", "distance"])

    return dealt.mapInArrow(run, "u long, v long, distance long")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``(id_column, fingerprint, component_id)``, one row a document; the component is the smallest id reachable."""
    rows = fingerprints(df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")), "id", "text", words)
    rows = materialize(rows, "prints")
    classes = materialize(rows.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("size")), "classes")
    links = materialize(close_prints(classes.select("print"), radius), "links")
    found = connected_components(links.select("u", "v")).withColumnRenamed("node", "print")
    placed = classes.join(found, "print", "left").select("print", "least", "size", F.coalesce("component", "print").alias("root"))
    placed = materialize(placed, "placed")
    roots = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    named = materialize(join_by_key(placed, roots, "root", "n", "print").select("print", "component_id", "size"), "named")
    return join_by_key(rows, named, "print", "size", "id").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
