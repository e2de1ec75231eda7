"""Periodic runs of words by a harmonic grid.

A run is a stretch of words in which words ``q`` apart are identical, ``q``
being the least such period, with at least ``max(min_length, min_exponent * q)``
words, that no neighbouring word extends.

How runs are found, for all documents of a batch in one go:

1. words become numbers, and prefix sums of ``word * BASE**place`` modulo a
   prime give the hash of any stretch by one subtraction;
2. of period ``q`` every ``(min_exponent - 1) * q``-th word is a grid point
   ``i``. A run of that period holds both ``i`` and ``i + q`` for one of them,
   so the grid has about ``n / q`` points and all periods together ``n log n``;
3. for all pairs (period, grid point) whose words agree and whose stretches
   are long enough on one side, the longest common extensions of ``i`` and
   ``i + q`` forwards and backwards are binary searched simultaneously;
4. what is long enough is verified word by word. Equal hashes of different
   stretches can only lengthen an extension; where one did, the period is
   read again word by word for its document;
5. stretches found by several grid points, or under a multiple of their least
   period, are one run.

Cases: null and texts without words have no runs and collapse to the empty
text; texts of any length are read whole, ``PAIRS`` pairs at a time; repeated
rows and ids give a row each; null ids are carried along (and never planted);
an empty table gives no rows; further columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import WORD, ready
from .secrets import let

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Pairs (period, grid point) compared at once; bounds the memory of a long text.
PAIRS = 1 << 20
#: Prime modulus below 2**31 (products stay in 63 bits) and base of the prefix hashes.
PRIME, BASE = (1 << 31) - 1, 1_000_003_117

_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def powers(n: int, base: int = BASE, prime: int = PRIME) -> np.ndarray:
    """``base**0 .. base**(n - 1)`` modulo ``prime``, doubled until there are enough."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


class Hashes:
    """Hashes of all stretches of a sequence of numbers."""

    def __init__(self, words: np.ndarray, prime: int = PRIME) -> None:
        self.prime, self.power = prime, powers(len(words) + 1, prime=prime)
        self.prefix = np.concatenate([[0], np.cumsum((words + 1) % prime * self.power[:-1] % prime) % prime])

    def alike(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` words from ``i`` and from ``i + q`` have one hash."""
        h, j = self.prefix, i + q
        return (h[i + length] - h[i]) % self.prime * self.power[q] % self.prime == (h[j + length] - h[j]) % self.prime

    def longest(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Greatest length, at most ``most``, at which words from ``i`` and ``i + q`` agree; with ``back``, words up to and including these."""
        low, high = np.ones_like(i), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) >> 1
            at = i[open_] - mid + 1 if back else i[open_]
            same = self.alike(at, q[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
        return low


def _grids(sizes: np.ndarray, exponent: int):
    """``(document, period, grid points)`` of all documents, in slices of about ``PAIRS`` grid points."""
    most = sizes // exponent
    document = np.repeat(np.arange(len(sizes)), most)
    period = ragged(np.ones_like(most), most)
    points = (sizes[document] - period - 1) // ((exponent - 1) * period) + 1
    total = np.cumsum(points)
    at = 0
    while at < len(period):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        yield document[at:to], period[at:to], points[at:to]
        at = to


def _scan(words: np.ndarray, lo: int, hi: int, q: int, need: int) -> list[tuple[int, int, int]]:
    """Stretches of period ``q`` in ``words[lo:hi]``, read word by word."""
    same = np.concatenate([[False], words[lo : hi - q] == words[lo + q : hi], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(lo + s, e - s + q, q) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e - s + q >= need]


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run, by start and period, for each document of ``sizes`` words, laid end to end."""
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    ends = np.cumsum(sizes)
    begins = ends - sizes
    found: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    if not len(words):
        return [[] for _ in sizes]
    hashes = Hashes(words)
    for document, period, points in _grids(sizes, exponent):
        q = np.repeat(period, points)
        d = np.repeat(document, points)
        i = begins[d] + ragged(np.zeros_like(points), points) * (exponent - 1) * q
        live = np.flatnonzero(words[i] == words[i + q])
        i, q, d = i[live], q[live], d[live]
        # an extension over half of what is missing, on one side at least
        need = np.maximum(min_length, exponent * q)
        half = np.maximum((need - q + 2) >> 1, 1)
        ahead, behind = ends[d] - i - q, i - begins[d] + 1
        able = np.zeros(len(i), bool)
        k = np.flatnonzero(half <= ahead)
        able[k] = hashes.alike(i[k], q[k], half[k])
        k = np.flatnonzero(~able & (half <= behind))
        able[k] = hashes.alike(i[k] - half[k] + 1, q[k], half[k])
        i, q, d, need, ahead, behind = (x[able] for x in (i, q, d, need, ahead, behind))
        forward = hashes.longest(i, q, ahead, back=False)
        backward = hashes.longest(i, q, behind, back=True)
        start, length = i - backward + 1, forward + backward - 1 + q
        long = length >= need
        each = np.unique(np.stack([d[long], q[long], start[long], length[long]]), axis=1).T.tolist()
        again = set()
        for doc, p, s, n in each:
            if (doc, p) in again:
                continue
            if np.array_equal(words[s : s + n - p], words[s + p : s + n]):
                stretches = [(s, n, p)]
            else:  # two stretches with one hash
                again.add((doc, p))
                stretches = _scan(words, int(begins[doc]), int(ends[doc]), p, max(min_length, exponent * p))
            for s, n, p in stretches:
                key = (s - int(begins[doc]), n)
                found[doc][key] = min(p, found[doc].get(key, p))
    return [[(s, n, p) for (s, n), p in sorted(f.items(), key=lambda x: (x[0][0], x[1]))] for f in found]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``(id_column, n_words, runs, strongest, collapsed)``, one row a document.

    ``runs`` lists ``(start, length, period)`` in words by start and period,
    ``strongest`` is the one of greatest length / period (null without runs),
    ``collapsed`` the words that stay when every run keeps its first period
    only, joined by one space. No shuffle: a document stays in its task.
    """
    ready(df.sparkSession)
    source = df.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))
    three = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            number = defaultdict(count().__next__)
            texts = [t.encode().split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
            found = runs_of(words, sizes, min_length, min_exponent)
            collapsed = [b" ".join(compress(t, kept_words(len(t), r).tolist()) if r else t) for t, r in zip(texts, found, strict=True)]
            record = lambda r: dict(zip(("start", "length", "period"), r))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([[record(r) for r in f] for f in found], pa.list_(three)),
                    pa.array([record(b) if (b := strongest(f)) else None for f in found], three),
                    pa.array(collapsed, pa.string()),
                ],
                names=["__id", "n_words", "runs", "strongest", "collapsed"],
            )

    kind = df.schema[id_column].dataType.simpleString()
    out = source.mapInArrow(run, f"__id {kind}, n_words long, runs {_RUN}, strongest {_RUN[6:-1]}, collapsed string")
    return out.withColumnRenamed("__id", id_column)


def planted(id_: Column, text: Column) -> Column:
    """``text``, of which a tenth of the ids has its words repeated with a period that follows from the id.

    With h the CRC-32 of the decimal id and g = h div 10: where h is divisible
    by ten, word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) div (3 + g % 8) of n words.
    """
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / F.lit(10))

    def repeat(words: Column) -> Column:
        n = F.size(words)
        at = F.struct((g % n).cast("int").alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("int").alias("p"))
        moved = lambda s: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]))
        )
        return F.when(n > 0, F.array_join(let(at, moved), " ")).otherwise(F.lit(""))

    changed = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeat)
    return F.when(h % 10 == 0, changed).otherwise(text)


def run_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number, strongest, and digests of the runs of every text after :func:`planted`."""
    rows = df.select(F.col(id_column).alias("doc_id"), planted(F.col(id_column), F.col(text_column)).alias("text"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    said = F.array_join(F.transform("runs", line), "")
    return find_runs(rows).select(
        F.col("doc_id").alias(id_column),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"strongest.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
