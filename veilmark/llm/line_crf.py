"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score depends on its own
features and on those of its neighbours; a transition table joins the labels
of adjacent lines. The marginals of forward-backward, weighted by line
length, give a document's share of good text, and a logistic curve turns the
share into the probability of label 1.

Only documents carry labels. Training starts from every line having its
document's label; then, twice, the lines of bad documents are labelled anew by
the model and the field is fitted again. A bad document in which the model
finds no bad line keeps all its lines bad, so rare kinds of junk stay in sight.

The model is fitted on the driver from at most ``limit`` labelled rows, the
first by a hash of their ids; both bounds, that and ``lines``, are parameters
of :func:`train`. Rows of any length take part: tasks turn them into line
features, and of a text of more than ``lines`` lines they send evenly spread
stretches of adjacent lines, each with its true neighbours. Scoring is one pass
over whole texts without a shuffle.

Cases: a null text counts as empty; an empty text is one line of length 0 and
gets a score like any other; null ids and labels are not trained on; an id with
several labels counts as bad if one of them is; rows that share an id are rows
of their own. If the sample holds one class only, every score is that class's
smoothed share; if it is empty (no labelled row, an empty table) a warning says
so and every score is 1, as nothing can be rejected on no ground. A score of
exactly ``THRESHOLD`` predicts 1. Equal texts have equal scores whatever
surrounds them. Further columns of either table are neither read nor changed,
whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ready

#: Labelled rows that the field is fitted on, and lines of one of them, at most.
TRAIN_DOCS, TRAIN_LINES = 3000, 192
#: Adjacent lines in one stretch of a longer text.
STRETCH = 32
THRESHOLD = 0.7
#: Bytes of text whose features are computed at once; a longer line stays whole.
CHUNK_BYTES = 1 << 21

#: Byte classes: lower or beyond ASCII, upper, digit, blank, sentence mark, bar, other mark.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'-"]] = 4
_CLASS[ord("|")] = 5
_OWN = 13
FEATURES = 3 * _OWN + 2


def _own_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A line's own features and its length, for every line of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    new = np.flatnonzero(raw == 10)
    begins, ends = np.append(0, new + 1), np.append(new, len(raw))
    lengths = ends - begins
    which = np.repeat(np.arange(len(begins)), np.append(lengths[:-1] + 1, lengths[-1]))
    kinds = np.bincount(which * 7 + _CLASS[raw], minlength=7 * len(begins)).reshape(-1, 7).astype(float)
    kinds[:-1, 3] -= 1  # the line's own end
    words, repeated, distinct = np.zeros(len(begins)), np.zeros(len(begins)), np.zeros(len(begins))
    for i, line in enumerate(data.split(b"\n")):
        w = line.split()
        words[i], distinct[i] = len(w), len(set(w))
        repeated[i] = sum(map(eq, w, w[1:]))
    n, w = np.maximum(lengths, 1), np.maximum(words, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    own = np.stack(
        [
            kinds[:, 6] / n, kinds[:, 6] / n > 0.04, kinds[:, 1] / letters, kinds[:, 1] / letters > 0.5, kinds[:, 2] / n,
            kinds[:, 5] / n, kinds[:, 5] > 1, repeated / w, repeated / w > 0.3, 1 - distinct / w,
            np.log1p(lengths) / 8, np.minimum((n - kinds[:, 3]) / w, 40) / 10, lengths == 0,
        ],
        axis=1,
    ).astype(float)
    return own, lengths


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features with two marks (first line, last line of its text), lengths, and lines by text."""
    data, at, parts = b"\n".join(texts), 0, []
    while True:
        cut = data.find(b"\n", at + CHUNK_BYTES)
        parts.append(_own_features(data[at:cut] if cut >= 0 else data[at:]))
        if cut < 0:
            break
        at = cut + 1
    counts = np.array([t.count(b"\n") + 1 for t in texts])
    stops = np.cumsum(counts)
    marks = np.zeros((stops[-1], 2))
    marks[stops - counts, 0], marks[stops - 1, 1] = 1, 1
    return np.concatenate([np.concatenate([p[0] for p in parts]), marks], axis=1), np.concatenate([p[1] for p in parts]), counts


def _with_neighbours(rows: np.ndarray) -> np.ndarray:
    """All features of lines whose neighbours stand before and behind them in ``rows``."""
    own, first, last = rows[:, :_OWN], rows[:, _OWN] > 0, rows[:, _OWN + 1] > 0
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1)), (first & last)[:, None]], axis=1)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, line lengths, and lines by text."""
    rows, lengths, counts = _lines(texts)
    return _with_neighbours(rows), lengths, counts


def _stretches(n: int, lines: int) -> list[tuple[int, int]]:
    """Bounds of evenly spread stretches of ``n`` lines, of at most ``lines`` lines in all (rounded up to a stretch)."""
    if n <= lines:
        return [(0, n)]
    k = -(-lines // STRETCH)
    starts = np.linspace(0, n - STRETCH, k).astype(int)
    return [(int(b), int(b) + STRETCH) for b in np.unique(starts)]


def _sampled(text: bytes, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths and stretch sizes of a text's sampled lines."""
    rows, lengths, _ = _lines([text])
    x = _with_neighbours(rows)
    cuts = _stretches(len(x), lines)
    return np.concatenate([x[b:e] for b, e in cuts]), np.concatenate([lengths[b:e] for b, e in cuts]), np.array([e - b for b, e in cuts])


@dataclass
class Field:
    """Weights of label *bad* against *good*, transitions, and the curve from share to score."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)
    constant: float | None = None

    def marginals(self, x: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(bad) by line; with ``pairs`` also the expected transitions and the log-likelihood's normaliser.

        All documents advance together, one line at a time, longest first.
        """
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        s = np.clip(x @ self.weights, -30, 30)
        emit = np.stack([np.ones(len(s)), np.exp(s)], axis=1)
        move = np.exp(self.moves)
        alive = [int(k) for k in np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")]
        forward = np.empty_like(emit)
        now = None
        for t, k in enumerate(alive):
            at = starts[:k] + t
            now = emit[at] if t == 0 else (now[:k] @ move) * emit[at]
            now = now / now.sum(axis=1, keepdims=True)
            forward[at] = now
        backward = np.ones_like(emit)
        expected = np.zeros((2, 2))
        nxt = None
        for t in range(len(alive) - 2, -1, -1):
            k = alive[t + 1]
            at = starts[:k] + t
            low = np.ones((k, 2))
            if nxt is not None:
                low[: len(nxt)] = nxt
            inner = emit[at + 1] * low
            if pairs:
                joint = forward[at][:, :, None] * move[None] * inner[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            value = inner @ move.T
            nxt = value / value.sum(axis=1, keepdims=True)
            backward[at] = nxt
        both = forward * backward
        bad = both[:, 1] / both.sum(axis=1)
        return (bad, expected) if pairs else bad

    def shares(self, x: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text by document."""
        weight = np.maximum(lengths, 1)
        begins = np.cumsum(counts) - counts
        return np.add.reduceat((1 - self.marginals(x, counts)) * weight, begins) / np.add.reduceat(weight, begins)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = [(t or "").encode() for t in texts]
        if not raw:
            return np.empty(0)
        out, at = [], 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK_BYTES):
                size += len(raw[end])
                end += 1
            out.append(self.shares(*line_features(raw[at:end])))
            at = end
        m = np.concatenate(out)
        return np.round(1 / (1 + np.exp(-(self.curve[0] * m + self.curve[1]))), 9)  # the last bits depend on the batch


def _fit_field(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, start: Field, steps: int = 60) -> Field:
    """Gradient ascent (with Adam's step sizes) on the conditional likelihood, with a small quadratic penalty."""
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at], labels[at + 1]), 1)
    field = Field(start.weights.copy(), start.moves.copy())
    size = len(field.weights)
    theta = np.concatenate([field.weights, field.moves.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        field.weights, field.moves = theta[:size], theta[size:].reshape(2, 2)
        bad, expected = field.marginals(x, counts, pairs=True)
        slope = np.concatenate([x.T @ (labels - bad), (seen - expected).ravel()]) / len(x) - 1e-5 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.weights, field.moves = theta[:size], theta[size:].reshape(2, 2)
    return field


def _fit(x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, stretches: np.ndarray, good: np.ndarray) -> Field:
    """A field from lines: ``counts`` are the lines of each chain, ``stretches`` the chains of each document."""
    if not len(good):
        warnings.warn("no labelled document to learn from: every score is 1", stacklevel=2)
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), constant=1.0)
    if len(set(good.tolist())) < 2:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), constant=float((good.sum() + 1) / (len(good) + 2)))
    of_chain = np.repeat(np.arange(len(good)), stretches)
    owner = np.repeat(of_chain, counts)
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    labels = 1 - good[owner]
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    for turn in range(3):
        field = _fit_field(x, counts, labels, field)
        if turn < 2:
            bad = field.marginals(x, counts)
            worst = np.maximum.reduceat(bad, begins)[owner]
            labels = np.where(good[owner] == 1, 0, ((bad > 0.5) | (worst <= 0.5)).astype(int))
    weight = np.maximum(lengths, 1)
    m = np.add.reduceat((1 - field.marginals(x, counts)) * weight, begins) / np.add.reduceat(weight, begins)
    z = np.stack([m, np.ones(len(m))], axis=1)
    theta = np.zeros(2)
    for _ in range(40):  # Newton steps of a lightly penalised logistic curve
        p = 1 / (1 + np.exp(-z @ theta))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        theta += np.linalg.solve(hess, z.T @ (good - p) - 0.05 * theta)
    field.curve = (float(theta[0]), float(theta[1]))
    return field


def fit(texts: list[str | None], quality: list[int], lines: int = TRAIN_LINES) -> Field:
    """A field from labelled documents (1: good), of each at most ``lines`` lines."""
    return _join([_sampled((t or "").encode(), lines) for t in texts], quality)


def _join(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], quality: list[int]) -> Field:
    if not parts:
        parts = [(np.empty((0, FEATURES)), np.empty(0, int), np.empty(0, int))]
    x, lengths, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return _fit(x, lengths, counts, np.array([len(p[2]) for p in parts]), np.array(quality, int))


def held_out(id_column: Column | str) -> Column:
    """Rows of the held-out fold: crc32 of the id as text leaves 2 when divided by 4."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", limit: int = TRAIN_DOCS, lines: int = TRAIN_LINES
) -> Field:
    """Fit on at most ``limit`` labelled rows outside the held-out fold, on at most ``lines`` lines of each.

    Which rows these are depends on ids and texts alone: reruns give the same
    field. The driver receives ``13 + 3`` single-precision numbers a line.
    """
    ready(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    chosen = known.groupBy("id").agg(F.min("label").cast("int").alias("label")).withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(limit)
    text = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # at most ``limit`` rows of three numbers
    rows = text.join(F.broadcast(chosen), "id").select("turn", F.col("id").cast("string").alias("id"), "label", F.xxhash64("text").alias("tie"), "text")

    def run(batches):
        for batch in batches:
            found = []
            for raw in batch.column(4).cast(pa.binary()).to_pylist():
                own, lengths, _ = _lines([raw])
                table = np.concatenate([own, lengths[:, None]], axis=1)
                # one line more on either side serves as the neighbour
                found.append(b"".join(_stretch(table, b, e) for b, e in _stretches(len(table), lines)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["turn", "id", "label", "tie", "lines"])

    sample = rows.mapInArrow(run, "turn long, id string, label int, tie long, lines binary").orderBy("turn", "id", "tie", "lines").limit(limit).collect()
    return _join([_unpack(bytes(r["lines"])) for r in sample], [r["label"] for r in sample])


def _stretch(table: np.ndarray, begin: int, end: int) -> bytes:
    """Lines ``begin`` to ``end`` with a neighbour on either side, behind three counts: neighbours before, lines, neighbours behind."""
    low, high = max(begin - 1, 0), min(end + 1, len(table))
    return np.array([begin - low, end - begin, high - end], "<i4").tobytes() + table[low:high].astype("<f4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths and stretch sizes behind a row's stretches."""
    at, x, lengths, sizes = 0, [], [], []
    while at < len(raw):
        before, n, behind = np.frombuffer(raw, "<i4", 3, at).tolist()
        size = (before + n + behind) * (_OWN + 3)
        table = np.frombuffer(raw, "<f4", size, at + 12).reshape(-1, _OWN + 3).astype(float)
        at += 12 + 4 * size
        x.append(_with_neighbours(table[:, : _OWN + 2])[before : before + n])
        lengths.append(table[before : before + n, -1].astype(int))
        sizes.append(n)
    return np.concatenate(x), np.concatenate(lengths), np.array(sizes)


def score_documents(df: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_column, *keep, score double)`` of each text."""
    ready(df.sparkSession)
    names = list(dict.fromkeys([id_column, *keep]))
    source = df.select(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)], F.col(text_column).cast("string").alias("__text"))
    schema = StructType([*[StructField(f"k{i}", df.schema[n].dataType) for i, n in enumerate(names)], StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            scores = field.scores(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*[f"k{i}" for i in range(len(names))], "score"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], "score")


def quality_report(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)``, one row a document."""
    field = train(docs, labels, id_column, text_column)
    scored = score_documents(docs, field, id_column, text_column)
    return scored.select(id_column, held_out(id_column).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
