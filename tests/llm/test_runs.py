"""Periodic runs against brute force, with colliding hashes and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import queries, runs

SCHEMA = "doc_id long, text string"


def brute_runs(words: list, min_length: int = 6, exponent: int = 4) -> list:
    """All maximal stretches, one period after another; a multiple of a stretch's least period is passed over."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(min_length, exponent * q) and e > s:
                found.setdefault((s, e + q), q)
            s = max(e, s) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_planted(doc_id: int | None, words: list) -> list:
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_report(doc_id: int | None, text: str | None) -> tuple:
    words = brute_planted(doc_id, (text or "").encode().split())
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    said = "".join("%d,%d,%d\n" % r for r in found)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha(said.encode()), sha(kept))


def made(rnd: random.Random, n: int, letters: int) -> list[int]:
    """A sequence with repeats of many periods, some nested."""
    out: list[int] = []
    while len(out) < n:
        if rnd.random() < 0.5:
            part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))]
            out += part * rnd.randint(1, 7) + part[: rnd.randrange(len(part))]
        else:
            out += [rnd.randrange(letters) for _ in range(rnd.randint(1, 6))]
    return out[:n]


def together(texts: list[list[int]], **kind) -> list:
    return runs.runs_of(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64), **kind)


def test_all_runs_of_random_sequences_in_one_batch():
    rnd = random.Random(7)
    texts = [made(rnd, rnd.randint(0, 160), rnd.randint(1, 4)) for _ in range(400)]
    assert together(texts) == [brute_runs(t) for t in texts]
    assert together(texts, min_length=4, exponent=2) == [brute_runs(t, 4, 2) for t in texts]


def test_slices_of_the_grid_change_nothing(monkeypatch):
    rnd = random.Random(8)
    texts = [made(rnd, 300, 3) for _ in range(20)]
    whole = together(texts)
    monkeypatch.setattr(runs, "PAIRS", 7)
    assert together(texts) == whole


def test_colliding_hashes_are_read_again(monkeypatch):
    rnd = random.Random(9)
    texts = [made(rnd, 200, 3) for _ in range(60)]
    init = runs.Hashes.__init__
    monkeypatch.setattr(runs.Hashes, "__init__", lambda self, words: init(self, words, 5))
    assert together(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 7, 2499])
def test_a_long_text_of_one_period(period):
    n = 4 * 2499 + 3
    t = [i % period for i in range(n)]
    assert together([[9, 9], t, []]) == [[], [(0, n, period)], []]


def test_a_very_long_text_beside_short_ones():
    rnd = random.Random(3)
    t = [rnd.randrange(1000) for _ in range(200_000)]
    t[50_000:90_000] = t[50_000:60_000] * 4
    t[150_000:150_006] = [5] * 6
    found = together([[1] * 6, t])
    assert (50_000, 40_000, 10_000) in [(max(50_000, s), min(40_000, n), q) for s, n, q in found[1]]
    assert any(s <= 150_000 and s + n >= 150_006 and q == 1 for s, n, q in found[1])
    for s, n, q in found[1]:
        assert t[s : s + n - q] == t[s + q : s + n]


def test_exponents_are_compared_exactly():
    assert runs.strongest([(0, 13, 3), (20, 26, 6), (60, 1_000_001, 3), (70, 333_334, 1)]) == (70, 333_334, 1)
    assert runs.strongest([(0, 8, 2), (9, 4, 1), (30, 12, 3)]) == (0, 8, 2)
    assert runs.strongest([]) is None


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op11_runs"](spark, sf).collect())
    assert got == sorted(brute_report(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > len(got) / 20


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a " * 9), (4, "a " * 9), (5, "ö ß ö ß ö ß ö ß x"), (6, "one"), (None, "b b b b b b c"), (7, "x y x y x y x y x y x y")]
    rows += [(i, f"w{i} " * (i % 13) + "v " + "p q r " * (i % 6)) for i in range(100, 180)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", runs string, strongest int")
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r) for r in runs.run_report(df).collect()), key=order) == sorted((brute_report(*r) for r in rows), key=order)
    collapsed = {r.doc_id: r.collapsed for r in runs.find_runs(df).collect() if r.doc_id in (3, 4, 5)}
    assert collapsed == {3: "", 4: "a", 5: "ö ß x"}
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.run_report(empty).collect() == [] and runs.run_report(empty).columns == runs.run_report(df).columns


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("7", "a a a a a a"), ("x", "b")], "k string, body string")
    assert {(r.k, len(r.runs)) for r in runs.find_runs(df, "k", "body").collect()} == {("7", 1), ("x", 0)}


def test_planted_rows_are_a_tenth(spark):
    ids = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z").alias("text"))
    rows = ids.select("doc_id", "text", runs.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert all(r.t.split() == [w.decode() for w in brute_planted(r.doc_id, r.text.encode().split())] for r in rows)
    assert 100 < sum(r.t != r.text for r in rows) < 300
