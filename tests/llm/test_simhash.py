"""SimHash against brute force: fingerprints, distances in planes, links, components, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilmark.llm import queries, simhash

SCHEMA = "doc_id long, text string"


def brute_print(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_links(prints: list[int], radius: int) -> set[tuple[int, int]]:
    return {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius}


def brute_rows(rows: list[tuple]) -> list[tuple]:
    prints = [brute_print(t) for _, t in rows]
    each = sorted(set(prints))
    root = list(range(len(each)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_links(each, 2):
        root[find(j)] = find(i)
    group = [find(each.index(p)) for p in prints]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group)]


def order(rows: list) -> list:
    return sorted((tuple(r) for r in rows), key=repr)


def near(rnd: random.Random, x: int, bits: int) -> int:
    for k in rnd.sample(range(64), bits):
        x ^= 1 << k
    return x


def test_fingerprints_of_texts():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("Aa b cde Ö ß 7".split()) for _ in range(n)) for n in [*range(12), 254, 255, 256, 257, 258, 1200]]
    for t in [None, "", " \t\n", "One  Two", *texts]:
        assert simhash.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_planes_of_groups_of_any_size(radius, monkeypatch):
    rnd = random.Random(radius)
    groups = []
    for size in [1, 2, 63, 64, 65, 130, 3, 1, 200]:
        base = rnd.getrandbits(64)
        groups.append([near(rnd, base, rnd.randint(0, 4)) for _ in range(size)])
    ends = np.cumsum([len(g) for g in groups])
    expected = {(int(e) - len(g) + i, int(e) - len(g) + j) for g, e in zip(groups, ends) for i, j in brute_links(g, radius)}
    for pairs in (1 << 18, 5):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        u, v = simhash.close_in_groups(np.array(sum(groups, []), np.uint64), ends, radius)
        assert len(u) == len(expected) and set(zip(u.tolist(), v.tolist())) == expected


def test_blocks_are_abandoned_early(monkeypatch):
    rnd = np.random.default_rng(4)
    prints = np.sort(rnd.integers(0, 1 << 63, 4096, dtype=np.uint64))
    met = []
    planes = simhash.bit_planes(prints)

    class Counting:
        def __getitem__(self, key):
            met.append(len(key[0]))
            return planes[key]

    block, at = np.repeat(np.arange(64), 64), np.tile(np.arange(64) * 64, 64)
    simhash.within(Counting(), prints[at], block, np.full(len(at), simhash._ALL), 2)
    assert met[0] == 4096 and met[32] < 200


def test_groups_are_whole_across_batches(monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 5)
    rnd = random.Random(2)
    keys = sorted(rnd.choices(range(4), k=60)) + [9] * 40
    rows = [(k, -k, i) for i, k in enumerate(keys)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + 3])], names=["t", "p", "x"]) for i in range(0, len(rows), 3)]
    parts = list(simhash._whole_groups(iter(batches)))
    assert [x for t, p, x in parts for x in x] == list(range(100))
    seen = [set(t.tolist()) for t, _, _ in parts]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[i + 1 :])
    assert list(simhash._whole_groups(iter([]))) == []


def test_all_links_once(spark):
    rnd = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rnd.getrandbits(64)
        prints |= {near(rnd, base, rnd.randint(0, 3)) for _ in range(rnd.choice([1, 2, 30]))}
    base = rnd.getrandbits(64)
    prints |= {base ^ (a << 3 | b << 50) for a in range(16) for b in range(16)}  # a dense group
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = simhash.close_prints(spark.createDataFrame([(x,) for x in signed], "print long")).collect()
    pairs = [tuple(sorted((signed.index(r.u), signed.index(r.v)))) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_links(prints, 2)
    assert all(r.distance == ((r.u ^ r.v) & (1 << 64) - 1).bit_count() for r in got)


def test_radius_above_two_is_refused():
    with pytest.raises(ValueError):
        simhash.key_masks(3)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_simhash"](spark, sf).collect()
    assert order(got) == order(brute_rows([tuple(d) for d in docs]))
    assert any(r.component_id != r.doc_id for r in got)


def test_odd_rows(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(300)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "\n \t"), (None, ""), (None, None), (5, "One Two"), (6, "one  two"), (6, "one  two"), (7, "three"), (None, "lonely words here")]
    rows += [(9, "same id"), (9, "other text under that id"), (8, "OTHER text under that id"), (11, "long " * 30_000), (10, "Long " * 30_000)]
    for i in range(100, 140):
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = "x"
        rows.append((i if i % 5 else None, " ".join(t)))
    df = spark.createDataFrame([(*r, 3, "c") for r in rows], SCHEMA + ", print int, component_id string")
    assert order(simhash.near_duplicates(df).collect()) == order(brute_rows(rows))
    empty = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_a_hot_group_of_copies_is_one_node(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text again and again', concat('word', id)) as text")
    got = simhash.near_duplicates(rows).where("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
