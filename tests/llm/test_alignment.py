"""Cross-tokenizer alignment against both libraries over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from veilmark.llm import alignment, queries

SCHEMA = "doc_id long, text string"
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

HOSTILE = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "  two  blanks  ", "tab\tand\nline\r\nends\n\n", "▁", "a▁b", "plain then ▁ sign", "<s> </s> <unk> <0x41> <|endoftext|>", "<|endoftext|>",
    "日本語のテキスト 和 한국어 ไทย", "é è ñ é ﬁ ™", "👩‍👩‍👧‍👦 😀😀", "a b  c", " em  space", "x\x1cy \x1c z", "nul\x00byte", "don't I'll we've", "1234567890 12 345", "....!!!??? ((()))",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "https://example.org/a/b?c=d&e=f", "deadbeef" * 40, " " * 50 + "x" + " " * 33, "﻿bom", "ẞß İi ı", "x" + "́" * 30,
]


@pytest.fixture(scope="module")
def both():
    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=path_b)


def brute(both, rows: list[tuple]) -> list[tuple]:
    """By offsets over whole texts; links and documents are counted one by one."""
    a, b = both
    alphabet = alignment.byte_alphabet()
    each, documents = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw_a = [bytes(alphabet[c] for c in a.id_to_token(x)) for x in ids_a]
            raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            whole = (" " + text).encode()
            if b"".join(raw_a) == whole and b"".join(raw_b) == whole:
                end_a, end_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
                i = j = 0
                for end in sorted(set(end_a) & set(end_b)):
                    groups.append((ids_a[i : end_a.index(end, i) + 1], ids_b[j : end_b.index(end, j) + 1]))
                    i, j = i + len(groups[-1][0]), j + len(groups[-1][1])
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        documents.update(set(links))
        each.append((groups, links))
    top: dict[int, int] = {}
    for (x, _), n in documents.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for (i, _), (groups, links) in zip(rows, each):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        best = sum(documents[x] == top[x[0]] for x in links)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), best, sum(documents[x] for x in links), digest))
    return out


def got(df) -> list:
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def order(rows: list) -> list:
    return sorted(rows, key=repr)


def test_query_against_the_libraries(spark, sf, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op13_token_alignment"](spark, sf)) == order(brute(both, rows))


def test_hostile_texts_and_odd_rows(spark, both):
    rnd = random.Random(13)
    rows = [(k, t) for k, t in enumerate(HOSTILE)] + [(5, "a"), (5, "a"), (None, "null id, a text"), (None, None)]
    letters = "ab cd  é日\n\t▁😀.,'s 09" + " "
    rows += [(100 + k, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", block int, keys string")
    assert got(alignment.alignment_report(df)) == order(brute(both, rows))
    empty = alignment.alignment_report(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == alignment.alignment_report(df).columns


def test_small_blocks_full_tables_and_few_pairs_at_once(spark, sf, both, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows.append((-1, "ab" * 500 + " " + "x y z " * 300 + "日本" * 80))
    expected = order(brute(both, rows))
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(alignment, "TABLE_ENTRIES", 500)
    monkeypatch.setattr(alignment, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(alignment, "ready", lambda s: s)
    assert got(alignment.alignment_report(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected


def test_groups_and_counts(spark, both):
    rows = [(1, "don't stop"), (2, "stop"), (3, "stop stop don't"), (4, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {r.doc_id: r.groups for r in alignment.token_groups(df).collect()}
    a, b = both
    assert groups[2] == [",".join(map(str, a.encode(" stop").ids)) + "|" + ",".join(map(str, b.encode("stop")))] and groups[4] == []
    blocks = alignment.materialize(alignment.aligned_blocks(df), "blocks")
    counts = {(r.a, r.b): r.documents for r in alignment.pair_counts(blocks, alignment.group_dictionary(blocks)).collect()}
    held = [{(int(x), int(y)) for g in groups[k] for x in g.split("|")[0].split(",") for y in g.split("|")[1].split(",")} for k in groups]
    assert counts == dict(Counter(p for h in held for p in h))


def test_pairs_that_a_document_repeats(monkeypatch):
    rnd = random.Random(4)
    side_a, side_b = alignment.Pool(), alignment.Pool()
    sets = [([*rnd.sample(range(6), rnd.randint(1, 4))], [*rnd.sample(range(6), rnd.randint(1, 4))]) for _ in range(30)]
    for pool, k in ((side_a, 0), (side_b, 1)):
        pool.add(np.array([x for s in sets for x in s[k]], np.uint32), np.array([len(s[k]) for s in sets]))
    rows = sorted((d, g) for d in range(20) for g in rnd.sample(range(30), rnd.randint(1, 12)))
    expected = Counter()
    for d in range(20):
        held = Counter(x << alignment.BITS | y for e, g in rows if e == d for x in sets[g][0] for y in sets[g][1])
        expected.update({p: n - 1 for p, n in held.items() if n > 1})
    for pairs in (1 << 22, 40, 3):
        monkeypatch.setattr(alignment, "PAIRS", pairs)
        found = alignment.repeated_pairs(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), side_a, side_b)
        assert Counter(found.tolist()) == expected


def test_a_very_long_text(spark, both):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9)))
    text = " ".join(word() for _ in range(60_000)) + " " * 3000 + "é" * 5000
    row = alignment.alignment_report(spark.createDataFrame([(1, text)], SCHEMA)).collect()[0]
    a, b = both
    assert (row.n_a, row.n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
    assert row.n_best <= row.n_links == row.count_sum
