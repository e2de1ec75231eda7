"""Odd rows, very long texts, clashing column names and empty tables, for the operators that work row by row."""

from __future__ import annotations

import hashlib
import zlib

import pytest
import tokenizers

from veilmark.llm import bpe, ogg, token_spans

LONG = "lorem ipsum dolor sit amet\n" * 40_000 + "q" * 300_000 + "é\U0001f600" * 50_000
TEXTS = [(1, None), (2, ""), (3, "one\ntwo three\n"), (3, "one\ntwo three\n"), (None, "no id"), (5, LONG), (6, "\n\n"), (7, "\x00 nul ​")]
CLASHES = ("id", "__id", "__text", "__value", "ids", "media", "payload", "section", "tokens", "start", "end", "row")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, *["other"] * len(CLASHES)) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{c}` string' for c in CLASHES)}").repartition(2).persist()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _sorted(rows):
    return sorted(rows, key=repr)


def test_ogg(odd):
    def payload(text):
        raw = (text or "").encode()
        return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)

    want = [(i, n, len(p), _sha(p), zlib.crc32(p[-64:])) for i, (p, n) in ((i, payload(t)) for i, t in TEXTS)]
    got = ogg.ogg_digest(odd)
    rows = got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert _sorted(map(tuple, rows)) == _sorted(want)
    assert ogg.ogg_digest(odd.limit(0)).count() == 0


def test_bpe(odd, library):
    def digest(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), _sha(",".join(map(str, ids)).encode()), _sha(library.decode(ids, skip_special_tokens=False).encode())

    got = bpe.bpe_digest(odd).collect()
    assert _sorted(map(tuple, got)) == _sorted((i, *digest(t)) for i, t in TEXTS)
    assert bpe.bpe_digest(odd.limit(0)).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(odd.limit(0), "doc_id"), "doc_id").count() == 0


def test_token_spans(odd, library):
    got = {}
    for r in token_spans.tokens_by_section(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, _ in TEXTS}
    for i, text in dict(TEXTS).items():
        copies = sum(1 for k, _ in TEXTS if k == i)
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        lines = (text or "").split("\n")
        sections = len(lines) - (len(lines) > 1 and lines[-1] == "")
        assert len(got[i]) == copies * sections
        assert sum(r["tokens"] for r in got[i]) == copies * n
        assert sum(r["share"] for r in got[i]) == pytest.approx(copies * n)
    assert token_spans.tokens_by_section(odd.limit(0)).count() == 0
