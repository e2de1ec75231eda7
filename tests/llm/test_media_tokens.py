"""Ogg, BPE, token attribution, binary ids and chat trees against brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilmark.llm import bpe, chat_tree, common, ogg, token_spans, vbyte

TEXTS = [None, "", " ", "a", "word " * 3000, "x" * 70000, "é漢😀 ünï\n\n\tcode  x", "it's 123 and\r\n<|endoftext|> more<|endoftext|>", "same", "same", "a b", " lead", "trail \n"]
HOSTILE = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", " \n", "é", "漢", "1", "23", "!", "$$$", "<|endoftext|>", " ", "́", "\x1c", "ing", "😀", "İ", "K", ".", "<|", "ß"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, i, "id") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, __id string").repartition(3)


def noise(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(HOSTILE) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def slow_crc(page: bytes) -> int:
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_packets():
    data = bytes(random.Random(0).randbytes(1000))
    assert ogg.page_checksum(data) == slow_crc(data)
    for size in (0, 1, 254, 255, 256, 510, 65025, 70000):
        w = ogg.StreamWriter(7)
        packet = bytes(i % 251 for i in range(size))
        raw = b"".join([*w.packet(packet, 99), w.flush(ogg.LAST)])
        (got,) = ogg.read_packets(raw)
        assert got["data"] == packet and got["granule"] == 99


def test_ogg_damage():
    payload = bytes(range(256)) * 2000
    media = ogg.write_samples(payload)
    assert ogg.read_samples(media)["payload"] == payload
    assert ogg.read_samples(b"junk" + media)["skipped"] == 4
    pages = list(ogg.read_pages(media))
    hurt = bytearray(media)
    hurt[pages[2]["offset"] + 200] ^= 1
    back = ogg.read_samples(bytes(hurt))
    assert back["bad"] == 1 and len(back["payload"]) < len(payload)
    assert list(ogg.read_packets(media[:-10])) and not list(ogg.read_packets(b"OggS"))


def test_ogg_digest(docs):
    rows = {r["doc_id"]: r for r in ogg.ogg_digest(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i if i != 3 else None]
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[8]["media_sha256"] == rows[9]["media_sha256"]
    assert ogg.ogg_digest(docs.limit(0)).count() == 0


def test_ogg_tables(spark, docs):
    files = ogg.ogg_round_trip(docs.where("doc_id = 5")).select("doc_id", "media").union(spark.createDataFrame([(99, None)], "doc_id long, media binary"))
    pages = ogg.ogg_pages(files, "media", ["doc_id"]).collect()
    assert all(p["ok"] for p in pages) and {p["doc_id"] for p in pages} == {5}
    packets = ogg.ogg_packets(files, "media", ["doc_id"])
    assert packets.agg(F.max("seconds")).first()[0] == pytest.approx((70000 + 16) / 8000)


def test_bpe_is_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = noise(3000) + ["".join(random.Random(i).choice("abcdeinorst") for _ in range(60)) for i in range(500)]
    ids, counts = enc.batch(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        own = ids[at : at + n].astype(np.int64)
        assert own.tolist() == library.encode(t, add_special_tokens=False).ids
        assert enc.codec.decode(own) == library.decode(own.tolist(), skip_special_tokens=False)
        assert enc.codec.encode(t) == own.tolist()
        at += n
    rows = {r["doc_id"]: r for r in bpe.bpe_digest(docs).collect()}
    for i, t in enumerate(TEXTS):
        own = library.encode(t or "", add_special_tokens=False).ids
        r = rows[i if i != 3 else None]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_digest(docs.limit(0)).count() == 0


def test_bpe_decodes_broken_utf8(spark):
    codec = bpe.encoder(bpe.default_path()).codec
    library = Tokenizer.from_file(bpe.default_path())
    ids = [codec.ids[bytes([b])] for b in (0xE6, 0xBC, 0x41, 0xFF)]
    assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame([(1, np.array(ids, "<u4").tobytes()), (2, None)], "k int, ids binary")
    assert {r["k"]: r["text"] for r in bpe.bpe_decode(df, "k").collect()} == {1: codec.decode(np.array(ids)), 2: None}


def test_bpe_small_table(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 50)
    enc, library = bpe.Encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for k in range(4):
        texts = noise(40, k)
        ids, counts = enc.batch(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_token_sections(docs, spark):
    library = Tokenizer.from_file(bpe.default_path())
    by: dict = {}
    for r in token_spans.tokens_by_section(docs).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        rows = sorted(by[i if i != 3 else None], key=lambda r: r["section"])
        spans = [(r["start"], r["end"]) for r in rows]
        assert "".join((t or "")[a:b] for a, b in spans) == (t or "")
        expected = [0] * len(spans)
        for a, b in library.encode(t or "", add_special_tokens=False).offsets:
            over = [(min(b, e) - max(a, s), -k) for k, (s, e) in enumerate(spans) if min(b, e) > max(a, s)]
            expected[-max(over)[1]] += 1
        assert [r["tokens"] for r in rows] == expected
        assert sum(r["share"] for r in rows) == pytest.approx(sum(expected))
    own = spark.createDataFrame([(1, "hello world", [(0, 3), (6, 11)]), (2, "x", None)], "doc_id int, text string, parts array<struct<start:int,end:int>>")
    got = sorted(map(tuple, token_spans.tokens_by_section(own, sections="parts").collect()))
    assert got == [(1, 0, 0, 3, 1, 0.6, 0), (1, 1, 6, 11, 1, pytest.approx(5 / 6), 0)]


def test_vbyte_codec():
    rnd = random.Random(2)
    for n in (0, 1, 3, 4, 5, 1000):
        v = np.array([rnd.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.uint32)
        control, data = vbyte.pack(v)
        assert len(control) == -(-n // 4) and (vbyte.unpack(control, data, n) == v).all()


def test_vbyte_encoder_is_the_library(monkeypatch):
    path = vbyte.default_path()
    library, enc = Tokenizer.from_file(path), vbyte.LibraryEncoder(path)
    for limit in (10**6, 30):
        monkeypatch.setattr(vbyte, "TABLE_ENTRIES", limit)
        for k in range(4):
            texts = noise(1500, k)
            ids, _ = enc.batch([t.encode() for t in texts])
            assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_vbyte_shards(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE_BYTES", 2000)
    texts = noise(400)
    df = spark.createDataFrame([(i % 150 - 50, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    rows = vbyte.id_report(df).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(i % 150 - 50 for i in range(400))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]).tolist()
    library = Tokenizer.from_file(vbyte.default_path())
    whole = sorted((i % 150 - 50, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in rows) == whole
    parts = common.by_ranges(df, "doc_id", 20000)
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_vbyte_report(docs):
    library = Tokenizer.from_file(vbyte.default_path())
    rows = sorted(vbyte.id_report(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    texts = [TEXTS[3], *[t for i, t in enumerate(TEXTS) if i != 3]]  # the null id comes first
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert vbyte.id_report(docs.limit(0)).count() == 0


def test_escaping():
    for t in ("<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<|b<|", "<", "|", "\\", "<\\"):
        assert chat_tree.unescape(chat_tree.escape(t)) == t and "<|" not in chat_tree.escape(t)
        assert chat_tree.unescape_role(chat_tree.escape_role(t + "\n\\n")) == t + "\n\\n"


def test_chat_tree(spark):
    hello = [(0, "user", "hello"), (1, "assistant", "hi <|im_end|>")]
    talks = {1: hello, 2: [*hello, (2, "user", None)], 3: [*hello, (2, "user", "x"), (3, "assistant", "y")], 4: [(0, None, ""), (0, None, "")], 5: [(7, "assistant", "only")], None: [(0, "user", "z")]}
    df = spark.createDataFrame([(c, t, r, x, "k") for c, v in talks.items() for t, r, x in v], "conv_id long, turn long, role string, text string, node string").repartition(3)
    stream, index = chat_tree.build_tree(chat_tree.with_probe(spark, df))
    nodes = sorted(stream.collect(), key=lambda r: r["start"])
    assert sum(r["n_tokens"] for r in nodes) == nodes[-1]["start"] + nodes[-1]["n_tokens"]  # each token once, no gaps
    assert len(nodes) == 2 + 1 + 2 + 2 + 1 + 1 + 2
    got = {r["conv_id"]: r for r in chat_tree.chat_report(chat_tree.with_probe(spark, df)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    talks[-1] = [(0, "user", said), (1, "assistant", said)]
    for c, v in talks.items():
        turns = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in v)
        loss = "".join(x or "" for _, r, x in v if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(v), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_tree.chat_report(df.limit(0)).count() == 0


def test_a_shared_first_turn_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "SPLIT_ROWS", 40)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        said = "<|im_end|> one prompt for all " * 3
        ids = spark.range(1500).select(F.col("id").alias("conv_id"))
        rows = ids.select("conv_id", F.lit(0).alias("turn"), F.lit("system").alias("role"), F.lit(said).alias("text")).union(ids.select("conv_id", F.lit(1), F.lit("user"), F.concat(F.lit("question "), F.col("conv_id").cast("string"))))
        stream, index = chat_tree.build_tree(rows)
        assert stream.agg(F.max("turns")).first()[0] == 1500 and stream.count() == 1501
        met = common.join_by_key(index, stream.select("start", "turns"), "start", "turns", "conv")
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 3000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        found = chat_tree.read_conversations(stream, index).agg(F.count("*"), F.min("n_turns"), F.max("n_turns")).first()
        assert tuple(found) == (1500, 2, 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_very_long_turn_and_clashing_columns(spark):
    said = "word <|im_start|> \\| " * 40_000
    df = spark.createDataFrame([(1, 0, "user", said, 5, "x"), (1, 1, "assistant", said, 6, "y")], "conv_id long, turn long, role string, text string, start int, node string")
    row = chat_tree.chat_report(df).first()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(said)) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
