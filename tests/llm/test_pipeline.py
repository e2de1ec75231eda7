"""Every stage of the pipeline, and their sequence, against brute force; odd rows and tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus import brute_components, brute_queue, brute_spans, brute_targets
from tokenizers import Tokenizer

import corpus_pipeline
from veilmark.llm import line_crf, secrets

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_quality(spark, rows: list[dict], sf: str) -> list[dict]:
    field = line_crf.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    return [r for r in rows if field.scores([r["text"]])[0] >= 0.7]


def brute_near(rows: list[dict]) -> list[dict]:
    """Of each group the row with the least id stays; only for distinct ids."""
    found = brute_components({r["doc_id"]: r["text"] for r in rows}, 80)
    return [r for r in rows if found[r["doc_id"]][0] == r["doc_id"]]


def brute_masked(t: str | None, model) -> str | None:
    if t is None:
        return None
    out, at = [], 0
    for a, _, b in brute_spans(t, model):
        if a >= at:
            out += [t[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def brute_secret_scan(spark, rows: list[dict], sf: str) -> list[dict]:
    model = secrets.train(spark, words=secrets.corpus_words(spark.read.parquet(f"{sf}/benchmark.parquet")))
    masked = [{**r, "text": brute_masked(r["text"], model)} for r in rows]
    return [{**r, "n_chars": None if r["text"] is None else len(r["text"])} for r in masked]


def brute_mix(rows: list[dict]) -> list[dict]:
    plain = [(r["doc_id"], r["text"], r["source"], 0) for r in rows]
    sizes = defaultdict(int)
    for _, t, s, _ in plain:
        sizes[s] += len((t or "").encode().split())
    return [rows[k] for *_, k, _ in brute_queue(plain, {s: n for s, n in sizes.items() if n}, brute_targets(sizes))]


def brute_encode(rows: list[dict]) -> list[tuple]:
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return out


def dicts(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def ordered(rows: list) -> list[str]:
    return sorted(map(repr, rows))


def test_stages_and_run_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = dicts(docs)
    for name, brute in (
        ("quality classifier", lambda r: brute_quality(spark, r, sf)),
        ("MinHash near-dedup", brute_near),
        ("secret scans", lambda r: brute_secret_scan(spark, r, sf)),
        ("mixing sources", brute_mix),
    ):
        got = STAGES[name](spark, docs, sf)
        assert got.columns == COLUMNS
        expected = brute(rows)
        assert 0 < len(expected) and ordered(dicts(got)) == ordered(expected), name
        docs, rows = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in expected], docs.schema).repartition(3), expected
    assert len(rows) < 300 and any("[SECRET]" in r["text"] for r in rows)
    final = [tuple(r) for r in STAGES["BPE encoding"](spark, docs, sf).collect()]
    assert ordered(final) == ordered(brute_encode(rows))
    assert ordered(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == ordered(final)


ODD = [
    (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, None), (1, ""), (2, None), (3, " \n"),
    (4, "one two three four five six"), (4, "one two three four five six"), (4, "some other text that shares the id of a row"), (5, "One two THREE four five six"),
    (6, "token = abcdefghijklmnop and x8Kd93jfKs02LsmQpz7Wn4Yt1RbVcX"), (7, "word " * 400_000), (7, "short words"),
]
EXTRA = ["row", "key", "score", "secrets", "id", "k0", "place", "odd name", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, None, None if k % 3 else "s", 1, *(f"{c}{k}" for c in EXTRA)) for k, (i, t) in enumerate(ODD)], schema).repartition(3)


def test_stages_take_odd_rows_and_columns(spark, odd, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns, name
        assert all(r["row"][3:] == r["key"][3:] == r["odd name"][8:] for r in got.collect()), name
        empty = stage(spark, odd.limit(0), sf)
        assert empty.columns == odd.columns and empty.count() == 0, name
    assert STAGES["BPE encoding"](spark, odd, sf).count() == len(ODD) and STAGES["BPE encoding"](spark, odd.limit(0), sf).count() == 0


def test_near_duplicates_tell_shared_ids_apart(spark, odd, sf):
    runs = [sorted((r["doc_id"] or 0, r["text"] or "", r["row"]) for r in corpus_pipeline.near_duplicates(spark, d, sf).collect()) for d in (odd, odd.repartition(5))]
    assert runs[0] == runs[1]
    texts = [t for _, t, _ in runs[0]]
    assert sum(t.lower().startswith("one two") for t in texts) == 1 and sum(t.startswith("alpha") for t in texts) == 1
    assert {"some other text that shares the id of a row", "short words", "word " * 400_000, "", " \n"} <= set(texts)
    assert len(texts) == 10


def test_secret_scan_masks_and_counts(spark, odd, sf):
    rows = {r["row"]: r for r in corpus_pipeline.secret_scan(spark, odd, sf).collect()}
    assert rows["row10"]["text"] == "[SECRET] and [SECRET]" and rows["row10"]["n_chars"] == 21
    assert rows["row2"]["text"] is None and rows["row2"]["n_chars"] is None and rows["row3"]["text"] == ""
    assert all(rows[f"row{k}"]["text"] == ODD[k][1] for k in range(len(ODD)) if k != 10)


def test_run_of_odd_and_empty_tables(spark, odd, sf, tmp_path):
    for name, table in (("odd", odd), ("empty", odd.limit(0))):
        where = f"{tmp_path}/{name}"
        table.drop("odd name").write.parquet(f"{where}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{other}.parquet").limit(0).write.parquet(f"{where}/{other}.parquet")
        with pytest.warns(UserWarning, match="no labelled document"):
            got = corpus_pipeline.run(spark, where)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (got.count() > 0) == (name == "odd")
    assert got.where(F.col("n_tokens") < 0).count() == 0


def test_rows_that_share_an_id_may_have_columns_of_any_type(spark, tmp_path):
    rows = [(7, "one text that two rows with one id hold here", {"a": 1}), (7, "one text that two rows with one id hold here", {"b": 2}), (7, "quite another text under that id", {"a": 1}), (8, "alone with this text of words", None)]
    rows += [(None, None, {"k": n}) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept)[-3:] == sorted({(r[0], r[1]) for r in rows[:4]})
