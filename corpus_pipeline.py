"""Corpus pipeline: five stages over ``documents``, each through one operator of ``veilmark.llm``.

Every stage works on all rows that its predecessor kept and is written as
Parquet before the next one reads it. All but the last return the columns of
``documents``, whatever these are.

Cases, of every stage: an empty table gives no rows; null and empty texts are
rows like others (quality scores them as one empty line; they are nobody's near
copies; they hold no secrets, and without words the mix leaves them out);
null ids and rows that share an id are documents of their own; further columns
go along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, fair_mix, line_crf, minhash, secrets
from veilmark.llm.common import documents, materialize

#: Similarity in per cent from which documents are near copies. The 85 of operator 3's own query is that query's contract only.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the line field rejects go. Trained on labelled rows of the whole table.

    Without labelled rows every document stays.
    """
    field = line_crf.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    scored = line_crf.score_documents(rows, field, keep=("row",))
    return scored.where(F.col("score") >= line_crf.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 at similarity 0.80: one document of each group stays, the one with the smallest id.

    Rows without an id, and rows that share one, enter under a hash of id and
    text instead, so that different texts are told apart.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), "text")
    unclear = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("shared"))
    named, shared = row.withColumn("key", F.col("id").cast("long")), []
    if unclear.limit(1).count():
        shared = ["found"]
        own = F.xxhash64(F.lit("row"), F.col("id"), F.coalesce("text", F.lit("")), F.col("text").isNull())
        both = row.join(unclear.withColumn("found", F.lit(True)), F.col("id").eqNullSafe(F.col("shared")), "left")
        named = both.select("row", "id", "text", "found", F.when(F.col("found"), own).otherwise(F.col("id")).alias("key"))
    found = minhash.near_duplicates(named, "key", percent=NEAR_PERCENT).where("kept").select("key").distinct()
    kept = named.select("row", "key", *shared).join(found.hint("shuffle_hash"), "key", "left_semi")
    if shared:
        # of rows with one key, which have one text, the least as JSON stays: any column can be written so; tasks combine them first
        told = kept.where("found").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.where("found is null").select("row").union(told.select("row"))
    return kept.select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every span found is masked in its text, and ``n_chars`` follows."""
    names = docs.columns
    words = secrets.corpus_words(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.select(F.struct(*names).alias("row"), F.col("text").alias("text"))
    masked = secrets.redact(rows, secrets.train(spark, words=words))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return masked.select(*[changed.get(n, F.col("row").getField(n)).alias(n) for n in names])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sources by target weight, in the order of finish times, cut at the words that came in."""
    return fair_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: number and digest of every document's token ids, and the digest of what they decode to."""
    return bpe.bpe_digest(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
    ("BPE encoding", encode),
]

#: The line field and the BPE walk have no SQL form; tests/llm/test_pipeline.py compares every stage and their sequence with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
