"""Threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every 64-bit shingle hash below a fixed fraction of the hash
range, and no other. Since the threshold is the same everywhere, the sketch of
a union is the union of the sketches (:func:`merge`), and the share of a small
sketch found in a large one estimates containment however unequal the documents
are.

Beside the sketch a mark holds one hash of all words in order. It is no part
of the sketch and never merged; it only tells that two texts have the same
words. Hashes of shingles are the upper 32 bits of 64, in sorted arrays.

Likeness of two texts, by one rule at every length: 1.0 if they have the same
words in the same order; otherwise the Jaccard coefficient of the sketches, and
0.0 if both are empty. Its standard error is ``sqrt(j * (1 - j) * FRACTION / u)``
for a true value ``j`` over ``u`` distinct shingles: 0.25 at 16 shingles and
``j`` = 0.5, 0.03 at 1000. A text of ``m`` shingles has an empty sketch with
probability ``(1 - 1 / FRACTION) ** m``: 0.75 for one, 0.24 for five, 0.0001 for
32. Containment is null where the contained text's sketch is empty, as nothing
can be said then, unless both texts have the same words or it has none (1.0).

Cases: null texts count as empty; texts of any length are hashed whole; rows
that share an id follow each other by their columns; null ids have no place in
the order, so their next text is empty; a single row follows itself; an empty
table gives no rows. Further columns of a table are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RANGE_BYTES, bucket_of, partitions_for, range_bounds, text_or_empty
from .secrets import let

WORDS = 5
#: A hash stays if it lies in the lowest 1/FRACTION of the range.
FRACTION = 4
_BLANKS = "\t\n\x0b\f\r "


def sketch(text: Column, words: int = WORDS, fraction: int = FRACTION) -> Column:
    """``struct<kept array<long>, whole long>`` of a text (not null): the hashes below the threshold, and one hash of all words in order."""
    limit = (1 << 32) // fraction
    parts = F.split(F.btrim(text, F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))
    upper = lambda x: F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(1 << 63))), 32)

    def mark(h: Column) -> Column:
        last = F.size(h) - words
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: upper(F.xxhash64(*[F.get(h, i + j) for j in range(words)])))
        shingles = F.when(last >= 0, runs).otherwise(F.array(upper(F.xxhash64(h))))
        kept = F.array_sort(F.array_distinct(F.filter(shingles, lambda v: v < limit)))
        return F.struct(kept.alias("kept"), F.xxhash64(h).alias("whole"))

    none = F.array().cast("array<bigint>")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), let(hashes, mark)).otherwise(F.struct(none.alias("kept"), F.xxhash64(none).alias("whole")))


def as_text(mark: Column) -> Column:
    """Eight hexadecimal digits a hash of the sketch; the hash of all words follows behind ``~``."""
    digits = F.array_join(F.transform(mark["kept"], lambda v: F.lpad(F.hex(v), 8, "0")), "")
    return F.concat(digits, F.lit("~"), F.lpad(F.hex(mark["whole"]), 16, "0"))


def resemblance(a: Column, b: Column) -> Column:
    """Estimate of ``|A & B| / |A | B|`` of two marks of :func:`sketch`."""
    x, y = a["kept"], b["kept"]
    common = F.size(F.array_intersect(x, y))
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(common / F.greatest(F.size(x) + F.size(y) - common, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of A that B holds, of two marks of :func:`sketch`."""
    wordless = F.xxhash64(F.array().cast("array<bigint>"))
    share = F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"]))
    return F.when((a["whole"] == b["whole"]) | (a["whole"] == wordless), 1.0).otherwise(share)


def merge(*marks: Column) -> Column:
    """Sketch, an array, of the union of documents from their marks."""
    return F.array_sort(F.array_distinct(F.concat(*[m["kept"] for m in marks])))


def with_next(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows by ascending id; the first follows the last.

    Rows are dealt to ranges of ids, one a task and of about ``RANGE_BYTES``
    of the first of ``columns`` (a text), and the first id of each range is
    also sent to the range before it. Equal ids follow each other by
    ``columns``. Null ids have no place: their next is null.
    """
    known = df.where(F.col(id_column).isNotNull())
    first, size = known.agg(F.min(id_column), F.sum(F.octet_length(F.col(columns[0])).cast("long"))).first()
    bounds = range_bounds(known, id_column, max(partitions_for(df.sparkSession), -(-(size or 0) // RANGE_BYTES)))
    key, last = F.col(id_column), len(bounds)
    at = bucket_of(key, bounds)
    own = F.struct(at.alias("bucket"), F.lit(False).alias("ghost"), F.lit(0).alias("lap"))
    copies = [own]
    if bounds:
        copies.append(F.when((F.col("__at") > 0) & (F.get(F.lit(bounds), F.col("__at") - 1) == key), F.struct((F.col("__at") - 1).alias("bucket"), F.lit(True).alias("ghost"), F.lit(0).alias("lap"))))
    copies.append(F.when(key == F.lit(first), F.struct(F.lit(last).alias("bucket"), F.lit(True).alias("ghost"), F.lit(1).alias("lap"))))
    dealt = known.withColumn("__at", at).withColumn("__to", F.explode(F.array_compact(F.array(*copies))))
    spread = dealt.withColumn("__to_bucket", F.col("__to.bucket").cast("int")).repartitionById(last + 1, F.col("__to_bucket"))
    w = Window.partitionBy("__to_bucket").orderBy("__to.lap", id_column, *columns)
    led = spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("not __to.ghost").drop("__at", "__to", "__to_bucket")
    rest = df.where(F.col(id_column).isNull()).select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"next_{c}") for c in columns])
    return led.union(rest)


def sketch_neighbours(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text ends in code points of the next document instead of the
    text's own last quarter (see :func:`with_next` for "next").
    """
    docs = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).withColumn("mark", sketch(F.col("text")))
    rows = with_next(docs, "doc_id", ["text", "mark"])
    n = F.length("text")
    cut = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_mark", sketch(F.col("edited")))
    next_mark = F.coalesce("next_mark", sketch(F.lit("")))
    return rows.select(
        F.col("doc_id").alias(id_column),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("mark")).alias("fingerprint"),
        as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        resemblance(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        resemblance(F.col("mark"), next_mark).alias("near_next"),
        containment(F.col("mark"), F.col("edited_mark")).alias("held_by_edited"),
    )
