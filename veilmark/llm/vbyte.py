"""Token-ID output: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus (the most frequent is 0), so that
frequent ids take one byte. Four 2-bit lengths make one control byte; the data
bytes follow little-endian, apart from the controls. Decoding looks the four
lengths of each control byte up in a table of 256 rows.

A written corpus is a folder with ``dictionary`` (rank, id) and ``blocks``:
one row a document in ascending id order, ``shard, place, doc_id, n_tokens,
control, data``, where ``place`` is the number of ids before it in its shard.
Shards are ranges of ids in order. The dictionary has as many
rows as the vocabulary at most, which is what bounds it on the driver and in
tasks.

Cases: null texts count as empty and hold the end id alone; null ids come
first; equal ids are ordered by their bytes; an empty table gives an empty
folder that reads back as no rows.
"""

from __future__ import annotations

import os
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Table, ragged
from .common import by_ranges, materialize, ready, remove_at_exit, shared_dir

#: Ends a document (fixed value of the contract).
END_ID = 1
TABLE_ENTRIES = 600_000

#: Marks that may follow a word without white space; a run of them is a piece of its own.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_COLUMNS = np.arange(4, dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[_COLUMNS <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind :func:`pack`'s bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        out |= np.where(lengths > k, raw[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryEncoder:
    """The tokenizers library behind a bounded table of chunks between ASCII white space.

    Exact for vocabularies whose pre-tokenizer drops white space and whose
    normalizer lower-cases: no piece crosses white space there, and a run of
    letters and the mark behind it are separate pieces.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.chunks, self.words = Table(), Table()

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the UTF-8 texts in a row, and the number of ids of each.

        A full table keeps its entries; what a batch adds beyond goes again.
        """
        tables = (self.chunks, self.words)
        marks = [(t.pool.slots, t.pool.used) for t in tables]
        chunks, each = self.chunks, []
        for raw in texts:
            # the strings of special tokens depend on case
            each.append([chunks[c] for c in (raw if b"<" in raw else raw.lower()).split()])
        added = self._fill()
        sizes = np.array([len(s) for s in each], np.int64)
        ids, counts = chunks.pool.get(np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum())))
        if marks[0][0] > TABLE_ENTRIES:
            for table, mark, keys in zip(tables, marks, added, strict=True):
                for k in keys:
                    del table[k]
                table.pool.slots, table.pool.used = mark
        total, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]

    def _fill(self) -> tuple[list[bytes], list[bytes]]:
        """Encode the chunks that wait; returns the new chunks and words."""
        words, flat, sizes, new = self.words, [], [], self.chunks.new
        for chunk in new:
            word = chunk.rstrip(_MARKS)
            if word and len(word) < len(chunk) and word.decode().lower().isalpha():
                flat += [words[word], words[chunk[len(word) :]]]
                sizes.append(2)
            else:
                flat.append(words[chunk])
                sizes.append(1)
        if words.new:
            words.pool.add(*self._encode(words.new))
        if new:
            ids, counts = words.pool.get(np.array(flat, np.int64))
            total, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes)
            self.chunks.pool.add(ids, total[ends] - total[ends - np.array(sizes)])
        added = (new, words.new)
        self.chunks.new, words.new = [], []
        return added

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and their counts. Words of letters go to the library many in a text: their last tokens are marked."""
        texts = [w.decode() for w in words]
        plain = np.array([t.lower().isalpha() for t in texts], bool)
        lines = np.flatnonzero(plain)
        parts = [lines[k : k + 500] for k in range(0, len(lines), 500)]
        found = self.library.encode_batch_fast([" ".join([texts[i] for i in part]) for part in parts], add_special_tokens=False)
        together = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        stops = np.flatnonzero(self.final[together]) + 1
        if len(stops) != len(lines):  # a library or vocabulary that ends words otherwise
            plain[:] = False
            together, stops, lines = together[:0], stops[:0], lines[:0]
        other = np.flatnonzero(~plain)
        alone = [e.ids for e in self.library.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)]
        counts = np.zeros(len(words), np.int64)
        counts[lines] = np.diff(stops, prepend=0)
        counts[other] = [len(x) for x in alone]
        out, ends = np.empty(int(counts.sum()), np.uint32), np.cumsum(counts)
        out[ragged(ends[lines] - counts[lines], counts[lines])] = together
        out[ragged(ends[other] - counts[other], counts[other])] = np.fromiter(chain.from_iterable(alone), np.uint32)
        return out, counts


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_ids(df: DataFrame, id_column: str, text_column: str, path: str) -> DataFrame:
    """``(counts boolean, doc_id, n_tokens, ids binary)``: the library's ids and the end id, 16 bits each while ids fit, else 32.

    Each task's last row has ``counts`` set and holds, in place of ids, how
    often it saw each id of the vocabulary (64 bits each).
    """
    source = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    kind = df.schema[id_column].dataType.simpleString()
    names = ["counts", "doc_id", "n_tokens", "ids"]

    def run(batches):
        enc = _encoder(path)
        width = "<u2" if enc.library.get_vocab_size() <= 1 << 16 else "<u4"
        seen, id_type = np.zeros(0, np.int64), None
        for batch in batches:
            ids, counts = enc.batch(batch.column(1).cast(pa.binary()).to_pylist())
            own = np.bincount(ids, minlength=max(END_ID + 1, len(seen)))
            own[END_ID] += len(counts)
            own[: len(seen)] += seen
            seen, id_type = own, batch.schema.field(0).type
            ends = np.cumsum(counts)
            rows = [np.append(ids[e - c : e], END_ID).astype(width).tobytes() for e, c in zip(ends, counts, strict=True)]
            flags = pa.array(np.zeros(len(rows), bool))
            yield pa.RecordBatch.from_arrays([flags, batch.column(0), pa.array(counts + 1, pa.int64()), pa.array(rows, pa.binary())], names=names)
        if id_type is not None:
            last = [pa.array([True]), pa.array([None], id_type), pa.array([0], pa.int64()), pa.array([seen.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=names)

    return source.mapInArrow(run, f"counts boolean, doc_id {kind}, n_tokens long, ids binary")


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def ranks(encoded: DataFrame) -> DataFrame:
    """``(rank, id)`` of the ids that occur, the most frequent first, ties by id, from the count rows of :func:`encode_ids`."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                own = np.frombuffer(row, "<i8").copy()
                if len(own) < len(total):
                    own = np.append(own, np.zeros(len(total) - len(own), np.int64))
                own[: len(total)] += total
                total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    total = encoded.where("counts").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # a row for each id of the vocabulary at most
    return total.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"), "id")


def write_ids(df: DataFrame, target: str, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> None:
    """Encode a corpus and write it below ``target`` in ascending id order.

    Ranges of ids follow the amount of data, one range a task; documents are
    packed after the sort, so texts are encoded and packed once.
    """
    spark = ready(df.sparkSession)
    path = path or default_path()
    width = _width(path)
    encoded = materialize(encode_ids(df, id_column, text_column, path), "ids")
    ranks(encoded).write.parquet(f"{target}/dictionary")
    order = [r["id"] for r in spark.read.parquet(f"{target}/dictionary").orderBy("rank").collect()]
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    ids = encoded.where("not counts").select("doc_id", "n_tokens", "ids")
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    ordered = by_ranges(ids, "doc_id", total * np.dtype(width).itemsize).sortWithinPartitions("doc_id", "n_tokens", "ids")

    def run(batches):
        rank, at = shared.value, 0
        for batch in batches:
            rows = [np.frombuffer(b, width) for b in batch.column(2).to_pylist()]
            packed = [pack(rank[r]) for r in rows]
            ends = at + np.cumsum(np.array([len(r) for r in rows], np.int64))
            starts = np.append(at, ends[:-1])
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(starts[: len(rows)], pa.int64()), batch.column(0), batch.column(1), pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())],
                names=["place", "doc_id", "n_tokens", "control", "data"],
            )

    kind = ids.schema["doc_id"].dataType.simpleString()
    packed = ordered.mapInArrow(run, f"place long, doc_id {kind}, n_tokens long, control binary, data binary")
    packed.select(F.spark_partition_id().alias("shard"), "*").write.option("compression", "zstd").parquet(f"{target}/blocks")


def read_ids(spark, target: str) -> DataFrame:
    """``(shard, place, doc_id, n_tokens, ids binary)``: ids as little-endian unsigned 32-bit integers."""
    ready(spark)
    table = np.array([r["id"] for r in spark.read.parquet(f"{target}/dictionary").orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{target}/blocks")

    def run(batches):
        for batch in batches:
            n, control, data = (batch.column(i).to_pylist() for i in (3, 4, 5))
            rows = [shared.value[unpack(c, d, k)].tobytes() for c, d, k in zip(control, data, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.binary())], names=["shard", "place", "doc_id", "n_tokens", "ids"])

    kind = blocks.schema["doc_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"shard int, place long, doc_id {kind}, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: the totals of earlier shards and the place inside the shard."""
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of ids
    first = shards.select("shard", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    return rows.join(first, "shard").withColumn("start", F.col("first") + F.col("place")).drop("first")


def id_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Write the corpus to the shared folder, read it back and return each document's place and checksum."""
    spark = df.sparkSession
    target = f"{shared_dir(spark)}/veilmark/corpus-{uuid.uuid4().hex}"
    remove_at_exit(spark, target)
    write_ids(df, target, id_column, text_column, path)
    rows = read_ids(spark, target).select("shard", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    rows = materialize(rows, "crc")
    return with_starts(rows).select(F.col("doc_id").alias(id_column), "start", "n_tokens", "ids_crc32")
