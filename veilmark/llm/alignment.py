"""Alignment of two tokenizers through a dictionary of token groups.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (pieces
with byte fallback, which adds the blank itself) the text. Where tokens of
both end at one byte, the text is cut; what lies between two cuts is a group,
and every A token of a group is linked with every B token of it. A pair of ids
is counted by the documents of the corpus that hold it linked.

The work is done once for every distinct group instead of once a link:

1. texts are cut in front of blanks between characters that are not white
   space. Neither tokenizer has a token across such a place (A's
   pre-tokenizer begins a piece there, B has no piece with a blank behind
   another character: :class:`Aligner` looks), so both have a token end there.
   A stretch is encoded and grouped once while it stays in the worker's table;
2. documents lie in *blocks* of about ``BLOCK_CHARS`` characters in the order
   in which their task reads them. A block has a row with its distinct groups,
   how many of its documents hold each, and the pairs that a document holds in
   more than one of its distinct groups; its documents refer to these groups
   by place, with frequencies;
3. the dictionary joins the groups of all blocks. Links are expanded once a
   distinct group: a pair counts the documents of all groups that hold it, less
   the repeats of step 2, which is the number of distinct documents;
4. for each group the links that are best for their A id and the sum of its
   links' counts are joined back by group key to the blocks, whose documents
   add them up by frequency.

Keys of any frequency (common groups, common pairs) are split in the joins;
only the best count of each A id is broadcast, a row an id of the vocabulary.

Cases: a text that is null, empty, or whose bytes either tokenizer does not
give back (as with U+2581, B's sign for a blank) has no tokens: zeros and an
empty digest. Special tokens' strings are plain text. Texts of any length are
encoded whole, pairs of a long group are expanded ``PAIRS`` at a time; repeated
rows and rows that share an id are documents of their own; null ids are carried
along; an empty table gives no rows; further columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TABLE_ENTRIES, Pool, Table, ragged
from .common import join_by_key, materialize, ready

#: Characters of text in one block, about.
BLOCK_CHARS = 32 << 20
#: Pairs of ids that are expanded at once in a task.
PAIRS = 1 << 22
#: Bits of an id in the number of a pair.
BITS = 20
#: Characters of stretches that a worker's table holds, at most.
TABLE_CHARS = 64 << 20

#: Two white-space characters in a row, or one at either end: blanks can't be cut there.
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def cut(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[list[int], list[int]]]:
    """Groups of two token sequences over the same bytes."""
    out, i, j, at_a, at_b, from_a, from_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a):
        at_a += size_a[a[i]]
        i += 1
        while at_b < at_a:
            at_b += size_b[b[j]]
            j += 1
        if at_a == at_b:
            out.append((a[from_a:i], b[from_b:j]))
            from_a, from_b = i, j
    return out


def stretches(text: str) -> list[str]:
    """A blank and the text, cut in front of the blanks that stand between characters that are not white space."""
    parts = text.split(" ")
    if not _UNEVEN.search(text):
        return [" " + p for p in parts]
    out, held = [], " " + parts[0]
    for before, part in zip(parts, parts[1:]):
        if part and before and not part[0].isspace() and not before[-1].isspace():
            out.append(held)
            held = " " + part
        else:
            held += " " + part
    return [*out, held]


class Aligner:
    """Both tokenizers, and tables of stretches and groups that are emptied when they are full."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        own = [self.a.id_to_token(k) for k in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in own]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank behind another character, so texts cannot be cut at blanks")
        if max(len(own), len(pieces)) >> BITS:
            raise ValueError(f"ids of more than {BITS} bits")
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.reset()

    def reset(self) -> None:
        self.chunks, self.chars = Table(), 0
        self.groups: dict[int | tuple[int, ...], int] = {}
        self.fresh: list[tuple[list[int], list[int]]] = []
        #: key of each group; slot 0 says that the bytes differ
        self.keys = [""]
        self.sizes, self.side_a, self.side_b = Pool(), Pool(), Pool()
        none = np.empty(0, np.uint32)
        self.sizes.add(np.zeros(2, np.uint32), np.array([2]))
        self.side_a.add(none, np.array([0]))
        self.side_b.add(none, np.array([0]))

    def full(self) -> bool:
        return max(len(self.chunks), len(self.keys)) > TABLE_ENTRIES or self.chars > TABLE_CHARS

    def _slot(self, a: list[int], b: list[int]) -> int:
        """Slot of a group; groups of one token each, which are the most, are known by a number."""
        key = a[0] << BITS | b[0] if len(a) == len(b) == 1 else (*a, -1, *b)
        slot = self.groups.get(key)
        if slot is None:
            slot = self.groups[key] = len(self.keys)
            self.keys.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            self.fresh.append((a, b))
        return slot

    def _fill(self) -> None:
        """Encode and group the stretches that wait."""
        new = self.chunks.new
        if not new:
            return
        flat, counts, self.fresh = [], [], []
        known, slot_of, bytes_a, bytes_b = self.groups, self._slot, self.bytes_a, self.bytes_b
        encoded = self.a.encode_batch_fast(new, add_special_tokens=False)
        for text, a, b in zip(new, (e.ids for e in encoded), self.b.encode([c[1:] for c in new], num_threads=1), strict=True):
            raw = text.encode()
            self.chars += len(text)
            if b"".join([bytes_a[x] for x in a]) != raw or b"".join([bytes_b[x] for x in b]) != raw:
                flat.append(0)
                counts.append(1)
                continue
            before = len(flat)
            if len(a) == 1 or len(b) == 1:
                flat.append(slot_of(a, b))
            else:
                for ga, gb in cut(a, b, self.size_a, self.size_b):
                    slot = known.get(ga[0] << BITS | gb[0]) if len(ga) == len(gb) == 1 else None
                    flat.append(slot_of(ga, gb) if slot is None else slot)
            counts.append(len(flat) - before)
        self.chunks.pool.add(np.array(flat, np.uint32), np.array(counts, np.int64))
        if self.fresh:
            sizes = np.array([(len(a), len(b)) for a, b in self.fresh], np.uint32)
            self.sizes.add(sizes.ravel(), np.full(len(sizes), 2))
            for pool, k in ((self.side_a, 0), (self.side_b, 1)):
                sides = [sorted(set(g[k])) for g in self.fresh]
                n = np.array([len(x) for x in sides], np.int64)
                pool.add(np.fromiter(chain.from_iterable(sides), np.uint32, int(n.sum())), n)
        self.chunks.new = []

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Group slots of all texts in a row, and the number of groups of each; none for a text without tokens."""
        table = self.chunks
        each = [[table[s] for s in stretches(t)] if t else [] for t in texts]
        self._fill()
        per = np.array([len(s) for s in each], np.int64)
        groups, counts = table.pool.get(np.fromiter(chain.from_iterable(each), np.int64, int(per.sum())))
        total, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(per)
        n = total[ends] - total[ends - per]
        document = np.repeat(np.arange(len(texts)), n)
        bad = np.zeros(len(texts), bool)
        bad[document[groups == 0]] = True
        n[bad] = 0
        return groups[~bad[document]].astype(np.int64), n

    def measures(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of A and of B tokens of each group."""
        both = self.sizes.ids[: 2 * self.sizes.slots].reshape(-1, 2).astype(np.int64)[groups]
        return both[:, 0], both[:, 1]


def repeated_pairs(document: np.ndarray, group: np.ndarray, side_a: Pool, side_b: Pool) -> np.ndarray:
    """Pairs that a document holds in more than one of its distinct groups, once for each group after the first.

    ``(document, group)`` are distinct and in order; a pair is ``a << BITS | b``.
    """
    size = side_a.count[group] * side_b.count[group]
    met = np.cumsum(size)
    at, out = 0, [np.empty(0, np.int64)]
    while at < len(document):
        before = met[at - 1] if at else 0
        to = int(np.searchsorted(met, before + PAIRS, "right"))
        if to < len(document):  # documents are whole
            to = int(np.searchsorted(document, document[to]))
        if to <= at:
            to = int(np.searchsorted(document, document[at], "right"))
        parts = int(-(-(met[to - 1] - before) // PAIRS))
        for part in range(parts):  # of a long document, some of the A ids at a time
            a, n = side_a.get(group[at:to])
            entry = np.repeat(np.arange(at, to), n)
            mine = a % parts == part
            entry, a = entry[mine], a[mine].astype(np.int64)
            b, n = side_b.get(group[entry])
            code = np.repeat((document[entry] - document[at]) << 2 * BITS | a << BITS, n) | b
            code.sort()
            out.append(code[1:][code[1:] == code[:-1]] & ((1 << 2 * BITS) - 1))
        at = to
    return np.concatenate(out)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _source(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    ready(df.sparkSession)
    return df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")), df.schema[id_column].dataType.simpleString()


def token_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """``(id_column, groups)``: the text's groups in order, each ``a1,a2|b1`` in decimal ids; an empty array without tokens."""
    source, kind = _source(df, id_column, text_column)
    a, b = paths or default_paths()

    def run(batches):
        both = aligner(a, b)
        for batch in batches:
            groups, n = both.batch(batch.column(1).to_pylist())
            keys = pa.array([both.keys[g] for g in groups.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), keys)], names=["id", "groups"])
            if both.full():
                both.reset()

    return source.mapInArrow(run, f"id {kind}, groups array<string>").withColumnRenamed("id", id_column)


class _Block:
    """Documents of one block, until it is written."""

    def __init__(self) -> None:
        self.rows, self.groups, self.repeats, self.chars = [], [], [], 0

    def add(self, both: Aligner, ids: pa.Array, texts: list[str | None]) -> None:
        groups, n = both.batch(texts)
        ends = np.cumsum(n)
        na, nb = both.measures(groups)
        sums = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[ends] - s[ends - n]
        document = np.repeat(np.arange(len(texts)), n)
        each, times = np.unique(document << 32 | groups, return_counts=True)
        document, distinct = each >> 32, each & 0xFFFFFFFF
        self.repeats.append(repeated_pairs(document, distinct, both.side_a, both.side_b))
        names = list(map(both.keys.__getitem__, groups.tolist()))
        digests = [hashlib.sha256(";".join(names[e - k : e]).encode()).hexdigest() if k else "" for e, k in zip(ends.tolist(), n.tolist())]
        self.groups.append(distinct)
        self.rows.append((ids, sums(na), sums(nb), n, sums(na * nb), digests, np.bincount(document, minlength=len(texts)), times))
        self.chars += sum(len(t) for t in texts if t)

    def write(self, both: Aligner, number: int, schema: pa.Schema):
        """One record batch for each that came in, and a row with the groups."""
        used, place = np.unique(np.concatenate(self.groups), return_inverse=True)
        at = 0
        for ids, na, nb, n, links, digests, distinct, times in self.rows:
            k = len(times)
            offsets = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
            own = pa.ListArray.from_arrays(offsets, pa.array(place[at : at + k], pa.int32()))
            often = pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))
            columns = [pa.array(np.full(len(n), number)), ids, *[pa.array(x, pa.int64()) for x in (na, nb, n, links)], pa.array(digests, pa.string()), own, often]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(n), t) for t in schema.types[9:]]], schema=schema)
            at += k
        if len(used):
            pairs, extra = np.unique(np.concatenate(self.repeats), return_counts=True)
            told = [[both.keys[g] for g in used.tolist()], np.bincount(place), pairs, extra]
            columns = [pa.array([number], pa.int64()), *[pa.nulls(1, t) for t in schema.types[1:9]], *[pa.array([x], t) for x, t in zip(told, schema.types[9:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def aligned_blocks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Rows of documents and, where ``keys`` is not null, of the blocks' groups; see the module's steps 1 and 2.

    Must be written before it is used: a block is known by the task that made it.
    """
    source, kind = _source(df, id_column, text_column)
    a, b = paths or default_paths()

    def run(batches):
        both, block, number, schema = aligner(a, b), _Block(), TaskContext.get().partitionId() << 32, None
        both.reset()
        for batch in batches:
            if schema is None:
                long, many = pa.int64(), pa.list_(pa.int32())
                names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "keys", "docs", "pairs", "extra"]
                types = [long, batch.schema.types[0], long, long, long, long, pa.string(), many, many, pa.list_(pa.string()), pa.list_(long), pa.list_(long), pa.list_(long)]
                schema = pa.schema(list(zip(names, types, strict=True)))
            block.add(both, batch.column(0), batch.column(1).to_pylist())
            if block.chars >= BLOCK_CHARS or both.full():
                yield from block.write(both, number, schema)
                block, number = _Block(), number + 1
                if both.full():
                    both.reset()
        if block.rows:
            yield from block.write(both, number, schema)

    longs = "n_a long, n_b long, n_groups long, n_links long"
    return source.mapInArrow(run, f"block long, id {kind}, {longs}, groups_sha256 string, places array<int>, times array<int>, keys array<string>, docs array<long>, pairs array<long>, extra array<long>")


def group_dictionary(blocks: DataFrame) -> DataFrame:
    """``(key, docs, blocks)``: every distinct group, the documents and the blocks that hold it."""
    zipped = F.explode(F.arrays_zip("keys", "docs")).alias("x")
    return blocks.where("keys is not null").select(zipped).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.docs").alias("docs"), F.count("*").alias("blocks"))


def links_of(groups: DataFrame) -> DataFrame:
    """``(key, docs, blocks, a, b, pair, times)``: every pair of ids of every group, and how often it is linked there."""
    ids = lambda k: F.transform(F.split(F.get(F.split("key", "[|]"), F.lit(k)), ","), lambda x: x.cast("long"))
    often = lambda of, x: F.size(F.filter(of, lambda y: y == F.col(x))).cast("long")
    left = groups.select("*", ids(0).alias("of_a"), ids(1).alias("of_b"))
    left = left.select("key", "docs", "blocks", "of_a", "of_b", F.explode(F.array_distinct("of_a")).alias("a"))
    both = left.select("key", "docs", "blocks", "a", often(F.col("of_a"), "a").alias("ka"), "of_b", F.explode(F.array_distinct("of_b")).alias("b"))
    pair = F.shiftleft("a", BITS).bitwiseOR(F.col("b"))
    return both.select("key", "docs", "blocks", "a", "b", pair.alias("pair"), (F.col("ka") * often(F.col("of_b"), "b")).alias("times"))


def pair_counts(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """``(pair, a, b, documents, groups)``: documents and distinct groups that hold each pair of ids linked."""
    held = links_of(groups).select("pair", "docs", F.lit(1).alias("one"))
    again = blocks.where("keys is not null").select(F.explode(F.arrays_zip("pairs", "extra")).alias("x")).select("x.pairs", -F.col("x.extra"), F.lit(0))
    total = held.union(again).groupBy("pair").agg(F.sum("docs").alias("documents"), F.sum("one").alias("groups"))
    low = (1 << BITS) - 1
    return total.select("pair", F.shiftright("pair", BITS).alias("a"), F.col("pair").bitwiseAND(F.lit(low)).alias("b"), "documents", "groups")


def alignment_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokens, groups, links, best links and counts of every text, with a digest of its groups."""
    blocks = materialize(aligned_blocks(df, id_column, text_column, paths), "blocks")
    groups = materialize(group_dictionary(blocks), "groups")
    counts = materialize(pair_counts(blocks, groups), "pairs")
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))  # a row an id of A's vocabulary
    rated = materialize(counts.join(F.broadcast(top), "a").select("pair", "documents", (F.col("documents") == F.col("top")).cast("long").alias("best"), "groups"), "rated")
    links = links_of(groups).select("key", "blocks", "pair", "times")
    scored = join_by_key(links, rated, "pair", "groups", "key").groupBy("key")
    scored = scored.agg(F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("documents")).alias("total"), F.first("blocks").alias("blocks"))
    scored = materialize(scored, "scored")
    held = blocks.where("keys is not null").select(F.col("block").alias("of"), F.posexplode("keys").alias("place", "key"))
    back = join_by_key(held, scored, "key", "blocks", "of").select("of", "place", "best", "total")
    documents = blocks.where("keys is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "places", "times", "groups_sha256")
    kind = df.schema[id_column].dataType.simpleString()

    def add_up(rows: pa.Table, scores: pa.Table) -> pa.Table:
        """Sums over the documents of one block."""
        order = np.argsort(scores.column("place").to_numpy())
        rows = rows.combine_chunks()
        places, times = rows.column("places").combine_chunks(), rows.column("times").combine_chunks()
        n = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at, often = np.cumsum(n), places.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sums = []
        for name in ("best", "total"):
            score = scores.column(name).to_numpy()[order]
            total = np.concatenate([[0], np.cumsum(score[at] * often)]) if len(at) else np.zeros(1, np.int64)
            sums.append(pa.array(total[ends] - total[ends - n], pa.int64()))
        keep = ["id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[rows.column(c) for c in keep], *sums, rows.column("groups_sha256")], names=[*keep, "n_best", "count_sum", "groups_sha256"])

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    # a block's documents meet its groups: both are bounded by the block's size
    out = documents.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(add_up, schema)
    return out.withColumnRenamed("id", id_column)
