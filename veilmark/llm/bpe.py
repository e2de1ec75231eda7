"""Byte-level BPE by backtracking over Aho-Corasick matches.

Two neighbouring tokens are *compatible* when BPE on their joined bytes gives
exactly these two tokens. A row of tokens is the BPE result if and only if all
neighbours are compatible, and every prefix of a text has one such row. So the
encoder walks left to right with the longest token at each place, takes a
shorter one when the pair is not compatible, and steps back from places that
have no continuation; each place is given up once at most, which keeps it
linear. Decoding slices one byte string by an offset table.

Cases: a null text counts as empty, and an empty text has no tokens; null ids
decode to a null text; texts of any length are encoded whole, a word of any
length in time linear in it; ties cannot occur, as a text has one encoding;
repeated rows and null row ids give a result each; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Pre-tokenizer of the vocabulary file (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's chunk table; a full table keeps them and adds none.
TABLE_ENTRIES = 350_000

#: Pieces of up to so many bytes are encoded many at a time.
LOCKSTEP_BYTES = 64


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = as_bytes(token)
        self.ids = {self.tokens[i]: i for i in vocab.values()}
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.length = [len(t) for t in self.tokens]
        # how each token is made
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.joined: dict[int, int] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j = vocab[a], vocab[b]
            made = vocab[a + b]
            self.joined[i << 20 | j] = made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, i, j
        self.shorter = [-1] * size
        for token, i in self.ids.items():
            for k in range(len(token) - 1, 0, -1):
                if (s := self.ids.get(token[:k])) is not None:
                    self.shorter[i] = s
                    break
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in self.ids.items():
            self.matcher.add_word(token.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.split = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.seen, self.fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.lengths, self.shorter_than = np.array(self.length, np.int64), np.array(self.shorter, np.int64)
        # offset table of the decoder
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.ends = np.cumsum([0, *self.length], dtype=np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the seam between tokens ``a`` and ``b``.

        Goes back in time along the seam: of the two pieces next to it, the
        one made last is taken apart. A merge across the seam would have
        happened if it ranks before the merge that consumes either piece; at
        equal rank the left one goes first.
        """
        key = a << 20 | b
        rank, until_a, until_b, result = self.rank, 1 << 60, 1 << 60, True
        while True:
            made = self.joined.get(a << 20 | b)
            if made is not None and rank[made] < until_a and rank[made] <= until_b:
                result = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[b] >= rank[a]:
                until_b, b = rank[b], self.left[b]
            else:
                until_a, a = rank[a], self.right[a]
        if len(self.pairs) >= TABLE_ENTRIES:
            self.pairs.clear()
        self.pairs[key] = result
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, length = len(piece), self.length
        if not n:
            return []
        longest = [0] * n
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            # at one end the longest match comes first, later ends overwrite with longer ones
            longest[end + 1 - length[token]] = token
        alive = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token, known = 0, longest[0], self.pairs.get
        while True:
            end = at + length[token]
            if alive[end]:
                fits = True
                if out:
                    fits = known(out[-1] << 20 | token)
                    if fits is None:
                        fits = self.compatible(out[-1], token)
            else:
                fits = False
            if fits:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:
                alive[at] = 0
                last = out.pop()
                at -= length[last]
                token = self.shorter[last]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces in a row, and how many each has.

        The same walk as :meth:`encode_piece`, one step at a time for all
        pieces at once. Long pieces go one by one, which bounds the stacks.
        """
        counts = np.zeros(len(pieces), np.int64)
        parts: list = [None] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                parts[i] = [whole]
            elif len(piece) > LOCKSTEP_BYTES:
                parts[i] = self.encode_piece(piece)
            elif piece:
                short.append(i)
        for i, p in enumerate(parts):
            if p is not None:
                counts[i] = len(p)
        where = np.array(short, np.int64)
        if short:
            stack, depth = self._lockstep([pieces[i] for i in short])
            counts[where] = depth
        out = np.empty(int(counts.sum()), np.uint32)
        ends = np.cumsum(counts)
        if short:
            out[ragged(ends[where] - depth, depth)] = stack[np.arange(stack.shape[1])[None, :] < depth[:, None]]
        for i, p in enumerate(parts):
            if p is not None:
                out[ends[i] - len(p) : ends[i]] = p
        return out, counts

    def _lockstep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        # a separator that no token holds keeps matches inside a piece
        text = "\u0100".join([p.decode("latin-1") for p in pieces])
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        last = first + sizes
        end, token = np.fromiter(chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2).T
        longest = np.full(len(text) + 1, -1, np.int64)
        longest[end + 1 - self.lengths[token]] = token  # of equal starts the last, which is the longest
        alive = np.ones(len(text) + 1, bool)
        stack = np.zeros((len(pieces), int(sizes.max())), np.int64)
        depth = np.zeros(len(pieces), np.int64)
        row, at, now = np.arange(len(pieces)), first.copy(), longest[first]
        while len(row):
            d = depth[row]
            end = at + self.lengths[now]
            fits = alive[end]
            inner = np.flatnonzero(fits & (d > 0))
            if len(inner):
                fits[inner] = self._compatible(stack[row[inner], d[inner] - 1], now[inner])
            yes, no = np.flatnonzero(fits), np.flatnonzero(~fits)
            stack[row[yes], d[yes]] = now[yes]
            depth[row[yes]] += 1
            at[yes] = end[yes]
            now[yes] = longest[end[yes]]
            now[no] = self.shorter_than[now[no]]
            back = no[now[no] < 0]
            while len(back):
                alive[at[back]] = False
                r = row[back]
                depth[r] -= 1
                gone = stack[r, depth[r]]
                at[back] -= self.lengths[gone]
                now[back] = self.shorter_than[gone]
                back = back[now[back] < 0]
            going = at < last[row]
            if not going.all():
                row, at, now = row[going], at[going], now[going]
        return stack, depth

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of many pairs, through a direct-mapped table."""
        key = a << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        known = self.seen[slot] == key
        if not known.all():
            for k in np.flatnonzero(~known).tolist():
                pair, s = int(key[k]), slot[k]
                fits = self.pairs.get(pair)
                if fits is None:
                    fits = self.compatible(pair >> 20, pair & 0xFFFFF)
                self.seen[s], self.fits[s] = pair, fits
            stale = np.flatnonzero(self.seen[slot] != key)  # two pairs of this call in one slot
            out = self.fits[slot]
            for k in stale.tolist():
                out[k] = self.pairs.get(int(key[k])) if int(key[k]) in self.pairs else self.compatible(int(a[k]), int(b[k]))
            return out
        return self.fits[slot]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which no special token is looked for."""
        out: list[int] = []
        for piece in self.split.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def encode(self, text: str) -> list[int]:
        if self.cut is None or "<" not in text:
            return self.encode_plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.encode_plain(part)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        starts = self.ends[ids]
        return self.blob[ragged(starts, self.ends[ids + 1] - starts)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + c) ...])``."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


class Pool:
    """Rows of ids behind slot numbers, in arrays that grow."""

    def __init__(self) -> None:
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count, self.slots = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n, k = len(ids), len(counts)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(n, len(self.ids)), np.uint32)])
        if self.slots + k > len(self.start):
            more = np.empty(max(k, len(self.start)), np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more])
        self.ids[self.used : self.used + n] = ids
        self.start[self.slots : self.slots + k] = self.used + np.cumsum(counts) - counts
        self.count[self.slots : self.slots + k] = counts
        self.used, self.slots = self.used + n, self.slots + k

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots in a row, and how many each has."""
        counts = self.count[slots]
        return self.ids[ragged(self.start[slots], counts)], counts


class Table(dict):
    """Slot numbers of keys; a key seen for the first time gets the next one and waits in ``new``."""

    def __init__(self) -> None:
        self.pool, self.new = Pool(), []

    def __missing__(self, key: str) -> int:
        slot = self[key] = self.pool.slots + len(self.new)
        self.new.append(key)
        return slot


#: Two white-space characters in a row, or one at either end: blanks can't be cut there.
_UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")


class Encoder:
    """Whole texts to ids. Chunks between blanks are encoded once and kept in a bounded table."""

    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        self.reset()

    def reset(self) -> None:
        self.chunks, self.pieces = Table(), Table()

    def slots(self, text: str) -> list[int]:
        """Slots whose ids, in order, are the ids of ``text``.

        A blank between two characters that are not white space always begins
        a pre-tokenizer piece, so the text can be cut in front of it. Special
        tokens stand alone, as the texts between them do.
        """
        cut = self.codec.cut
        if "<" in text and cut is not None and cut.search(text):
            return [s for part in cut.split(text) if part for s in ([self.chunks[(part,)]] if part in self.codec.special else self._plain(part))]
        return self._plain(text) if text else []

    def _plain(self, text: str) -> list[int]:
        chunks = self.chunks
        if _UNEVEN.search(text):
            return [chunks[c] for c in self._uneven(text)]
        at = text.find(" ")
        if at < 0:
            return [chunks[text]]
        parts = text[at + 1 :].split(" ")
        return [chunks[text[:at]], *map(chunks.__getitem__, [" " + p for p in parts])]

    def _uneven(self, text: str) -> list[str]:
        parts = text.split(" ")
        out, held = [], parts[0]
        for before, part in zip(parts, parts[1:]):
            if part and before and not part[0].isspace() and not before[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        return [*out, held]

    def _fill(self) -> tuple[list, list]:
        """Encode the chunks that wait; returns the new chunks and pieces."""
        chunks, pieces, codec = self.chunks, self.pieces, self.codec
        added = (chunks.new, pieces.new)
        if not chunks.new:
            return added
        flat, sizes = [], []
        for chunk in chunks.new:
            if isinstance(chunk, tuple):
                own = [pieces[chunk]]
            elif chunk.isalpha():
                own = [pieces[chunk]]
            else:
                own = [pieces[p] for p in codec.split.findall(chunk)]
            flat += own
            sizes.append(len(own))
        if pieces.new:
            special = [k for k, p in enumerate(pieces.new) if isinstance(p, tuple)]
            ids, counts = codec.encode_pieces([b"" if isinstance(p, tuple) else p.encode() for p in pieces.new])
            for k in special[::-1]:
                ids = np.insert(ids, int(counts[:k].sum()), codec.special[pieces.new[k][0]])
                counts[k] = 1
            pieces.pool.add(ids, counts)
        ids, counts = pieces.pool.get(np.array(flat, np.int64))
        total, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes)
        chunks.pool.add(ids, total[ends] - total[ends - np.array(sizes)])
        chunks.new, pieces.new = [], []
        return added

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each.

        What a batch adds to a full table goes again, so memory stays bounded
        and the common chunks, which come early, stay.
        """
        tables = (self.chunks, self.pieces)
        marks = [(t.pool.slots, t.pool.used) for t in tables]
        each = [self.slots(t) for t in texts]
        added = self._fill()
        sizes = np.array([len(s) for s in each], np.int64)
        flat = np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum()))
        ids, counts = self.chunks.pool.get(flat)
        if marks[0][0] > TABLE_ENTRIES:
            for table, mark, keys in zip(tables, marks, added, strict=True):
                for k in keys:
                    del table[k]
                table.pool.slots, table.pool.used = mark
        total, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``(id_column, ids binary, n_tokens long, ids_text string[, decoded string])``, one row a text.

    ``ids`` are little-endian unsigned 32-bit integers. A null text counts as
    empty and gives no ids; special tokens in a text become their ids.
    Repeated rows give repeated results; ids may be null or repeat. No
    shuffle: the work of a row stays in its task.
    """
    ready(df.sparkSession)
    path = path or default_path()
    source = df.select(F.col(id_column).alias("__id"), F.coalesce(text_column, F.lit("")).alias("__text"))
    schema = f"__id {df.schema[id_column].dataType.simpleString()}, ids binary, n_tokens long, ids_text string" + ", decoded string" * decoded

    def run(batches):
        enc = encoder(path)
        digits = [str(i) for i in range(len(enc.codec.tokens))]
        for batch in batches:
            ids, counts = enc.batch(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            parts = [ids[e - c : e] for e, c in zip(ends, counts, strict=True)]
            said = [",".join(map(digits.__getitem__, p.tolist())) for p in parts]
            cols = [batch.column(0), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()), pa.array(counts, pa.int64()), pa.array(said, pa.string())]
            if decoded:
                cols.append(pa.array([enc.codec.decode(p) for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["__id", "ids", "n_tokens", "ids_text"] + ["decoded"] * decoded)

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_column)


def bpe_decode(df: DataFrame, id_column: str, ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """``(id_column, text string)`` from binary ids; null ids give a null text."""
    ready(df.sparkSession)
    path = path or default_path()
    source = df.select(F.col(id_column).alias("__id"), F.col(ids_column).alias("__ids"))
    schema = f"__id {df.schema[id_column].dataType.simpleString()}, text string"

    def run(batches):
        codec = encoder(path).codec
        for batch in batches:
            texts = [None if b is None else codec.decode(np.frombuffer(b, "<u4").astype(np.int64)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__id", "text"])

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_column)


def bpe_digest(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them."""
    t = bpe_encode(df, id_column, text_column, path, decoded=True)
    return t.select(id_column, "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
