"""Token counts by section: encode a whole document once, then attribute its tokens.

Sections are half-open code-point intervals that do not overlap, by default
the lines (each with its line end). A token's interval runs from the character
that holds its first byte to the end of the character that holds its last.
Tokens and sections are joined by interval.

A token that crosses a boundary is allocated by rule:

* ``tokens``: to the section that holds most of its characters, the earlier
  one at a tie;
* ``share``: to every section it touches, by characters;
* ``crossing`` counts the crossing tokens that touch the section.

A token outside every section counts nowhere. Cases: a null text counts as
empty; an empty text has one empty section with no tokens; null or repeated
ids are carried along, repeated rows with a result each; texts of any length
are encoded whole; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder, ragged
from .common import ready


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines, which tile the text."""
    sizes = np.array([len(s) for s in text.split("\n")], np.int64)
    sizes[:-1] += 1
    ends = np.cumsum(sizes)
    if len(ends) > 1 and sizes[-1] == 0:  # nothing after the last line end
        ends = ends[:-1]
        sizes = sizes[:-1]
    return ends - sizes, ends


def token_intervals(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point intervals of tokens of the given byte lengths."""
    stops = np.cumsum(lengths)
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[stops - lengths], char[stops - 1] + 1


def attribute(begins: np.ndarray, stops: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens, share, crossing`` by section, of token intervals and sorted section intervals."""
    n = len(starts)
    first = np.searchsorted(ends, begins, "right")
    last = np.searchsorted(starts, stops, "left") - 1
    spread = last - first + 1  # sections touched; none if it lies in a gap
    token = np.repeat(np.arange(len(begins)), np.maximum(spread, 0))
    section = ragged(first, np.maximum(spread, 0))
    overlap = np.minimum(stops[token], ends[section]) - np.maximum(begins[token], starts[section])
    share = np.bincount(section, overlap / (stops - begins)[token], minlength=n)
    best = np.lexsort((section, -overlap, token))
    winner = best[np.append(True, token[best][1:] != token[best][:-1])] if len(best) else best
    tokens = np.bincount(section[winner], minlength=n)
    crossing = np.bincount(section[spread[token] > 1], minlength=n)
    return tokens, share, crossing


def tokens_by_section(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", sections: str | None = None, path: str | None = None) -> DataFrame:
    """``(id, section, start, end, tokens, share, crossing)``, one row a section.

    ``sections`` names a column of ``array<struct<start, end>>``; null entries
    and a null array count as none. Without it the lines are taken.
    """
    ready(df.sparkSession)
    path = path or default_path()
    source = df.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), *([F.col(sections).alias("sections")] if sections else []))
    names = ["id", "section", "start", "end", "tokens", "share", "crossing"]

    def run(batches):
        enc = encoder(path)
        length = enc.codec.lengths
        for batch in batches:
            texts = batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if sections else None
            ids, counts = enc.batch(texts)
            stop = np.cumsum(counts)
            rows, parts = [], []
            for i, text in enumerate(texts):
                if given is None:
                    s, e = line_sections(text)
                else:
                    pairs = sorted((x["start"], x["end"]) for x in given[i] or [] if x is not None)
                    s, e = np.array(pairs, np.int64).reshape(-1, 2).T
                own = length[ids[stop[i] - counts[i] : stop[i]]]
                if len(own):
                    found = attribute(*token_intervals(text.encode(), own), s, e)
                else:
                    found = (np.zeros(len(s), np.int64), np.zeros(len(s)), np.zeros(len(s), np.int64))
                rows.append(len(s))
                parts.append((np.arange(len(s)), s, e, *found))
            if not parts:
                continue
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            where = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), pa.array(cols[0], pa.int64()), *[pa.array(cols[k], pa.int64()) for k in (1, 2, 3)], pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int64())],
                names=names,
            )

    kind = df.schema[id_column].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, section long, start long, end long, tokens long, share double, crossing long")
    return out.withColumnRenamed("id", id_column)
