"""Media columns: Ogg containers (RFC 3533) written and read inside Spark tasks.

``ogg_column`` stores a binary column as Ogg; ``ogg_pages`` and
``ogg_packets`` read any Ogg column: pages with verified checksums, packets
put together from lacing values, logical streams kept apart by serial number
and packet end times from granule positions. Each row is one file, handled in
one task without a shuffle.

Cases: a null file gives no pages and no packets; an empty file likewise;
bytes between pages are skipped and counted; a page whose checksum fails is
reported with ``ok = false`` and its packets are left out; a packet that
continues over a lost page is dropped. A null or empty text is stored as 64
zero bytes. Texts of any length are stored whole, one file each, so a task
holds some copies of its longest text. Repeated rows and null ids give a
result each; an empty table gives no rows; columns that are neither named nor
kept are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP8 = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

#: Payload bytes (8-bit samples) in one data packet, and samples a second.
PACKET, RATE = 4096, 8000
#: Identification packet of this module's sample streams: magic, samples a second, number of streams.
IDENT = struct.Struct("<8sII")
MAGIC = b"VMSAMPLE"


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, start 0.

    zlib's CRC is the same polynomial with mirrored bits, so bytes are
    mirrored before it and the result after it.
    """
    mirrored = zlib.crc32(page.translate(_FLIP8), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP8), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + page_checksum(whole).to_bytes(4, "little") + whole[26:]


class StreamWriter:
    """Pages of one logical stream. A packet may span pages."""

    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0
        self.lacing, self.body, self.flags = bytearray(), bytearray(), FIRST
        self.granule = -1

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        at = 0
        while at <= len(data):
            if len(self.lacing) == 255:
                yield self.flush(0)
                self.flags = CONTINUED if at else 0
            part = min(255, len(data) - at)
            self.lacing.append(part)
            self.body += data[at : at + part]
            at += part
            if part < 255:
                break
        self.granule = granule

    def flush(self, flags: int) -> bytes:
        page = _page(self.serial, self.number, self.flags | flags, self.granule, bytes(self.lacing), bytes(self.body))
        self.number += 1
        self.lacing, self.body, self.flags, self.granule = bytearray(), bytearray(), 0, -1
        return page


def write_samples(payload: bytes, streams: int = 2, rate: int = RATE, packet: int = PACKET) -> bytes:
    """8-bit samples as an Ogg file of interleaved logical streams.

    Packet *i* goes to stream *i mod streams*; its granule position is the
    number of payload samples up to its end, over all streams.
    """
    writers = [StreamWriter(0x564D0000 + s) for s in range(streams)]
    out = []
    for w in writers:
        out += w.packet(IDENT.pack(MAGIC, rate, streams), 0)
        out.append(w.flush(0))
    n = -(-len(payload) // packet)
    for i in range(n):
        w = writers[i % streams]
        end = min((i + 1) * packet, len(payload))
        out += w.packet(payload[i * packet : end], end)
        if len(w.lacing) > 100:
            out.append(w.flush(0))
    out += [w.flush(LAST) for w in writers]
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[dict]:
    """Every page, in file order; ``skipped`` counts the bytes before it that are no page."""
    at, skipped = 0, 0
    while True:
        found = data.find(CAPTURE, at)
        if found < 0:
            return
        skipped += found - at
        if found + 27 > len(data):
            return
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(data, found)
        body = found + 27 + segments
        lacing = data[found + 27 : body]
        end = body + sum(lacing)
        whole = len(lacing) == segments and end <= len(data) and version == 0
        ok = whole and page_checksum(data[found : found + 22] + b"\0\0\0\0" + data[found + 26 : end]) == crc
        yield {
            "offset": found, "serial": serial, "number": number, "flags": flags, "granule": granule,
            "lacing": lacing, "body": data[body:end] if ok else b"", "ok": ok, "skipped": skipped,
        }
        skipped = 0
        at = end if ok else found + 4
        if not ok:
            skipped = 4


def read_packets(data: bytes) -> Iterator[dict]:
    """Packets of all logical streams, in the order in which they end.

    ``granule`` is the page's granule position on the last packet that ends in
    the page, else null: the format gives no position to the others.
    """
    open_: dict[int, tuple[bytearray, int]] = {}  # parts of a packet that continues, by serial
    expect: dict[int, int] = {}
    index: dict[int, int] = {}
    for page in read_pages(data):
        if not page["ok"]:
            continue
        serial = page["serial"]
        if page["flags"] & FIRST:
            open_.pop(serial, None)
            index[serial] = 0
        elif expect.get(serial, page["number"]) != page["number"]:
            open_.pop(serial, None)
        expect[serial] = page["number"] + 1
        parts, lost = open_.pop(serial, None), False
        if page["flags"] & CONTINUED:
            lost = parts is None
        else:
            parts = None
        parts = bytearray() if parts is None else parts
        done, at = [], 0
        for part in page["lacing"]:
            parts += page["body"][at : at + part]
            at += part
            if part < 255:
                if not lost:
                    done.append(bytes(parts))
                parts, lost = bytearray(), False
        if page["lacing"] and page["lacing"][-1] == 255 and not lost:
            open_[serial] = parts
        for k, packet in enumerate(done):
            last = k == len(done) - 1 and page["granule"] >= 0
            yield {"serial": serial, "index": index.get(serial, 0), "data": packet, "granule": page["granule"] if last else None}
            index[serial] = index.get(serial, 0) + 1


def read_samples(data: bytes) -> dict:
    """Payload of a file by :func:`write_samples`, from its packets alone."""
    pages = bad = skipped = 0
    for page in read_pages(data):
        pages += 1
        bad += not page["ok"]
        skipped += page["skipped"]
    by_stream: dict[int, list[bytes]] = {}
    last: dict[int, int] = {}
    rate = RATE
    for p in read_packets(data):
        own = by_stream.setdefault(p["serial"], [])
        if p["index"] == 0 and p["data"].startswith(MAGIC):
            rate = IDENT.unpack(p["data"])[1]
        else:
            own.append(p["data"])
        if p["granule"] is not None:
            last[p["serial"]] = max(last.get(p["serial"], 0), p["granule"])
    order = sorted(by_stream)
    depth = max((len(by_stream[s]) for s in order), default=0)
    payload = b"".join(by_stream[s][k] for k in range(depth) for s in order if k < len(by_stream[s]))
    return {
        "payload": payload, "pages": pages, "bad": bad, "skipped": skipped, "streams": len(order),
        "packets": sum(map(len, by_stream.values())), "seconds": max(last.values(), default=0) / rate,
        "ends": [last.get(s, 0) / rate for s in order],
    }


def _each(df: DataFrame, column: str, keep: list[str], schema: str, rows_of) -> DataFrame:
    """One or more output rows for each input row, in Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kept = df.select(*keep, F.col(column).alias("__value"))
    made = _parse_datatype_string(schema)
    out = StructType([*kept.select(*keep).schema.fields, *made.fields])
    arrow = to_arrow_schema(out)
    names = [f.name for f in made.fields]

    def run(batches):
        for batch in batches:
            head = [batch.column(i).to_pylist() for i in range(len(keep))]
            for i, value in enumerate(batch.column(len(keep)).to_pylist()):
                rows = list(rows_of(value))
                if rows:
                    cols = [[h[i]] * len(rows) for h in head] + [[r[n] for r in rows] for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    ready(df.sparkSession)
    return kept.mapInArrow(run, out)


def ogg_pages(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows ``(*keep, offset, serial, number, flags, granule, segments, body_bytes, ok, skipped)``, one a page."""

    def rows(value):
        for p in read_pages(value or b""):
            yield p | {"segments": len(p["lacing"]), "body_bytes": sum(p["lacing"])}

    return _each(df, column, keep, "offset long, serial long, number long, flags int, granule long, segments int, body_bytes long, ok boolean, skipped long", rows)


def ogg_packets(df: DataFrame, column: str, keep: list[str], rate: int = RATE) -> DataFrame:
    """Rows ``(*keep, serial, index, data, granule, seconds)``, one a packet; ``seconds`` is the packet's end."""

    def rows(value):
        for p in read_packets(value or b""):
            yield p | {"seconds": None if p["granule"] is None else p["granule"] / rate}

    return _each(df, column, keep, "serial long, index long, data binary, granule long, seconds double", rows)


def ogg_round_trip(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", streams: int = 2) -> DataFrame:
    """Store each text as Ogg, read the bytes back, and describe both.

    The payload is the text's UTF-8 (null: empty) with zero bytes up to a
    positive multiple of 64. Returns ``id_column, media binary, payload
    binary, n_bytes long, feature string``. ``feature`` holds what the
    container says: streams, packets, pages, failed pages, duration and mean
    and spread of the samples. Repeated rows give repeated results.
    """
    import numpy as np

    def rows(text):
        raw = (text or "").encode()
        media = write_samples(raw + bytes(-len(raw) % 64 or (0 if raw else 64)), streams)
        back = read_samples(media)
        x = np.frombuffer(back["payload"], np.uint8)
        feature = f"streams={back['streams']};packets={back['packets']};pages={back['pages']};bad={back['bad']};seconds={back['seconds']:.6f};mean={x.mean():.6f};std={x.std():.6f}"
        yield {"media": media, "payload": back["payload"], "n_bytes": len(raw), "feature": feature}

    return _each(df, text_column, [id_column], "media binary, payload binary, n_bytes long, feature string", rows)


def ogg_digest(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The digests of :func:`ogg_round_trip`, computed by Spark from what was stored and read back."""
    t = ogg_round_trip(df, id_column, text_column)
    return t.select(
        id_column,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
