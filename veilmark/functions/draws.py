"""Seeded draws that any engine with MD5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1 << 32


def seeded(key: Column, *parts: object) -> Column:
    """Whole number in [0, 2**32): the first eight hexadecimal digits of the MD5 of ``key|part|...``."""
    text = F.concat_ws("|", key.cast("string"), *[F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def fraction(key: Column, *parts: object) -> Column:
    """The same as a number in [0, 1)."""
    return seeded(key, *parts) / F.lit(float(SCALE))
