"""Values that stand for a range: ``[1, 6[``, ``12***``, ``*`` and plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTERVAL = r"^\[(-?\d+(?:\.\d+)?), ?(-?\d+(?:\.\d+)?)\[$"
_MASKED = r"^\d+\*+$"


def parse_range(value: Column, lo: float, hi: float) -> Column:
    """``struct<lo double, hi double>``, both ends included.

    Intervals are half-open over integers, stars stand for any digit, and a
    value of stars alone for the whole domain. Anything else gives nulls.
    """
    text = F.trim(value.cast("string"))
    low, high = F.regexp_extract(text, _INTERVAL, 1), F.regexp_extract(text, _INTERVAL, 2)
    number = text.try_cast("double")
    return F.struct(
        F.when(text.rlike(_INTERVAL), low.try_cast("double")).when(text.rlike(r"^\*+$"), F.lit(float(lo)))
        .when(text.rlike(_MASKED), F.translate(text, "*", "0").try_cast("double")).otherwise(number).alias("lo"),
        F.when(text.rlike(_INTERVAL), high.try_cast("double") - 1).when(text.rlike(r"^\*+$"), F.lit(float(hi)))
        .when(text.rlike(_MASKED), F.translate(text, "*", "9").try_cast("double")).otherwise(number).alias("hi"),
    )


def is_generalized(value: Column) -> Column:
    """Whether a numeric column's text is no plain number."""
    return value.cast("string").try_cast("double").isNull()


def midpoint(value: Column, lo: float, hi: float) -> Column:
    """Middle of the range that a value stands for."""
    r = parse_range(value, lo, hi)
    return (r["lo"] + r["hi"]) / 2


def half_open_midpoint(value: Column, suppressed: int) -> Column:
    """Whole part of the mean of an interval's written ends; ``suppressed`` for stars."""
    text = value.cast("string")
    low, high = F.regexp_extract(text, _INTERVAL, 1).try_cast("double"), F.regexp_extract(text, _INTERVAL, 2).try_cast("double")
    return F.when(text.rlike(r"^\*+$"), F.lit(suppressed)).when(text.rlike(_INTERVAL), ((low + high) / 2).cast("int")).otherwise(text.try_cast("double").cast("int"))


def interval_text(value: Column, width: int, lo: int, end: int) -> Column:
    """The interval of a grid from ``lo`` that holds an integer, cut at ``end``."""
    start = F.floor((value - lo) / F.lit(width)) * width + lo
    return F.concat(F.lit("["), start.cast("string"), F.lit(", "), F.least(start + width, F.lit(end)).cast("string"), F.lit("["))
