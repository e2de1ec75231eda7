"""Measuring many metrics of a release: chosen by name, failures kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "release string, metric string, attribute string, value double, error string"


def measure(spark: SparkSession, release: str, metrics: Mapping[str, Callable[[], DataFrame]], names: Iterable[str] | None = None) -> DataFrame:
    """Long rows of the named metrics (all by default), each a one-row frame of numbers.

    A metric that fails gives one row with its error, so that the others
    count and only failed ones need to run again.
    """
    rows = []
    for name in metrics if names is None else names:
        try:
            found = metrics[name]().first().asDict()
            rows += [(release, name, k, None if v is None else float(v), None) for k, v in found.items()]
        except Exception as e:  # any failure belongs into the report
            rows.append((release, name, None, None, f"{type(e).__name__}: {e}"[:300]))
    return spark.createDataFrame(rows, SCHEMA)
