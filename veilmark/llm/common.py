"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Whole texts travel in a batch, so it is kept small.
BATCH_ROWS = 512

#: Bytes in one range of an ordered table.
RANGE_BYTES = 64 << 20

#: Rows of one key that may meet in a task, at least, and keys that may be split.
SPLIT_ROWS, HOT_KEYS = 500, 10_000

#: What a "word" is in every contract of this subpackage: a run of bytes that
#: are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable on executors and bound the Arrow batches.

    The package travels as a zip through Spark's own file server, so workers
    need not share a file system or a PYTHONPATH with the driver.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root = os.path.dirname(package)
        target = os.path.join(tempfile.mkdtemp(prefix="veilmark-"), "veilmark_pkg.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, root))
        sc.addPyFile(target)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineages.

    ``spark.checkpoint.dir`` where it is set; a temporary folder of this
    machine only where it is not, as in local tests.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None or not os.path.isdir(made):
        made = shared_dir.made = tempfile.mkdtemp(prefix="veilmark-shared-")
    return "file://" + made


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and return the table.

    This cuts the lineage: a lost executor makes Spark reread files instead of
    recomputing, and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilmark/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/veilmark/" in path:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder below :func:`shared_dir` when the driver ends."""

    def gone() -> None:
        try:
            _remove(spark, path)
        except Exception:  # the context may have ended
            pass

    atexit.register(gone)


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of ``key`` that cut it evenly.

    One aggregate over a single column; the result is bounded by ``parts``.
    """
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, cuts, 20 * parts).alias("b"), F.min(key).alias("lo")).first()
    return sorted({b for b in (row["b"] or []) if b > row["lo"]})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Index of the range that holds ``key`` (null: 0), by binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    steps, width = [], 1
    while width <= len(bounds):
        width *= 2
    while width > 1:
        width //= 2
        steps.append(width)
    table = F.lit(bounds)
    move = lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step
    ).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), move)


def by_ranges(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` in partitions that are ascending ranges of ``key``, one range a partition; nulls lie in the first.

    There are as many ranges as keep ``size`` (bytes of the whole table) at
    ``RANGE_BYTES`` each, and as many as shuffle partitions at least. Only the
    key is read to place the bounds.
    """
    parts = max(partitions_for(df.sparkSession), -(-size // RANGE_BYTES))
    bounds = range_bounds(df, key, parts)
    return df.repartitionById(len(bounds) + 1, bucket_of(F.col(key), bounds))


def join_by_key(rows: DataFrame, table: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """``rows.join(table, key)`` for keys of any frequency.

    ``table`` holds a key once (read several times, so it should be a written
    table), and in ``size`` how many rows of ``rows`` have it. A key of more
    rows than ``SPLIT_ROWS`` and than 1/``HOT_KEYS`` of all is split by the
    hash of column ``spread``; there are fewer than ``HOT_KEYS`` of these, the
    bound of what is broadcast.
    """
    limit = max(SPLIT_ROWS, (table.agg(F.sum(size)).first()[0] or 0) // HOT_KEYS)
    salts = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit)).otherwise(1).cast("int")
    hot = table.where(F.col(size) > limit).select(F.col(key).alias("__key"), salts.alias("__salts"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__key", "__salts")
    right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "__salt"]).drop("__salt")


def partitions_for(spark: SparkSession, factor: int = 1) -> int:
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))
