"""Readers and writers: micro-data, hierarchies, settings, releases and results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = "dataset string, release string, scope string, target string, metric string, attribute string, value double"
#: Names of files and folders below a release folder that hold something else.
NO_RELEASES = ("settings", "configs", "hierarchies", "hierarchy", "stats", "statistics")
KEYS = ("dataset", "release", "scope", "target", "metric", "attribute")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_microdata(spark: SparkSession, path: str, columns: list[str], index: str | None = None) -> DataFrame:
    """CSV with a header as strings, since a generalised number is no number; stars of any length become ``*``.

    ``index`` names the one of ``columns`` that numbers the rows; it becomes ``rid``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    starred = lambda c: F.when(F.col(c).rlike(r"^\*+$"), "*").otherwise(F.col(c)).alias(c)
    return df.select(*[F.col(c).cast("long").alias("rid") if c == index else starred(c) for c in columns])


def read_typed(spark: SparkSession, path: str, ddl: str, encoding: str = "UTF-8", cleanse: bool = True) -> DataFrame:
    """CSV with a header and given types. Rows that do not fit the types are left out, or fail the read without ``cleanse``."""
    return spark.read.csv(path, header=True, schema=ddl, enforceSchema=False, encoding=encoding, mode="DROPMALFORMED" if cleanse else "FAILFAST")


def read_hierarchy(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """``;``-separated hierarchy without a header as columns ``l0 .. l{levels-1}``; quotes may hold the separator."""
    schema = T.StructType([T.StructField(f"l{i}", T.StringType()) for i in range(levels)])
    return spark.read.csv(path, sep=";", quote='"', schema=schema)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``privacy_models, qid array, sa array`` of a settings file whose lists are written ``[a, b]``."""
    df = spark.read.csv(path, sep=";", header=True)
    items = lambda c: F.filter(F.split(F.regexp_replace(F.col(c), r"[\[\]\s]", ""), ","), lambda x: x != "")
    return df.select(F.col("privacy-models").alias("privacy_models"), items("qid").alias("qid"), items("sa").alias("sa"))


def read_releases(spark: SparkSession, root: str, columns: list[str], leave_out: tuple[str, ...] = NO_RELEASES) -> DataFrame:
    """All release tables below a folder, with their ``path``, ``name`` and ``levels``.

    ``levels`` is the level vector of a name like ``1_0_2`` and null for other
    names. Files and folders called as in ``leave_out`` are no releases.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(root, header=True, schema=schema)
    named = df.withColumn("path", F.col("_metadata.file_path")).withColumn("name", F.regexp_extract("path", r"([^/]+)\.csv$", 1))
    other = F.exists(F.split(F.regexp_replace("path", r"\.csv$", ""), "/"), lambda x: F.lower(x).isin(*leave_out))
    levels = F.when(F.col("name").rlike(r"^\d+(_\d+)*$"), F.split("name", "_").cast("array<int>"))
    return named.where(~other).withColumn("levels", levels)


def write_settings(spark: SparkSession, settings: list[tuple[str, list[str], list[str]]], path: str) -> None:
    """Privacy models, quasi-identifiers and sensitive attributes, as :func:`read_settings` reads them."""
    listed = lambda x: "[" + ", ".join(x) + "]"
    rows = [(m, listed(q), listed(s)) for m, q, s in settings]
    spark.createDataFrame(rows, "`privacy-models` string, qid string, sa string").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def write_configs(spark: SparkSession, configs: list[dict], path: str) -> None:
    """One row a configuration, numbered in order; values of one name have one type."""
    spark.createDataFrame([{"config": i, **c} for i, c in enumerate(configs)]).coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def write_statistics(df: DataFrame, path: str) -> None:
    """Statistics of nodes as ``;``-separated text with a header."""
    df.write.mode("overwrite").csv(path, sep=";", header=True)


def read_statistics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Statistics of several data sets below each other, with their ``dataset``; a column that one lacks is null there."""
    out = None
    for name, path in paths.items():
        one = spark.read.csv(path, sep=";", header=True, inferSchema=True).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_release(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Long results in which new values replace old ones of the same key."""
    same = [old[k].eqNullSafe(new[k]) for k in KEYS]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return old.join(new, condition, "left_anti").unionByName(new)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dataset").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Long results as :func:`write_results` or :func:`update_results` wrote them, in any earlier session."""
    current = _current(spark, path)
    return spark.read.schema(RESULT_SCHEMA).json(f"{path}/{current}" if current else path).select(*KEYS, "value")


#: Names the version of results that counts.
POINTER = "_CURRENT"


def update_results(new: DataFrame, path: str) -> DataFrame:
    """Merge new results into those at ``path`` and return all of them; old values of the same key go.

    The merged table is written as a version of its own beside the old one, and
    counts once a pointer file has been renamed into place, in one step. A
    failure before that leaves the old version as it was; what it left behind
    goes with the next update. One writer at a time.
    """
    spark = new.sparkSession
    files = _files(spark, path)
    before = _current(spark, path)
    merged = new if before is None and not _exists(spark, path) else merge_results(read_results(spark, path), new)
    version = f"_version-{uuid.uuid4().hex}"  # hidden from readers of the folder
    merged.select(*KEYS, "value").write.partitionBy("dataset").json(f"{path}/{version}")
    _point(spark, path, version)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for status in files.listStatus(hadoop.Path(path)):
        name = status.getPath().getName()
        if name not in (version, POINTER):
            files.delete(status.getPath(), True)
    return read_results(spark, path)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def _current(spark: SparkSession, path: str) -> str | None:
    if not _exists(spark, f"{path}/{POINTER}"):
        return None
    stream = _files(spark, path).open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Write the pointer aside and rename it over the old one."""
    jvm = spark.sparkContext._jvm
    hadoop, files = jvm.org.apache.hadoop.fs, _files(spark, path)
    aside, pointer = hadoop.Path(f"{path}/{version}.pointer"), hadoop.Path(f"{path}/{POINTER}")
    out = files.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = kind.getField("OVERWRITE").get(None)
    where = files.makeQualified(pointer)
    hadoop.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(aside), where, over)


def read_result_trees(spark: SparkSession, path: str) -> DataFrame:
    """``(release, task, metric, value)`` from JSON files of nested objects ``{release: {task: {metric: number}}}``.

    The tree is read as maps, so that names need not be known; files are read
    whole, one row each.
    """
    tree = F.from_json("value", "map<string, map<string, map<string, double>>>")
    release = spark.read.text(path, wholetext=True).select(F.explode(tree).alias("release", "tasks"))
    task = release.select("release", F.explode("tasks").alias("task", "metrics"))
    return task.select("release", "task", F.explode("metrics").alias("metric", "value"))


def split_metric(df: DataFrame, name: str = "metric") -> DataFrame:
    """``df`` with ``base``, ``target`` and ``scope`` of names like ``close_value_ratio_o_qid_0``: the last three tokens tell them apart."""
    parts = F.split(F.col(name), "_")
    long = F.size(parts) > 3
    last = lambda k: F.when(long, F.get(parts, F.size(parts) - k))
    base = F.when(long, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), "_")).otherwise(F.col(name))
    return df.select("*", base.alias("base"), last(3).alias("target"), last(2).alias("scope"), last(1).alias("part"))


def failed(status: DataFrame) -> DataFrame:
    """Releases whose measurement ended in an error, to be run again."""
    return status.where(F.col("error").isNotNull()).select("dataset", "release", "error")
