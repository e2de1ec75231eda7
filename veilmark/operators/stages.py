"""Tables that cut a lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; a folder of this machine only without a cluster, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_folder, "made", None)
    if made is None or not os.path.isdir(made):
        made = shared_folder.made = tempfile.mkdtemp(prefix="veilmark-stages-")
    return "file://" + made


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: later readers see the same rows, and a lost executor costs a read.

    The files go when the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veilmark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`staged`; nothing may read them any more."""
    for table in tables:
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            if "/veilmark/" in path:
                _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session may have ended
        pass
