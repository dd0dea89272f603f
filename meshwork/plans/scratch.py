"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}

#: Rows that a file of a small table holds at most, about.
FILE_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in local mode, where that is unset, a folder of our own.

    On a cluster a folder of the driver's machine would be another one for each executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="meshwork-")
    return _local[app]


def cut(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a DataFrame that reads it.

    Unlike a local checkpoint the files outlive any executor, and unlike an RDD checkpoint later
    readers keep column pruning and pushed filters. Spark's commit protocol makes retried tasks safe.

    ``rows`` is how many there are at most, where that is known: a small table is then written by few
    tasks, not as a file for each partition of a shuffle. On a local disk Hadoop starts processes for
    the permissions of each file, which share the memory of the executor until they run.
    """
    spark = df.sparkSession
    if rows is not None and (files := max(1, -(-rows // FILE_ROWS))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/meshwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once what was computed from it is itself written."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver collects garbage, which a driver that only plans may not do for long.
    Frames that Python still holds in cycles are let go first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
