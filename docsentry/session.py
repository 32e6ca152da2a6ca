"""SparkSession factory with the settings every job in this package assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app_name: str = "docsentry", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "64m")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def wide_partitions(spark: SparkSession) -> int:
    """Partition count for CPU-heavy stages: the configured shuffle width, at least one per core.

    An explicit count also keeps adaptive execution from merging such a stage
    into few tasks because its bytes are small.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder, removed when the application ends.

    ``spark.checkpoint.dir`` names storage that every executor can reach. Where
    it is unset, only a session in local mode, whose tasks share the machine's
    disk, gets a folder of its own; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def _local_root(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[master] = tempfile.mkdtemp(prefix="docsentry-")
    return _LOCAL_ROOTS[master]


_LOCAL_ROOTS: dict[str, str] = {}


def materialize(df, name: str):
    """Writes a table that several later steps read, and returns it.

    Cuts the lineage with files on shared storage, so losing an executor costs a
    re-read and not a re-scan of the corpus.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
