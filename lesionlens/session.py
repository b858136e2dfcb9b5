"""Session set-up and lineage cuts on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "lesionlens") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    cores = int(cpus)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LESIONLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for lineage cuts: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the setting is an
    error, because executors could not read each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[app]


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) in the JVM, whatever store the path is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below :func:`checkpoint_root` that is dropped when the application ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, target = hadoop_path(spark, path)
    fs.deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table below :func:`checkpoint_root` and read it back.

    Used where a plan must not be evaluated twice (range partition ids, iteration state) and where
    a later choice needs the real size of an intermediate result. Unlike cached blocks the files
    outlive executors, and unlike an RDD checkpoint they keep column pruning and size statistics.
    The folder is dropped when the application ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table from :func:`materialize` that nothing will read again; other tables are left alone."""
    path = getattr(df, "_stored_at", None)
    if path:
        fs, target = hadoop_path(df.sparkSession, path)
        fs.delete(target, True)
