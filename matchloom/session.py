"""Session helper and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def session(app: str = "matchloom", **conf) -> SparkSession:
    """A session with the settings the library expects (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster an unset
    folder is an error, because a lost executor would take the data with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/matchloom/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage durably: executors may be lost afterwards, values that depend on the
    physical layout stay fixed, and later reads still prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, through the cluster's file system API."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give per-row Python work every core when the input has fewer files than that.

    Fewer files than cores also bounds what the shuffle moves; larger inputs are left as
    they were read. ``key`` should be unique, so the spread is even and repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 0 < len(df.inputFiles()) < cores else df


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote with ``materialize``; results read from it end too."""
    remove_path(spark, f"{shared_dir(spark)}/matchloom/{spark.sparkContext.applicationId}")
