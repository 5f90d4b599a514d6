"""Session settings the operators rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(app: str = "claimloom", cpus: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # as many partitions as cores; merging small ones would leave cores idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def pin_semantics(spark: SparkSession) -> SparkSession:
    """Timestamps without a zone are read as UTC; nothing else is changed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def materialise(df: DataFrame, name: str, folder: str | None) -> DataFrame:
    """Write an intermediate result once below the caller's folder and go on from the table.

    For results that several later steps read: they are then not computed again, a lost
    executor costs a read instead of the whole lineage, and the planner sees their real
    size. Without a folder nothing is written and the plan goes on. The folder is the
    caller's to remove when the results are done; on a cluster it must be one that all
    machines share, be it named with a scheme or by a path alone (which is one of the
    default file system).
    """
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
