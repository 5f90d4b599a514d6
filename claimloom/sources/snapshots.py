"""Flight status snapshots as files: one JSON object per line.

Each line is {"seq", "flight_number", "observed_at", "response_json"}; the response is
kept as text, because a broken one is an outcome and not an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seq BIGINT, flight_number STRING, observed_at TIMESTAMP_NTZ, response_json STRING"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder)


def write_snapshots(snapshots: DataFrame, folder: str) -> None:
    """Snapshots in the form they are read, with times to the microsecond."""
    columns = ("seq", "flight_number", "observed_at", "response_json")
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    snapshots.select(*columns).write.option("timestampNTZFormat", exact).json(folder)


def stream_snapshots(
    spark: SparkSession, folder: str, files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )
