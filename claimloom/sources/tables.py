"""Tables in a folder of parquet files, without an updatable table format.

A table that is replaced or updated is written as a new version folder; readers take the
newest complete one (catalogs with an updatable format have MERGE for this), so a path being
read is never overwritten and a lost executor only costs a retried task.

A table with a key is written in pieces by a hash of the key. Its version is a list of pieces,
each with the version folder that holds it, and the list is written last: an update writes the
pieces that hold a changed key and lists the others where they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: columns of the case-run table.
CASE_RUNS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_text", T.StringType()),
        T.StructField("grievance_type", T.StringType()),
        T.StructField("facts_json", T.StringType()),
        T.StructField("intake_json", T.StringType()),
        T.StructField("match_json", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Columns of the flight-tracking table.
FLIGHTS = T.StructType(
    [
        T.StructField("flight_number", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("initial_departure_time", T.TimestampNTZType()),
        T.StructField("delay", T.IntegerType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("last_check", T.TimestampNTZType()),
    ]
)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _glob(spark: SparkSession, pattern: str) -> list:
    """Paths that match; a pattern in braces stands for its alternatives."""
    jvm, fs = _filesystem(spark, pattern)
    return [status.getPath() for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    whole = [p.getParent().getName() for p in _glob(spark, f"{folder}/version=*/_SUCCESS")]
    listed = [p.getParent().getParent().getName() for p in _glob(spark, f"{folder}/version=*/pieces/_SUCCESS")]
    return sorted(int(name.split("=")[1]) for name in whole + listed)


def read_table(
    spark: SparkSession, folder: str, version: int | None = None
) -> DataFrame:
    if version is None:
        known = versions(spark, folder)
        if not known:
            raise FileNotFoundError(f"no complete version below {folder}")
        version = known[-1]
    if _glob(spark, f"{folder}/version={version}/pieces/_SUCCESS"):
        return _read_pieces(spark, folder, *_listed(spark, folder, version))
    return spark.read.parquet(f"{folder}/version={version}")


def replace_table(df: DataFrame, folder: str, version: int | None = None) -> int:
    """Write the whole table as a version. Writing the same version again replaces it,
    which makes a repeated batch harmless."""
    if version is None:
        known = versions(df.sparkSession, folder)
        version = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    return version


#: Pieces a keyed table is written in; an update rewrites the pieces with changed keys.
PIECES = 64


def _piece(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PIECES)).cast("int")


def _write_pieces(df: DataFrame, folder: str, key: str, version: int) -> dict[int, int]:
    """Write rows in pieces below the version; the pieces that came about, in this version."""
    path = f"{folder}/version={version}/rows"
    remove_folder(df.sparkSession, f"{folder}/version={version}")  # what a failed attempt left
    # a file per piece, not one per piece and task
    df.withColumn("piece", _piece(key)).repartition("piece").write.partitionBy("piece").parquet(path)
    return {int(p.getName().split("=")[1]): version for p in _glob(df.sparkSession, f"{path}/piece=*")}


def _publish(spark: SparkSession, folder: str, version: int, held: dict[int, int], schema: T.StructType) -> None:
    """Write the list of a version's pieces; with it, the version is complete."""
    rows = [(piece, of, None) for piece, of in sorted(held.items())] + [(-1, -1, schema.json())]
    listed = spark.createDataFrame(rows, "piece int, version bigint, schema string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}/pieces")


def _listed(spark: SparkSession, folder: str, version: int) -> tuple[dict[int, int], T.StructType]:
    """Pieces of a version with the version that holds each (at most PIECES), and the columns."""
    rows = spark.read.parquet(f"{folder}/version={version}/pieces").collect()
    schema = next(r.schema for r in rows if r.piece < 0)
    return {r.piece: r.version for r in rows if r.piece >= 0}, T.StructType.fromJson(json.loads(schema))


def _read_pieces(spark: SparkSession, folder: str, held: dict[int, int], schema: T.StructType) -> DataFrame:
    paths = [f"{folder}/version={of}/rows/piece={piece}" for piece, of in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_keyed(df: DataFrame, folder: str, key: str, version: int = 0) -> None:
    """Write a version in pieces by a hash of the key, ready for update_table."""
    _publish(df.sparkSession, folder, version, _write_pieces(df, folder, key, version), df.schema)


def update_table(
    spark: SparkSession,
    folder: str,
    version: int,
    changed: DataFrame,
    key: str,
    update: Callable[[DataFrame], DataFrame],
) -> None:
    """Write version + 1 of a keyed table, which exists when its list of pieces is written.

    `update` gets the rows of the pieces that hold a key of `changed`, and returns those pieces
    anew: changed, removed and added rows of such keys. The other pieces stay the files they
    are. Of `changed` at most PIECES numbers reach the driver. Writing the newest version again
    replaces it; an older one stays, since later ones list its pieces.
    """
    if any(v > version + 1 for v in versions(spark, folder)):
        raise ValueError(f"version {version + 1} of {folder} has later versions")
    touched = {r[0] for r in changed.select(_piece(key)).distinct().collect()}
    held, schema = _listed(spark, folder, version)
    rows = _read_pieces(spark, folder, {p: of for p, of in held.items() if p in touched}, schema)
    new = update(rows).select(*schema.fieldNames())
    written = _write_pieces(new, folder, key, version + 1)
    _publish(spark, folder, version + 1, {p: of for p, of in held.items() if p not in touched} | written, schema)


def retire_versions(spark: SparkSession, folder: str, keep: int) -> None:
    """Delete all but the newest versions of a table; pieces that a newer version lists stay."""
    known = versions(spark, folder)
    old, kept = known[:-keep], known[-keep:]
    used = set()
    for version in kept:
        if _glob(spark, f"{folder}/version={version}/pieces/_SUCCESS"):
            used |= {(of, piece) for piece, of in _listed(spark, folder, version)[0].items()}
    for version in old:  # the list goes first, and with it the version
        remove_folder(spark, f"{folder}/version={version}/pieces")
    for path in _glob(spark, f"{folder}/version=*"):
        version = int(path.getName().split("=")[1])
        if version not in kept and version < kept[0]:
            pieces = _glob(spark, f"{folder}/version={version}/rows/piece=*")
            unused = [p for p in pieces if (version, int(p.getName().split("=")[1])) not in used]
            for p in unused if len(unused) < len(pieces) else [path]:
                remove_folder(spark, p.toString())


def remove_folder(spark: SparkSession, folder: str) -> None:
    jvm, fs = _filesystem(spark, folder)
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def case_run_rows(runs: DataFrame) -> DataFrame:
    """The matched runs, in the columns of the case-run table."""
    return runs.where("status = 'matched'").select(
        *(runs[f.name].cast(f.dataType).alias(f.name) for f in CASE_RUNS.fields)
    )


def append_case_runs(runs: DataFrame, folder: str, batch: str) -> None:
    """Add the matched runs of one batch, cut by the date of the run and the batch.

    Storing a batch again replaces its rows of the same dates instead of adding them twice, and
    leaves all other batches and dates alone.
    """
    rows = case_run_rows(runs).withColumns({"run_date": F.to_date("created_at"), "batch": F.lit(batch)})
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date", "batch").parquet(folder)


def read_case_runs(spark: SparkSession, folder: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """All stored runs with their date and the batch that added them; `since` and `until` are the
    first and last date that is read, others are not opened."""
    parts = [T.StructField("run_date", T.DateType()), T.StructField("batch", T.StringType())]
    rows = spark.read.schema(T.StructType([*CASE_RUNS.fields, *parts])).parquet(folder)
    for limit, inside in ((since, "run_date >= date'{}'"), (until, "run_date <= date'{}'")):
        rows = rows.where(inside.format(limit)) if limit else rows
    return rows
