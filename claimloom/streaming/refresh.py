"""Periodic refresh of the flight table from arriving status snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import flights as op
from claimloom.sources.tables import read_table, retire_versions, update_table, versions, write_keyed


def _newest(snapshots: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("seq", "observed_at", "response_json"), F.struct("observed_at", "seq"))
    return snapshots.groupBy("flight_number").agg(newest.alias("s")).select("flight_number", "s.*")


def collect_status(snapshots: DataFrame, status_folder: str, checkpoint: str) -> None:
    """Take in all waiting snapshots, batch by batch, and keep the newest of every flight.

    A batch is merged into the newest version of the status table, which gives the next one:
    its flights are changed or added, in the pieces of the table that hold them, and the other
    pieces stay as they are. Merging a batch again changes nothing, and a snapshot that arrives
    late does not replace a newer one.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = _newest(batch.select("flight_number", "seq", "observed_at", "response_json"))
        known = versions(spark, status_folder)
        if not known:
            write_keyed(arrived, status_folder, "flight_number")
            return
        arrived = arrived.persist()  # read for the touched pieces and for the rows
        try:
            update_table(
                spark, status_folder, known[-1], arrived, "flight_number", lambda old: _newest(old.unionByName(arrived))
            )
        finally:
            arrived.unpersist()
        retire_versions(spark, status_folder, keep=2)

    (
        snapshots.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def refresh_run(
    snapshots: DataFrame,
    flights_folder: str,
    status_folder: str,
    log_folder: str,
    run: int,
    as_of: str,
    checkpoint: str,
) -> None:
    """One run of the refresh: take in what has arrived, then update the due flights once.

    Run n reads version n of the flight table and writes version n + 1. The due rows are
    those at `as_of`, the run's one clock, so the result does not depend on how the
    snapshots fell into batches, and running it again gives the same tables. Only the
    partitions of flights that changed are written; the others are taken over as they are.
    """
    spark = snapshots.sparkSession
    clock = F.lit(as_of).cast("timestamp_ntz")
    collect_status(snapshots, status_folder, checkpoint)
    flights = read_table(spark, flights_folder, run)
    status = read_table(spark, status_folder)
    outcomes = op.due_outcomes(flights, status, clock)
    op.refresh_log(flights, outcomes, clock).write.mode("overwrite").parquet(f"{log_folder}/run={run}")
    changed = outcomes.where("outcome = 'success'").select("flight_number")
    update_table(
        spark, flights_folder, run, changed, "flight_number", lambda part: op.apply_status(part, outcomes, clock)
    )
    retire_versions(spark, flights_folder, keep=2)
