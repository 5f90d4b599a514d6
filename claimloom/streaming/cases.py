"""Case runs for first messages as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators.facts import facts_in_text
from claimloom.plans.cases import run_cases
from claimloom.session import materialise
from claimloom.sources.tables import append_case_runs, remove_folder


def start_case_runs(
    intake: DataFrame,
    required: DataFrame,
    rules: DataFrame,
    conditions: DataFrame,
    runs_folder: str,
    results_folder: str,
    clock: Callable[[int], str],
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame] = facts_in_text,
    folder: str | None = None,
) -> StreamingQuery:
    """Run the cases of each batch of intake rows.

    The matched ones are stored in the case-run table; what every passenger is to be told,
    also where facts are missing or the type is not supported, goes to results_folder. A
    batch has its own folder in both, so running it again replaces its rows. Intermediate
    results go below `folder`, if one is given, and are removed when the batch is done.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        scratch = f"{folder}/case-batch-{batch_id}" if folder else None
        facts = materialise(extract(batch), "facts", scratch)
        as_of = F.lit(clock(batch_id)).cast("timestamp_ntz")
        runs = run_cases(batch, facts, required, rules, conditions, as_of, folder=scratch)
        path = f"{results_folder}/batch={batch_id}"
        runs.write.mode("overwrite").parquet(path)
        append_case_runs(batch.sparkSession.read.parquet(path), runs_folder, str(batch_id))
        if scratch:
            remove_folder(batch.sparkSession, scratch)

    return (
        intake.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
