"""One refresh of the flight-tracking table from status snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from claimloom.operators import flights as op


def refresh(
    flights: DataFrame, snapshots: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """(new flights, log). The set of due rows is fixed by the one `as_of`."""
    outcomes = op.due_outcomes(flights, snapshots, as_of)
    return (
        op.apply_status(flights, outcomes, as_of),
        op.refresh_log(flights, outcomes, as_of),
    )
