"""Regulation documents to gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimloom.operators import envelope, gold


def gold_tables(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(required fields, rules) from extraction results (path, extracted)."""
    decoded = envelope.decode_envelopes(envelopes)
    return (
        gold.required_fields(envelope.required_fact_rows(decoded)),
        gold.rules(envelope.rule_rows(decoded)),
    )
