"""Decoding of extraction results: one JSON envelope per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the typed form of a response.
RESPONSE_DDL = """STRUCT<
  document_id: STRING,
  required_facts_by_scenario: ARRAY<STRUCT<
    grievance_type: STRING,
    facts: ARRAY<STRUCT<
      fact_key: STRING, description: STRING, importance: STRING, why_needed: STRING>>>>,
  rules: ARRAY<STRUCT<
    rule_id: STRING, title: STRING, source_para: STRING, scenario_type: STRING,
    rule_family: STRING, applies_when_text: STRING, does_not_apply_when_text: STRING,
    passenger_gets_text: STRING,
    references: ARRAY<STRUCT<ref_text: STRING, purpose: STRING>>,
    candidate_keywords: ARRAY<STRING>>>
>"""


def decode_envelopes(envelopes: DataFrame) -> DataFrame:
    """(path, extracted) -> (path, error_message, resp); extracted is JSON text or a VARIANT.

    A malformed envelope gives a NULL response instead of failing the job.
    """
    stored = isinstance(envelopes.schema["extracted"].dataType, T.VariantType)
    opened = envelopes.withColumn("v", F.col("extracted") if stored else F.try_parse_json("extracted"))
    return opened.select(
        "path",
        F.try_variant_get("v", "$.error_message", "string").alias("error_message"),
        F.from_json(
            F.to_json(F.try_variant_get("v", "$.response", "variant")),
            " ".join(RESPONSE_DDL.split()),
        ).alias("resp"),
    )


def required_fact_rows(decoded: DataFrame) -> DataFrame:
    """One row per fact of each scenario; empty lists give no row."""
    scenarios = decoded.select(
        "path", F.explode("resp.required_facts_by_scenario").alias("s")
    )
    return scenarios.select(
        "path", F.col("s.grievance_type"), F.explode("s.facts").alias("f")
    ).select(
        "path", "grievance_type", "f.fact_key", "f.description", "f.importance",
        "f.why_needed",
    )


def rule_rows(decoded: DataFrame) -> DataFrame:
    """One row per extracted rule, nested columns encoded as JSON text."""
    return decoded.select("path", F.explode("resp.rules").alias("r")).select(
        "path",
        "r.rule_id", "r.title", "r.source_para", "r.scenario_type", "r.rule_family",
        "r.applies_when_text", "r.does_not_apply_when_text", "r.passenger_gets_text",
        F.to_json("r.references").alias("references_json"),
        F.to_json("r.candidate_keywords").alias("keywords_json"),
    )


def json_list_or_empty(text: Column, element: str = "STRING") -> Column:
    """Decode a JSON list; malformed or missing text gives an empty list."""
    ddl = f"ARRAY<{element}>"
    return F.coalesce(F.from_json(text, ddl), F.from_json(F.lit("[]"), ddl))


def json_object_or_empty(text: Column) -> Column:
    """Decode a JSON object to a map of texts; otherwise an empty map."""
    ddl = "MAP<STRING, STRING>"
    return F.coalesce(F.from_json(text, ddl), F.from_json(F.lit("{}"), ddl))
