"""Gold tables: required fields per grievance type, and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.vocabulary import (
    ANY_SCENARIO,
    DEFAULT_FAMILY,
    RULE_FAMILIES,
    SCENARIO_TYPES,
)

RULE_COLUMNS = (
    "rule_id", "title", "source_para", "scenario_type", "rule_family",
    "applies_when_text", "does_not_apply_when_text", "passenger_gets_text",
    "references_json", "keywords_json",
)


def _key(name: str) -> Column:
    return F.lower(F.trim(name))


def _longest_first(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit(""))).desc()


def _keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Best row per key.

    `rn = 1` right above the window lets Spark reduce every map task to one row
    per key before the shuffle, so a key holding most of the rows stays cheap.
    """
    ranked = df.withColumn(
        "rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where("rn = 1").drop("rn")


def required_fields(raw: DataFrame) -> DataFrame:
    """Normalise, deduplicate and number the required fields of each type.

    The reference's ordering leaves ties; the texts themselves break them here.
    """
    rows = raw.where(
        F.col("grievance_type").isNotNull() & (F.trim("fact_key") != "")
    ).select(
        _key("grievance_type").alias("grievance_type"),
        _key("fact_key").alias("field_name"),
        F.trim("description").alias("field_description"),
        F.when(_key("importance") == "critical", "critical")
        .otherwise("supporting")
        .alias("importance"),
        F.trim("why_needed").alias("why_needed"),
    )
    best = _keep_first(
        rows,
        ["grievance_type", "field_name"],
        [
            F.col("importance").asc(),
            _longest_first("why_needed"),
            _longest_first("field_description"),
            F.col("why_needed").asc_nulls_first(),
            F.col("field_description").asc_nulls_first(),
        ],
    )
    in_type = Window.partitionBy("grievance_type").orderBy("importance", "field_name")
    return best.select(
        "grievance_type",
        "field_name",
        F.row_number().over(in_type).alias("field_order"),
        "field_description",
        "importance",
        (F.col("importance") == "critical").alias("is_required"),
        "why_needed",
    )


def _one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def rules(raw: DataFrame) -> DataFrame:
    """Normalise and deduplicate rules, and add the text they are found by."""
    rows = raw.where(F.trim("rule_id") != "").select(
        _key("rule_id").alias("rule_id"),
        F.trim("title").alias("title"),
        F.trim("source_para").alias("source_para"),
        _one_of(_key("scenario_type"), SCENARIO_TYPES, ANY_SCENARIO).alias("scenario_type"),
        _one_of(_key("rule_family"), RULE_FAMILIES, DEFAULT_FAMILY).alias("rule_family"),
        F.trim("applies_when_text").alias("applies_when_text"),
        F.trim("does_not_apply_when_text").alias("does_not_apply_when_text"),
        F.trim("passenger_gets_text").alias("passenger_gets_text"),
        "references_json",
        "keywords_json",
    )
    no_para = F.coalesce(F.col("source_para"), F.lit("")) == ""
    best = _keep_first(
        rows,
        ["rule_id"],
        [no_para.asc(), _longest_first("applies_when_text"), _longest_first("passenger_gets_text")]
        + [F.col(c).asc_nulls_first() for c in RULE_COLUMNS[1:]],
    )
    searched = (
        "title", "source_para", "applies_when_text", "does_not_apply_when_text",
        "passenger_gets_text", "references_json", "keywords_json",
    )
    return best.select(
        *RULE_COLUMNS,
        F.concat_ws(" | ", *(F.coalesce(F.col(c), F.lit("")) for c in searched)).alias(
            "retrieval_text"
        ),
    )


def rule_counts(rules: DataFrame) -> DataFrame:
    return (
        rules.groupBy("scenario_type", "rule_family")
        .agg(F.count("*").alias("cnt"))
        .orderBy("scenario_type", "rule_family")
    )


def required_fields_preview(required: DataFrame) -> DataFrame:
    return required.orderBy("grievance_type", "field_order")


def rules_preview(rules: DataFrame) -> DataFrame:
    return rules.select(
        "source_para", "scenario_type", "rule_family", "rule_id", "title",
        "applies_when_text", "does_not_apply_when_text", "passenger_gets_text",
    ).orderBy(F.col("source_para").asc_nulls_first(), "rule_id")
