"""From first messages to matched cases, for any number of cases in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import facts as facts_op
from claimloom.operators import retrieval, rules as rules_op
from claimloom.operators.letters import letter_available
from claimloom.operators.messages import UNSUPPORTED, explain_by_keywords
from claimloom.session import materialise

EMPTY_MAP = "MAP<STRING, STRING>"


def label_cases(
    intake: DataFrame, explain: Callable[[Column], Column] = explain_by_keywords
) -> DataFrame:
    """Add grievance_type, reason_span and confidence; a message without a supported type becomes
    'unsupported'. Intake that has a classification (messages.classify_in_full) keeps it."""
    found = intake if "classification" in intake.columns else intake.withColumn("classification", explain(F.col("user_text")))
    return found.withColumns(
        {
            "grievance_type": F.coalesce("classification.label", F.lit(UNSUPPORTED)),
            "reason_span": F.col("classification.reason_span"),
            "confidence": F.col("classification.confidence"),
        }
    ).drop("classification")


def match_results(outcomes: DataFrame, cases: DataFrame, required: DataFrame) -> DataFrame:
    """(case_id, match_json): the rule ids by outcome, and the facts still needed."""
    def ids(kind):
        return F.sort_array(F.collect_list(F.when(F.col("match_kind") == kind, F.col("rule_id"))))

    by_outcome = outcomes.groupBy("case_id").agg(
        ids("exact").alias("applicable_rule_ids"),
        ids("maybe").alias("maybe_rule_ids"),
        ids("non_applicable").alias("non_applicable_rule_ids"),
    )
    needed = (
        rules_op.missing_facts_for_maybe(outcomes, cases, required)
        .groupBy("case_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("fact_key", "why_needed"))).alias("missing_facts")
        )
    )
    summary = F.concat(
        F.size("applicable_rule_ids").cast("string"), F.lit(" rule(s) apply, "),
        F.size("maybe_rule_ids").cast("string"), F.lit(" may apply."),
    )
    none = F.array().cast("array<struct<fact_key:string,why_needed:string>>")
    result = F.struct(
        "applicable_rule_ids", "maybe_rule_ids", "non_applicable_rule_ids",
        F.coalesce("missing_facts", none).alias("missing_facts"),
        summary.alias("passenger_summary"),
    )
    return by_outcome.join(needed, "case_id", "left").select(
        "case_id", F.to_json(result, {"ignoreNullFields": "false"}).alias("match_json")
    )


def run_cases(
    intake: DataFrame,
    facts: DataFrame,
    required: DataFrame,
    rules: DataFrame,
    conditions: DataFrame,
    as_of: Column,
    top_k: int | None = retrieval.TOP_K,
    explain: Callable[[Column], Column] = explain_by_keywords,
    folder: str | None = None,
) -> DataFrame:
    """Every intake row with its status and, when matched, its case-run columns.

    intake: (case_id, session_id, user_text), and classification if it has been classified. status is 'unsupported',
    'need_more_info' (a critical field is missing) or 'matched'. missing_fields and
    missing_critical_fields list the open fields in their order. With a `folder`, known
    facts and outcomes are written there once; nothing else is written.
    """
    labelled = label_cases(intake, explain)
    cases = labelled.where(F.col("grievance_type") != UNSUPPORTED).select(
        "case_id", "grievance_type"
    )
    known = materialise(facts_op.known_facts(cases, facts, required), "known", folder)
    missing = facts_op.missing_fields(cases, known, required)
    status = facts_op.case_status(cases, missing)

    ready = status.where("status = 'matched'").select("case_id", "grievance_type")
    known_of_ready = known.join(ready.select("case_id"), "case_id", "left_semi")
    candidates = retrieval.candidate_rules(ready, known_of_ready, rules, top_k)
    outcomes = materialise(
        rules_op.candidate_outcomes(candidates, known_of_ready, conditions), "outcomes", folder
    )
    matches = match_results(outcomes, ready, required)

    keep_nulls = {"ignoreNullFields": "false"}
    no_fields = F.array().cast("array<string>")
    known_map = F.coalesce("facts", F.from_json(F.lit("{}"), EMPTY_MAP))
    return (
        labelled.join(
            status.drop("grievance_type"), "case_id", "left"
        )
        .join(retrieval.facts_as_map(known), "case_id", "left")
        .join(matches, "case_id", "left")
        .select(
            "case_id",
            F.coalesce("session_id", F.concat(F.lit("case-"), F.col("case_id").cast("string"))).alias(
                "session_id"
            ),
            F.coalesce("user_text", F.lit("")).alias("user_text"),
            "grievance_type",
            "reason_span",
            "confidence",
            F.coalesce("status", F.lit(UNSUPPORTED)).alias("status"),
            letter_available(F.col("grievance_type")).alias("letter_available"),
            F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
            F.coalesce("n_missing_critical", F.lit(0)).alias("n_missing_critical"),
            F.coalesce("missing_fields", no_fields).alias("missing_fields"),
            F.coalesce("missing_critical_fields", no_fields).alias("missing_critical_fields"),
            F.to_json(known_map, keep_nulls).alias("facts_json"),
            F.to_json(
                F.struct("grievance_type", known_map.alias("known_facts")), keep_nulls
            ).alias("intake_json"),
            "match_json",
            as_of.alias("created_at"),
        )
    )
