"""Known and missing facts of passenger cases.

Inputs: cases(case_id, grievance_type), facts(case_id, pos, origin, fact_key, value)
with origin 'message' (extracted) or 'extra' (given by the caller), and the
required-fields table. Facts may bring evidence_span and confidence, which stay with
their value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import is_blank, strip
from claimloom.operators.joins import spread_join
from claimloom.operators.messages import answer_pairs


EVIDENCE = ("evidence_span", "confidence")


def _with_evidence(facts: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in EVIDENCE if c not in facts.columns}
    return facts.withColumns(missing) if missing else facts


def required_fields_of_cases(cases: DataFrame, required: DataFrame) -> DataFrame:
    return spread_join(cases, required, ["grievance_type"], "case_id")


def _clean_message_facts(facts: DataFrame) -> DataFrame:
    return _with_evidence(facts).where(
        (F.col("origin") == "message") & ~is_blank(F.col("value"))
    ).select(
        "case_id",
        "pos",
        F.lower(strip(F.coalesce("fact_key", F.lit("")))).alias("fact_key"),
        strip(F.col("value")).alias("value"),
        *EVIDENCE,
    )


def facts_in_text(intake: DataFrame) -> DataFrame:
    """Default extractor: what a message states as 'name: value' lines or as JSON."""
    texts = intake.select("case_id", F.col("user_text").alias("text"))
    return answer_pairs(texts).select(
        "case_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.lit("message").alias("origin"),
        F.col("name").alias("fact_key"),
        "value",
    )


def allowed_facts(cases: DataFrame, facts: DataFrame, required: DataFrame) -> DataFrame:
    """Extracted facts that are non-blank and asked for by the case's type."""
    allowed = required.select("grievance_type", F.col("field_name").alias("fact_key"))
    return spread_join(
        _clean_message_facts(facts).join(cases, "case_id"), allowed.distinct(), ["grievance_type", "fact_key"], "case_id"
    ).select("grievance_type", "fact_key", "case_id", "pos", "value", *EVIDENCE)


def known_facts(cases: DataFrame, facts: DataFrame, required: DataFrame) -> DataFrame:
    """(case_id, grievance_type, fact_key, value, origin, evidence_span, confidence): one
    row per known key.

    The last extracted value wins, and an extra fact replaces an extracted one, even
    with a blank value. Extra facts are neither normalised nor checked. Whether a key
    is allowed depends on the case and the key only, so rows are first reduced to one
    per (case, key), which Spark does before the shuffle, and then checked.
    """
    message = _clean_message_facts(facts).withColumn("from_extra", F.lit(0))
    extra = _with_evidence(facts).where("origin = 'extra' AND fact_key IS NOT NULL").select(
        "case_id", "pos", "fact_key", "value", *EVIDENCE, F.lit(1).alias("from_extra")
    )
    latest = (
        message.unionByName(extra)
        .groupBy("case_id", "fact_key")
        .agg(
            F.max_by(F.struct("value", *EVIDENCE), F.struct("from_extra", "pos")).alias("last"),
            F.max("from_extra").alias("from_extra"),
        )
        .select("case_id", "fact_key", "last.*", "from_extra")
    )
    allowed = required.select(
        "grievance_type", F.col("field_name").alias("fact_key"), F.lit(True).alias("allowed")
    )
    return (
        spread_join(latest.join(cases, "case_id"), allowed, ["grievance_type", "fact_key"], "case_id", "left")
        .where("from_extra = 1 OR allowed")
        .select(
            "case_id",
            "grievance_type",
            "fact_key",
            "value",
            F.when(F.col("from_extra") == 1, "extra").otherwise("message").alias("origin"),
            *EVIDENCE,
        )
    )


def missing_fields(
    cases: DataFrame, known: DataFrame, required: DataFrame, only_critical: bool = False
) -> DataFrame:
    """Required fields without a non-blank value, one row per case and field.

    Each case carries the set of its filled field names (at most the number of
    fields that exist), so the product of cases and fields is never shuffled.
    """
    if only_critical:
        required = required.where("is_required")
    names = required.select(F.col("field_name").alias("fact_key")).distinct()
    filled = (
        spread_join(known.where(~is_blank(F.col("value"))), names, ["fact_key"], "case_id", "left_semi")
        .groupBy("case_id")
        .agg(F.collect_set("fact_key").alias("filled"))
    )
    return (
        spread_join(cases.join(filled, "case_id", "left"), required, ["grievance_type"], "case_id")
        .where(~F.coalesce(F.array_contains("filled", F.col("field_name")), F.lit(False)))
        .drop("filled")
    )


def unanswered_fields(
    answers: DataFrame, cases: DataFrame, required: DataFrame, strict: bool
) -> DataFrame:
    """Fields a submitted form leaves open.

    strict: a blank answer counts as open (the form page); otherwise only the
    presence of the key counts (the server).
    """
    if not strict:
        answers = answers.withColumn("value", F.lit("present"))
    return missing_fields(cases, answers, required)


def case_status(cases: DataFrame, missing: DataFrame) -> DataFrame:
    """need_more_info while a critical field is missing, else matched; with the number and
    the ordered names of missing fields."""
    place = F.struct("field_order", "field_name")

    def names(entries):
        return F.transform(F.sort_array(F.collect_list(entries)), lambda e: e["field_name"])

    counts = missing.groupBy("case_id").agg(
        F.count("*").alias("n_missing"),
        F.count_if("is_required").alias("n_missing_critical"),
        names(place).alias("missing_fields"),
        names(F.when(F.col("is_required"), place)).alias("missing_critical_fields"),
    )
    joined = cases.join(counts, "case_id", "left").fillna(
        0, ["n_missing", "n_missing_critical"]
    )
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "missing_fields": F.coalesce("missing_fields", none),
            "missing_critical_fields": F.coalesce("missing_critical_fields", none),
            "status": F.when(F.col("n_missing_critical") > 0, "need_more_info").otherwise("matched"),
        }
    )
