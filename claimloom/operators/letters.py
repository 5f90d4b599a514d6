"""Compensation forms, letters and escalation checklists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import numbered, strip
from claimloom.functions.vocabulary import LETTER_TYPES
from claimloom.operators.joins import spread_join

# Form columns, and the names of the letter's placeholders they fill.
FORM_COLUMNS = (
    "full_name", "email_address", "phone_number", "airline_name", "pnr",
    "flight_number", "origin", "destination", "scheduled_departure",
    "disruption_type", "intimation_time", "alternate_details", "expense_amount",
)
LETTER_COLUMNS = (
    "full_name", "email_address", "phone_number", "airline_name", "pnr",
    "flight_number", "origin", "destination", "scheduled_departure",
    "disruption_type", "intimation_time", "notice_window",
    "compensation_type_1", "compensation_type_2", "total_expenses",
)

# Relief asked for, by a word in the disruption, in this order.
RELIEF = (
    (
        "cancellation",
        "Full refund of ticket amount including convenience fees",
        "Alternative flight or compensation as per DGCA norms",
    ),
    (
        "denied",
        "Compensation for denied boarding as per DGCA regulations",
        "Alternate flight arrangement or full refund",
    ),
)
OTHER_RELIEF = (
    "Statutory compensation as applicable",
    "Appropriate relief measures as per DGCA Charter",
)


def letter_available(grievance_type: Column) -> Column:
    return F.coalesce(F.lower(grievance_type).isin(*LETTER_TYPES), F.lit(False))


def follow_ups(grievance_type: Column, options: list[str]) -> Column:
    """Numbered follow-up options where a letter is offered, else an empty text."""
    lines = numbered(F.array(*(F.lit(o) for o in options)))
    return F.when(letter_available(grievance_type), lines).otherwise("")


def parse_forms(forms: DataFrame) -> DataFrame:
    """Strip the answers, derive notice window, relief and expenses.

    total_expenses stays a text as entered; total_expenses_amount is its value where it
    is a number.
    """
    def given(name):
        return strip(F.coalesce(name, F.lit("")))

    disruption = F.lower(given("disruption_type"))

    def relief(n):
        chosen = F.coalesce(*(F.when(disruption.contains(r[0]), r[n]) for r in RELIEF))
        return F.coalesce(chosen, F.lit(OTHER_RELIEF[n - 1]))

    expense = strip(F.coalesce("expense_amount", F.lit("NA")))
    total = F.when(F.upper(expense).isin("NA", ""), "0").otherwise(
        strip(F.regexp_replace(expense, "[₹,]", ""))
    )
    others = [c for c in forms.columns if c not in FORM_COLUMNS]
    plain = FORM_COLUMNS[:11]
    return forms.select(
        *others,
        *(given(c).alias(c) for c in plain),
        given("intimation_time").alias("notice_window"),
        relief(1).alias("compensation_type_1"),
        relief(2).alias("compensation_type_2"),
        total.alias("total_expenses"),
        total.try_cast("decimal(18,2)").alias("total_expenses_amount"),
    )


def missing_letter_fields(df: DataFrame) -> Column:
    """Names of the letter's fields that are absent (NULL), in order."""
    names = F.array(*(F.when(F.col(c).isNull(), F.lit(c.upper())) for c in LETTER_COLUMNS if c in df.columns))
    absent = [c.upper() for c in LETTER_COLUMNS if c not in df.columns]
    return F.concat(F.array_compact(names), F.array(*(F.lit(a) for a in absent)).cast("array<string>"))


def render(template: str) -> Column:
    """A column that fills $NAME placeholders of a template from columns.

    The template is cut once, so a value that looks like a placeholder stays as it is.
    """
    pieces = re.split(r"\$([A-Z_][A-Z0-9_]*)", template)
    parts = [
        F.col(piece.lower()) if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)
    ]
    return F.concat(*parts)


NOT_APPLICABLE = "no letter is offered for this type"


def letters(
    filled: DataFrame, template: str, subject: str, grievance_type: Column | None = None
) -> DataFrame:
    """Add subject, letter and error. A row with missing fields has no letter, nor has one
    whose grievance type, where given, is not offered a letter."""
    checked = filled.withColumn("missing", missing_letter_fields(filled))
    offered = F.lit(True) if grievance_type is None else letter_available(grievance_type)
    complete = offered & (F.size("missing") == 0)

    def text(pattern):
        if set(LETTER_COLUMNS) - set(filled.columns):
            return F.lit(None).cast("string")
        return F.when(complete, render(pattern))

    return checked.select(
        *filled.columns,
        text(subject).alias("subject"),
        text(template).alias("letter"),
        F.when(~offered, NOT_APPLICABLE)
        .when(
            ~complete, F.concat(F.lit("Missing required fields: "), F.array_join("missing", ", "))
        )
        .alias("error"),
    )


def escalation_checklists(items: DataFrame) -> DataFrame:
    """items(grievance_type, kind, item_no, item_text) -> one rendered text per type."""
    def listed(kind):
        entry = F.when(F.col("kind") == kind, F.struct("item_no", "item_text"))
        return numbered(
            F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["item_text"])
        )

    return (
        items.groupBy("grievance_type")
        .agg(listed("document").alias("documents"), listed("step").alias("steps"))
        .select(
            "grievance_type",
            F.concat(
                F.lit("Required documents:\n"), "documents", F.lit("\nSteps:\n"), "steps"
            ).alias("checklist"),
        )
    )


def guidance(cases: DataFrame, checklists: DataFrame) -> DataFrame:
    """The checklist of each case's type; an unknown type has an empty one."""
    return spread_join(cases, checklists, ["grievance_type"], "case_id", "left").withColumn(
        "checklist", F.coalesce("checklist", F.lit(""))
    )
