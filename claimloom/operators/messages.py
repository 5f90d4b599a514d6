"""Passenger messages: labels, domain filter, answers, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import contains_any, strip
from claimloom.functions.vocabulary import (
    CLASSIFIER_KEYWORDS,
    FIELD_TYPE_INDICATORS,
    FLIGHT_WORDS,
    GRIEVANCE_TYPES,
    TYPE_LABELS,
)
from claimloom.operators.joins import spread_join

UNSUPPORTED = "unsupported"


def label_in_reply(reply: Column) -> Column:
    """First grievance type contained in a classifier's reply, else NULL."""
    clean = F.lower(strip(reply))
    return F.coalesce(*(F.when(clean.contains(t), t) for t in GRIEVANCE_TYPES))


def exact_label(reply: Column) -> Column:
    """The reply as a grievance type, or 'unsupported' when it is not exactly one."""
    clean = F.lower(strip(F.coalesce(reply, F.lit(""))))
    return F.when(clean.isin(*GRIEVANCE_TYPES), clean).otherwise(UNSUPPORTED)


def classify_by_keywords(text: Column) -> Column:
    """Rule-based classifier: the type of the first keyword group found, else NULL."""
    low = F.lower(text)
    return F.coalesce(*(F.when(contains_any(low, k), t) for t, k in CLASSIFIER_KEYWORDS))


def classify_with(
    messages: DataFrame, model: Callable[[pd.Series], pd.Series], text: str = "text"
) -> DataFrame:
    """Add `reply`, produced by a model over batches of texts."""
    schema = T.StructType(messages.schema.fields + [T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=model(batch[text]))

    return messages.mapInPandas(run, schema)


#: What a classification says: its label, the words that support it, and how sure it is.
CLASSIFICATION = "struct<label: string, reason_span: string, confidence: double>"


def checked_classification(text: Column, label: Column, reason_span: Column, confidence: Column) -> Column:
    """A classifier's answer as (label, reason_span, confidence): the label is a grievance type or
    'unsupported', a span counts only if the text holds it, a confidence only from 0 to 1."""
    held = (strip(reason_span) != "") & F.contains(text, reason_span)
    sure = confidence.try_cast("double")
    return F.struct(
        exact_label(label).alias("label"),
        F.when(held, reason_span).alias("reason_span"),
        F.when(sure.between(0.0, 1.0), sure).alias("confidence"),
    )


def explain_by_keywords(text: Column) -> Column:
    """The keyword classifier with the words it went by; a rule is not more or less sure."""
    low = F.lower(text)
    found = [
        F.when(low.contains(word), F.struct(F.lit(kind).alias("kind"), F.lit(word).alias("word")))
        for kind, group in CLASSIFIER_KEYWORDS
        for word in group
    ]
    hit = F.coalesce(*found)
    span = F.substr(text, F.position(hit["word"], low), F.length(hit["word"]))
    return F.struct(
        F.coalesce(hit["kind"], F.lit(UNSUPPORTED)).alias("label"),
        F.when(F.lower(span) == hit["word"], span).alias("reason_span"),
        F.lit(None).cast("double").alias("confidence"),
    )


def classify_in_full(
    messages: DataFrame, model: Callable[[pd.Series], pd.DataFrame], text: str = "text"
) -> DataFrame:
    """Add `classification`, from a model over batches of texts that gives primary_label,
    reason_span and confidence; see checked_classification."""
    answer = ("primary_label", "reason_span", "confidence")
    schema = T.StructType(messages.schema.fields + [T.StructField(f"__{c}", T.StringType()) for c in answer])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model(batch[text].fillna("").reset_index(drop=True))
            yield batch.reset_index(drop=True).assign(**{f"__{c}": found[c].astype("string") for c in answer})

    answered = messages.mapInPandas(run, schema)
    checked = checked_classification(F.col(text), *(F.col(f"__{c}") for c in answer))
    return answered.withColumn("classification", checked).drop(*(f"__{c}" for c in answer))


def is_flight_related(text: Column) -> Column:
    return F.coalesce(contains_any(F.lower(text), FLIGHT_WORDS), F.lit(False))


def field_type(name: Column, description: Column) -> Column:
    """boolean, number, datetime or text, by indicators in name and description."""
    name = F.lower(name)
    description = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(
        *(
            F.when(contains_any(name, in_name) | contains_any(description, in_text), kind)
            for kind, in_name, in_text in FIELD_TYPE_INDICATORS
        ),
        F.lit("text"),
    )


def type_label(grievance_type: Column) -> Column:
    return F.coalesce(*(F.when(grievance_type == t, label) for t, label in TYPE_LABELS.items()))


def answers(text: Column) -> Column:
    """struct(from_json, pairs): the answers in a message, as array of (name, value).

    A message that is a JSON object gives its entries; any other JSON value gives none;
    other text is read as lines 'name: value', split at the first colon.
    """
    # inside brackets, text after the JSON value makes the whole malformed
    bracketed = F.concat(F.lit("["), text, F.lit("]"))
    strict = {"allowSingleQuotes": "false"}
    objects = F.from_json(bracketed, "ARRAY<MAP<STRING, STRING>>", strict)
    as_object = F.when(F.size(objects) == 1, objects[0])
    is_other_json = F.size(F.from_json(bracketed, "ARRAY<STRING>", strict)) == 1
    entries = F.transform(
        F.map_entries(as_object),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")),
    )
    lines = F.transform(
        F.filter(F.split(text, "\n"), lambda l: l.contains(":")),
        lambda l: F.struct(
            strip(F.substring_index(l, ":", 1)).alias("name"),
            strip(F.substr(l, F.locate(":", l) + 1)).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<name:string,value:string>>")
    pairs = F.when(as_object.isNotNull(), entries).when(is_other_json, none).otherwise(lines)
    return F.struct(as_object.isNotNull().alias("from_json"), pairs.alias("pairs"))


def answer_pairs(messages: DataFrame) -> DataFrame:
    """One row per answer in a message: from_json, pos, name, value."""
    kept = messages.columns
    return (
        messages.withColumn("a", answers(F.col("text")))
        .select(*kept, "a.from_json", F.posexplode("a.pairs").alias("pos", "pair"))
        .select(*kept, "from_json", "pos", "pair.name", "pair.value")
    )


def _name_forms(required: DataFrame, *columns: str) -> DataFrame:
    """Required fields under the two ways an answer may name them: exactly, or with
    blanks for underscores in any case."""
    exact = required.select(
        *columns, "field_name", "field_order", F.lit("exact").alias("form"),
        F.col("field_name").alias("answer_key"),
    )
    spaced = required.select(
        *columns, "field_name", "field_order", F.lit("spaced").alias("form"),
        F.lower(F.replace("field_name", F.lit("_"), F.lit(" "))).alias("answer_key"),
    )
    return exact.union(spaced)


def _answer_forms(pairs: DataFrame) -> DataFrame:
    forms = F.array(
        F.struct(F.lit("exact").alias("form"), F.col("name").alias("answer_key")),
        F.struct(F.lit("spaced").alias("form"), F.lower("name").alias("answer_key")),
    )
    # entries of a JSON object must carry the field's exact name
    usable = F.when(F.col("from_json"), F.slice(forms, 1, 1)).otherwise(forms)
    return pairs.select(*pairs.columns, F.inline(usable))


def match_answers(
    messages: DataFrame, required: DataFrame, by_type: bool = True
) -> DataFrame:
    """(conv_id, turn, grievance_type, field_name, value) of answered fields.

    Two equalities joined as one key avoid an OR between columns. An answer goes to
    the first field it names; of several answers to a field the last one counts.
    """
    keys = ["grievance_type"] if by_type else []
    given, named = _answer_forms(answer_pairs(messages)), _name_forms(required, "grievance_type")
    per_answer = (
        spread_join(given, named, keys + ["form", "answer_key"], "conv_id")
        .groupBy("conv_id", "turn", "grievance_type", "pos")
        .agg(
            F.min_by(F.struct("field_name", "value"), "field_order").alias("hit")
        )
    )
    return (
        per_answer.groupBy("conv_id", "turn", "grievance_type", F.col("hit.field_name").alias("field_name"))
        .agg(F.max_by("hit.value", "pos").alias("value"))
    )


def clean_history(messages: DataFrame) -> DataFrame:
    """Default role and text, and only what user and assistant said."""
    role = F.coalesce("role", F.lit("user"))
    return messages.where(role.isin("user", "assistant")).withColumns(
        {"role": role, "text": F.coalesce("text", F.lit(""))}
    )


def _pieces(segment: int | None) -> list[Column]:
    """A conversation is one piece; on request it is cut every `segment` turns."""
    return [F.floor(F.col("turn") / segment).alias("segment")] if segment else []


def transcripts(messages: DataFrame, segment: int | None = None) -> DataFrame:
    """(conv_id, transcript): whole conversations in order.

    With `segment`, pieces of at most that many turns and their number: (conv_id, segment,
    transcript).
    """
    entry = F.struct("turn", "role", "text")
    said = clean_history(messages).groupBy("conv_id", *_pieces(segment))
    lines = F.transform("said", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return said.agg(F.sort_array(F.collect_list(entry)).alias("said")).select(
        "conv_id", *(["segment"] if segment else []), F.array_join(lines, "\n").alias("transcript")
    )


def conversation_requests(
    messages: DataFrame, examples: list[tuple[str, str]], segment: int | None = None
) -> DataFrame:
    """(conv_id, request): the JSON message list for a chat model, the example exchanges
    first. With `segment`, a request per piece; examples lead a conversation's first one."""
    shown = [
        F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
        for pair in examples
        for role, text in zip(("user", "assistant"), pair)
    ]
    empty = F.array().cast("array<struct<role:string,content:string>>")
    prefix = F.array(*shown) if shown else empty
    entry = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("message"))
    pieces = (
        clean_history(messages)
        .groupBy("conv_id", *_pieces(segment))
        .agg(F.sort_array(F.collect_list(entry)).alias("said"))
    )
    if segment:
        first = F.min("segment").over(Window.partitionBy("conv_id"))
        pieces = pieces.withColumn("first", first)
        prefix = F.when(F.col("segment") == F.col("first"), prefix).otherwise(empty)
    return pieces.select(
        "conv_id",
        *(["segment"] if segment else []),
        F.to_json(F.concat(prefix, F.transform("said", lambda m: m["message"]))).alias("request"),
    )
