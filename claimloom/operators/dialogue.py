"""Dialogue state over message logs.

A conversation is in one of six states: initial, waiting for the answers of one of the
four grievance types, or completed. What a message does depends only on the state it
meets, so each message is a small table (state -> next state, resets so far), and such
tables can be chained in any grouping. Long conversations are therefore cut into pieces
that are reduced independently; only one table per piece is put in order afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import strip
from claimloom.functions.vocabulary import GRIEVANCE_TYPES
from claimloom.operators.messages import classify_by_keywords, clean_history, match_answers
from claimloom.session import materialise

INITIAL = 0
COMPLETED = len(GRIEVANCE_TYPES) + 1
STATES = range(COMPLETED + 1)
#: Turns that are chained in one list.
FAN = 64


def state_name(code: Column) -> Column:
    return (
        F.when(code == INITIAL, "initial")
        .when(code == COMPLETED, "completed")
        .otherwise("awaiting_fields")
    )


def state_type(code: Column) -> Column:
    """The grievance type of a waiting state."""
    return F.coalesce(*(F.when(code == i + 1, t) for i, t in enumerate(GRIEVANCE_TYPES)))


def moves(label: Column, answered: Column) -> Column:
    """Next state per state for one user message.

    label: its grievance type or NULL; answered: types whose fields it answers in full.
    A message that meets a completed dialogue only clears it.
    """
    started = F.coalesce(
        *(F.when(label == t, i + 1) for i, t in enumerate(GRIEVANCE_TYPES)), F.lit(INITIAL)
    )
    waiting = [
        F.when(F.array_contains(answered, t), COMPLETED).otherwise(i + 1)
        for i, t in enumerate(GRIEVANCE_TYPES)
    ]
    return F.array(started, *waiting, F.lit(INITIAL))


def fully_answered(messages: DataFrame, required: DataFrame) -> DataFrame:
    """(conv_id, turn, answered): types all of whose fields a message names. Only the
    presence of a name counts, not its value."""
    matched = match_answers(messages, required, by_type=False)
    wanted = required.groupBy("grievance_type").agg(F.count("*").alias("n_fields"))
    return (
        matched.groupBy("conv_id", "turn", "grievance_type")
        .agg(F.count("*").alias("n"))
        .join(wanted, "grievance_type")
        .where("n = n_fields")
        .groupBy("conv_id", "turn")
        .agg(F.collect_set("grievance_type").alias("answered"))
    )


def is_user_message() -> Column:
    """Whether a message reaches the dialogue: from the user and not blank."""
    return (F.coalesce("role", F.lit("user")) == "user") & (strip(F.col("text")) != "")


def user_messages(messages: DataFrame) -> DataFrame:
    return messages.where(is_user_message())


def message_moves(
    messages: DataFrame,
    required: DataFrame,
    classify: Callable[[Column], Column] = classify_by_keywords,
) -> DataFrame:
    """(conv_id, turn, moves) of user messages."""
    users = user_messages(messages)
    # a type without any field is answered by every message
    known_types = required.where(F.col("grievance_type").isin(*GRIEVANCE_TYPES))
    asked = known_types.agg(F.collect_set("grievance_type")).scalar()
    free = F.array_except(F.array(*(F.lit(t) for t in GRIEVANCE_TYPES)), asked)
    answered = F.coalesce("answered", F.array().cast("array<string>"))
    return (
        users.join(fully_answered(users, required), ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            moves(classify(F.col("text")), F.concat(answered, free)).alias("moves"),
        )
    )


def _identity() -> Column:
    return F.array(*(F.lit(s) for s in STATES))


def _after(table: Column, state: Column) -> Column:
    return F.element_at(table, state + 1)


def _depth(pieces: DataFrame, fan: int) -> int:
    """Levels of lists of `fan` places that take the largest place of the table: one aggregate."""
    largest = pieces.agg(F.max(F.abs("place"))).first()[0] or 0
    depth = 0
    while largest >= fan:
        largest, depth = largest // fan, depth + 1
    return depth


def _starts(pieces: DataFrame, levels: int, fan: int) -> DataFrame:
    """(conv_id, place, moves) -> (conv_id, place, start): the state each piece meets."""
    if levels == 0:
        grouped = pieces.groupBy("conv_id").agg(
            F.sort_array(F.collect_list(F.struct("place", "moves"))).alias("parts")
        ).withColumn("start", F.lit(INITIAL))
    else:
        grouped = _join_starts(_group(pieces, fan), levels - 1, fan)
    return _spread(grouped)


def _group(pieces: DataFrame, fan: int) -> DataFrame:
    """Chain up to `fan` neighbours into one table, keeping the list."""
    chained = F.aggregate(
        "parts",
        _identity(),
        lambda table, p: F.transform(table, lambda s: _after(p["moves"], s)),
    )
    return (
        pieces.groupBy("conv_id", F.floor(F.col("place") / fan).alias("group"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "moves"))).alias("parts"))
        .withColumn("moves", chained)
    )


def _join_starts(grouped: DataFrame, levels: int, fan: int) -> DataFrame:
    whole = grouped.select("conv_id", F.col("group").alias("place"), "moves")
    starts = _starts(whole, levels, fan).withColumnRenamed("place", "group")
    return grouped.drop("moves").join(starts, ["conv_id", "group"])


def _spread(grouped: DataFrame) -> DataFrame:
    """Walk each list from its start and give every entry the state it meets.

    The array of states is copied at each step, which a list of at most `fan` entries bounds.
    """
    walk = F.aggregate(
        "parts",
        F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("met")),
        lambda acc, p: F.struct(
            _after(p["moves"], acc["state"]).alias("state"),
            F.concat(acc["met"], F.array(acc["state"])).alias("met"),
        ),
    )
    return grouped.withColumn("met", walk["met"]).select(
        "conv_id",
        F.inline(
            F.zip_with(
                "parts", "met", lambda p, s: F.struct(p["place"].alias("place"), s.alias("start"))
            )
        ),
    )


def dialogue_states(
    messages: DataFrame,
    required: DataFrame,
    classify: Callable[[Column], Column] = classify_by_keywords,
    fan: int = FAN,
    folder: str | None = None,
) -> DataFrame:
    """(conv_id, turn, state_before, state_after, grievance_type) per user message.

    grievance_type is the one being handled after the message; a completed dialogue
    keeps it until the next message clears it. Turns are whole numbers. Lists hold at most
    `fan` turns whatever the length of a conversation: the largest turn of the table gives the
    number of levels in which pieces are chained.
    """
    steps = materialise(message_moves(messages, required, classify), "moves", folder)
    pieces = steps.select("conv_id", F.col("turn").alias("place"), "moves")
    met = _starts(pieces, _depth(messages.select(F.col("turn").alias("place")), fan), fan)
    before = F.col("start")
    after = _after(F.col("moves"), before)
    return (
        steps.join(met.withColumnRenamed("place", "turn"), ["conv_id", "turn"])
        .select(
            "conv_id",
            "turn",
            state_name(before).alias("state_before"),
            state_name(after).alias("state_after"),
            F.when(after == COMPLETED, state_type(before))
            .otherwise(state_type(after))
            .alias("grievance_type"),
        )
    )


def handled_answers(
    messages: DataFrame, states: DataFrame, required: DataFrame
) -> DataFrame:
    """Answers given while a dialogue waited for them, by field."""
    waiting = states.where("state_before = 'awaiting_fields'").select(
        "conv_id", "turn", "grievance_type"
    )
    return match_answers(
        user_messages(messages).join(waiting, ["conv_id", "turn"]), required
    )


def conversation_states(
    messages: DataFrame, states: DataFrame, folder: str | None = None
) -> DataFrame:
    """(conv_id, state, grievance_type, n_messages): where each conversation stands, and
    how many messages its history holds since it was last cleared.

    The message that clears a dialogue is not kept.
    """
    latest = states.groupBy("conv_id").agg(
        F.max_by(F.struct("state_after", "grievance_type"), "turn").alias("last"),
        F.max(
            F.when(F.col("state_before") == "completed", F.col("turn"))
        ).alias("cleared_at"),
    )
    latest = materialise(latest, "latest_states", folder)
    kept = (
        history_since_clear(messages, latest)
        .groupBy("conv_id")
        .agg(F.count("*").alias("n_messages"))
    )
    everyone = clean_history(messages).select("conv_id").distinct()
    return (
        everyone.join(latest, "conv_id", "left")
        .join(kept, "conv_id", "left")
        .select(
            "conv_id",
            F.coalesce("last.state_after", F.lit("initial")).alias("state"),
            "last.grievance_type",
            F.coalesce("n_messages", F.lit(0)).cast("bigint").alias("n_messages"),
        )
    )


def history_since_clear(messages: DataFrame, latest: DataFrame) -> DataFrame:
    """Messages after the one that last cleared their conversation, in log form."""
    cleared = latest.select("conv_id", "cleared_at")
    return (
        clean_history(messages)
        .where((F.col("role") == "assistant") | (strip(F.col("text")) != ""))
        .join(cleared, "conv_id", "left")
        .where("cleared_at IS NULL OR turn > cleared_at")
        .drop("cleared_at")
    )
