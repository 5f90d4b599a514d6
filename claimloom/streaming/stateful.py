"""Dialogue state and entitlement changes over streams whose rows arrive in any order.

Both need the RocksDB state store (session.ROCKSDB_PROVIDER). A row that comes before its
turn waits in its key's state: a snapshot until the watermark has passed it, a message until
the turns before it are there. What has been worked off is a few numbers per key.

Dialogue state expires by the clock, for which Spark keeps running empty batches; a run of it
over what is available now ends only with spark.sql.streaming.noDataMicroBatches.enabled set
to false. Entitlement changes go by event time and end with the last watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimloom.functions.vocabulary import GRIEVANCE_TYPES
from claimloom.operators import dialogue, flights
from claimloom.operators.messages import answers, classify_by_keywords

#: State of a key that has been silent this long is dropped, and later rows are too late.
KEPT_MS = 30 * 24 * 3600 * 1000
#: How long a conversation waits for a turn that is missing.
PATIENCE_MS = 10 * 60 * 1000
CHUNK = 10_000
_EPOCH = datetime(1970, 1, 1)


class DialogueProcessor(StatefulProcessor):
    """Applies each message's move table to the conversation's state, turn by turn.

    Messages wait until all turns before them are there, or until a gap has lasted
    `patience_ms`; it is then passed over. A message of a turn that has been passed comes out
    with no states (before and after -1): it is late, or there twice. A conversation silent
    for `kept_ms` is forgotten.
    """

    def __init__(self, first_turn: int = 0, patience_ms: int = PATIENCE_MS, kept_ms: int = KEPT_MS):
        self.first_turn, self.patience_ms, self.kept_ms = first_turn, patience_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the type handled last is kept beside the state: a completed dialogue has it no more
        self.current = handle.getValueState("current", "state int, next bigint, handled int", ttlDurationMs=self.kept_ms)
        # moves of a waiting turn, a digit per state; empty: a turn that says nothing to the dialogue
        self.waiting = handle.getMapState("waiting", "turn bigint", "moves string", ttlDurationMs=self.kept_ms)

    def _walk(self, key, turns: np.ndarray, moves: np.ndarray, skip_gap: bool) -> Iterator[pd.DataFrame]:
        """Work off new turns and those that waited for them; what still waits stays in the state."""
        state, expected, handled = self.current.get() if self.current.exists() else (dialogue.INITIAL, self.first_turn, 0)
        late = turns < expected
        held = [(k[0], v[0]) for k, v in self.waiting.iterator()] if self.waiting.exists() else []
        turns_held = np.array([t for t, _ in held], np.int64)
        late |= np.isin(turns, turns_held)
        turns, moves, again = turns[~late], moves[~late], turns[late][moves[late] != ""]
        turns, first = np.unique(turns, return_index=True)  # a turn that is there twice counts once
        every = np.concatenate((turns_held, turns))
        texts = np.concatenate((np.array([m for _, m in held], object), moves[first]))
        order = np.argsort(every)
        every, texts = every[order], texts[order]
        if skip_gap and len(every):
            expected = int(every[0])
        ready = int((every == expected + np.arange(len(every))).sum())
        met = [state]
        for text in texts[:ready]:
            met.append(int(text[met[-1]]) if text else met[-1])
        spoken = np.flatnonzero(texts[:ready] != "")
        met = np.array(met, np.int32)
        turn = np.concatenate((every[spoken], again))
        before = np.concatenate((met[spoken], np.full(len(again), -1, np.int32)))
        after = np.concatenate((met[spoken + 1], np.full(len(again), -1, np.int32)))
        for n in range(0, len(turn), CHUNK):
            part = slice(n, n + CHUNK)
            yield pd.DataFrame({"conv_id": [key[0]] * len(turn[part]), "turn": turn[part], "before": before[part], "after": after[part]})
        waited = set(turns_held.tolist())
        for t in every[:ready].tolist():
            if t in waited:
                self.waiting.removeKey((t,))
        for t, text in zip(every[ready:].tolist(), texts[ready:].tolist(), strict=True):
            if t not in waited:
                self.waiting.updateValue((t,), (text,))
        if len(spoken):
            last = int(met[-1])
            handled = int(met[spoken[-1]]) if last == dialogue.COMPLETED else last
        self.current.update((int(met[-1]), expected + ready, handled))
        self.gap = ready < len(every)

    def _set_timer(self, timerValues) -> None:
        timers = list(self.handle.listTimers())
        if self.gap and not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        elif not self.gap:
            for at in timers:
                self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, moves = [], []
        for arrived in rows:  # a few bytes per message of the micro-batch are kept, to order them
            turns.append(arrived["turn"].to_numpy(np.int64))
            moves.append(arrived["moves"].to_numpy(object))
        yield from self._walk(key, np.concatenate(turns), np.concatenate(moves), skip_gap=False)
        self._set_timer(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        yield from self._walk(key, none, np.zeros(0, object), skip_gap=True)
        if self.gap:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def close(self) -> None:
        pass


class PreviousDelay(StatefulProcessor):
    """Adds the delay of the flight's preceding snapshot, in the order of observation.

    Snapshots wait until the watermark has passed them: nothing older can follow then. One that
    arrives behind the watermark comes out as late, compared with nothing. One that
    was observed more than `kept_ms` after the flight's last is compared with none, and the
    flight's state goes when the watermark is that far.
    """

    def __init__(self, kept_ms: int = KEPT_MS):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "observed_at timestamp_ntz, seq bigint, delay int"
        self.last = handle.getValueState("last", fields)
        self.waiting = handle.getListState("waiting", fields)

    @staticmethod
    def _millis(at: datetime) -> int:
        """The first whole millisecond that is not before a time."""
        return -((_EPOCH - at) // timedelta(milliseconds=1))

    def _timer(self, at_ms: int, going_off: int | None = None) -> None:
        """One timer per key, the earliest that is needed, beside the one that is just going off."""
        timers = sorted(set(self.handle.listTimers()) - {going_off})
        if timers and timers[0] <= at_ms:
            return
        for old in timers:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def _out(self, key, rows: list[tuple], previous: list, late: bool) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["observed_at", "seq", "delay"])
        found = found.assign(flight_number=key[0], previous=pd.Series(previous, dtype="Int64"), late=late)
        return found[["flight_number", "seq", "observed_at", "delay", "previous", "late"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = _EPOCH + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        first = None
        for arrived in rows:
            behind = arrived["observed_at"] <= passed
            times = [at.to_pydatetime() for at in arrived["observed_at"]]
            found = list(zip(times, arrived["seq"].tolist(), arrived["delay"].tolist(), strict=True))
            late = [r for r, b in zip(found, behind, strict=True) if b]
            if late:
                yield self._out(key, late, [None] * len(late), True)
            waits = [r for r, b in zip(found, behind, strict=True) if not b]
            if waits:
                self.waiting.appendList(waits)
                first = min(waits)[0] if first is None else min(first, min(waits)[0])
        if first is not None:
            self._timer(self._millis(first) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = _EPOCH + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted(r for r in waiting if r[0] <= passed)
        later = [r for r in waiting if r[0] > passed]
        held = self.last.get() if self.last.exists() else None
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self.last.update(ready[-1])
        newest = ready[-1] if ready else held
        if later:
            self._timer(self._millis(min(later)[0]) + 1, expiredTimerInfo.getExpiryTimeInMs())
        elif newest is not None:
            forget = self._millis(newest[0]) + self.kept_ms
            if forget <= timerValues.getCurrentWatermarkInMs():
                self.last.clear()
            else:
                self._timer(forget, expiredTimerInfo.getExpiryTimeInMs())
        kept = timedelta(milliseconds=self.kept_ms)
        for n in range(0, len(ready), CHUNK):
            part = ready[n : n + CHUNK]
            before = [held, *part[:-1]]
            near = [b[2] if b and r[0] - b[0] <= kept else None for b, r in zip(before, part, strict=True)]
            held = part[-1]
            yield self._out(key, part, near, False)

    def close(self) -> None:
        pass


def _answered(messages: DataFrame, required: DataFrame) -> DataFrame:
    """Add `answered`: the types all of whose fields a message names.

    The required fields are one row of the plan, a map from type to names, joined to the
    stream as a static table: nothing is collected, and there is no limit to their number.
    """
    fields = required.where(F.col("grievance_type").isin(*GRIEVANCE_TYPES)).groupBy("grievance_type")
    by_type = fields.agg(F.collect_set("field_name").alias("names")).agg(
        F.map_from_entries(F.collect_list(F.struct("grievance_type", "names"))).alias("fields")
    )
    found = answers(F.col("text"))
    exact = F.transform(found["pairs"], lambda p: p["name"])
    spaced = F.when(found["from_json"], F.array().cast("array<string>")).otherwise(
        F.transform(found["pairs"], lambda p: F.lower(p["name"]))
    )
    rows = messages.withColumns({"exact": exact, "spaced": spaced, "one": F.lit(1)})

    def full(kind: Column) -> Column:
        names = F.coalesce(F.try_element_at("fields", kind), F.array().cast("array<string>"))
        plain = lambda n: F.lower(F.replace(n, F.lit("_"), F.lit(" ")))
        return F.forall(names, lambda n: F.array_contains("exact", n) | F.array_contains("spaced", plain(n)))

    # one row on the right: every message meets it once
    joined = rows.join(F.broadcast(by_type.withColumn("one", F.lit(1))), "one")
    kinds = F.array(*(F.lit(t) for t in GRIEVANCE_TYPES))
    return joined.withColumn("answered", F.filter(kinds, full)).drop("exact", "spaced", "one", "fields")


def dialogue_stream(
    messages: DataFrame,
    required: DataFrame,
    classify: Callable[[Column], Column] = classify_by_keywords,
    first_turn: int = 0,
    patience_ms: int = PATIENCE_MS,
    kept_ms: int = KEPT_MS,
) -> DataFrame:
    """Streaming form of operators.dialogue.dialogue_states, for messages in any order.

    A conversation's turns are whole numbers counted from `first_turn`, those of all roles
    together; ids may be of any type. A message waits for the turns before it, at most
    `patience_ms`; one that comes after that has no states (null). A conversation that has
    been silent for `kept_ms` starts anew.
    """
    types = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    table = F.array_join(dialogue.moves(classify(F.col("text")), F.col("answered")).cast("array<string>"), "")
    heard = F.coalesce(dialogue.is_user_message(), F.lit(False))
    steps = _answered(messages.where("turn IS NOT NULL"), required).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(heard, table).otherwise("").alias("moves")
    )
    walked = steps.groupBy("conv_id").transformWithStateInPandas(
        DialogueProcessor(first_turn, patience_ms, kept_ms),
        outputStructType=f"conv_id {types['conv_id']}, turn bigint, before int, after int",
        outputMode="append",
        timeMode="processingTime",
    )
    before, after = (F.when(F.col(c) >= 0, F.col(c)) for c in ("before", "after"))
    return walked.select(
        "conv_id",
        F.col("turn").cast(types["turn"]).alias("turn"),
        F.when(before.isNotNull(), dialogue.state_name(before)).alias("state_before"),
        F.when(after.isNotNull(), dialogue.state_name(after)).alias("state_after"),
        F.when(after == dialogue.COMPLETED, dialogue.state_type(before))
        .otherwise(dialogue.state_type(after))
        .alias("grievance_type"),
    )


def latest_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(conv_id, state, grievance_type) of every conversation that a dialogue stream holds, read
    from the state in its checkpoint: where each stands after the last complete batch."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "current").load()
    return held.select(
        F.col("key.conv_id").alias("conv_id"),
        dialogue.state_name(F.col("value.value.state")).alias("state"),
        dialogue.state_type(F.col("value.value.handled")).alias("grievance_type"),
    )


def entitlement_stream(
    snapshots: DataFrame, thresholds: DataFrame, late: str = "2 hours", kept_ms: int = KEPT_MS
) -> DataFrame:
    """Streaming form of operators.flights.entitlement_changes, for snapshots in any order.

    A snapshot is worked off when the watermark, `late` behind the newest, has passed it. One
    that arrives behind the watermark is too late: it comes out once with gained null and changes
    nothing. A snapshot more than `kept_ms` after the flight's last one is
    compared with none.
    """
    at = F.col("observed_at").cast("timestamp")
    steps = (
        flights.decode_status(snapshots)
        .where("outcome = 'success'")
        .withColumn("event_time", at)
        .withWatermark("event_time", late)
        .select("flight_number", "seq", "observed_at", F.col("new_delay").alias("delay"), "event_time")
        .groupBy("flight_number")
        .transformWithStateInPandas(
            PreviousDelay(kept_ms),
            outputStructType="flight_number string, seq bigint, observed_at timestamp_ntz, "
            "delay int, previous int, late boolean",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    return flights.gained_in_row(steps, thresholds)
