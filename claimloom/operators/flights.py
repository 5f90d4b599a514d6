"""Flight tracking: due rows, status snapshots, keyed refresh, entitlements by delay.

flights(flight_number, user_id, initial_departure_time, delay, raw_data, last_check);
snapshots(flight_number, seq, observed_at, response_json).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.joins import spread_join
from claimloom.session import materialise

REFRESH_SECONDS = 3600
RESPONSE_DDL = "data ARRAY<STRUCT<departure: STRUCT<delay: STRING>>>"
ERRORS = {"no_data": "no status data", "failed": "delay is not a whole number"}


def due(as_of: Column, threshold: int = REFRESH_SECONDS) -> Column:
    """Never checked, or an hour has passed since both last check and departure."""
    now = F.unix_timestamp(as_of)
    waited = F.least(
        now - F.unix_timestamp("last_check"), now - F.unix_timestamp("initial_departure_time")
    )
    return F.col("last_check").isNull() | (waited >= threshold)


def due_flights(flights: DataFrame, as_of: Column, threshold: int = REFRESH_SECONDS) -> DataFrame:
    return flights.where(due(as_of, threshold))


def latest_status(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per flight; Spark reduces each task's rows before the
    shuffle, so a flight with very many snapshots is no burden."""
    newest = F.max_by(
        F.struct("observed_at", "response_json"), F.struct("observed_at", "seq")
    )
    return (
        snapshots.groupBy("flight_number")
        .agg(newest.alias("s"))
        .select("flight_number", "s.observed_at", "s.response_json")
    )


def decode_status(snapshots: DataFrame) -> DataFrame:
    """Add outcome (success, no_data or failed) and new_delay, from the first element of data.

    A missing or null delay counts as 0, one that is not a whole number fails; malformed or
    empty responses have no data.
    """
    data = F.from_json("response_json", RESPONSE_DDL)["data"]
    has_data = F.coalesce(F.size(data), F.lit(0)) > 0
    delay = F.coalesce(F.get(data, F.lit(0))["departure"]["delay"], F.lit("0")).try_cast("int")
    return snapshots.withColumn("new_delay", F.when(has_data, delay)).withColumn(
        "outcome",
        F.when(~has_data, "no_data").when(F.col("new_delay").isNull(), "failed").otherwise("success"),
    )


def due_outcomes(flights: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """One row per distinct due flight: outcome, new_delay, response_json."""
    wanted = due_flights(flights, as_of).select("flight_number").distinct()
    status = decode_status(latest_status(snapshots))
    return wanted.join(status, "flight_number", "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("no_data"))
    )


def apply_status(flights: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """All rows of a refreshed flight take its delay, response and check time; rows
    without data keep their old values and so stay due."""
    fresh = outcomes.where("outcome = 'success'").select(
        "flight_number", "new_delay", "response_json"
    )
    joined = flights.join(fresh, "flight_number", "left")
    hit = F.col("new_delay").isNotNull()
    updates = {
        "delay": F.when(hit, F.col("new_delay")).otherwise(F.col("delay")),
        "raw_data": F.when(hit, F.col("response_json")).otherwise(F.col("raw_data")),
        "last_check": F.when(hit, as_of).otherwise(F.col("last_check")),
    }
    return joined.select(*(updates[c].alias(c) if c in updates else F.col(c) for c in flights.columns))


def refresh_flights(flights: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    return apply_status(flights, due_outcomes(flights, snapshots, as_of), as_of)


def refresh_log(flights: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """One row per due row: flight, user, status, delay, error."""
    return (
        due_flights(flights, as_of)
        .join(outcomes.select("flight_number", "outcome", "new_delay"), "flight_number", "left")
        .select(
            F.col("flight_number").alias("flight"),
            "user_id",
            F.col("outcome").alias("status"),
            F.col("new_delay").alias("delay"),
            F.coalesce(*(F.when(F.col("outcome") == k, text) for k, text in ERRORS.items())).alias("error"),
        )
    )


def refresh_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
    )


#: Pieces that rows of one delay are dealt to.
COPIES = 8
#: Thresholds up to this number stand in the plan, and a row is compared with them in place.
IN_PLACE = 1000

# Delays and thresholds are compared exactly; blocks only find the pairs to compare.
BITS = 62


def _place(value: Column) -> Column:
    """A whole number of BITS bits that rises with the value; extreme values share the ends."""
    half = 1 << (BITS - 1)
    low, high = F.lit(-half).cast("bigint"), F.lit(half - 1).cast("bigint")
    inside = (value > low) & (value < high)
    floor = F.floor(F.when(inside, value).try_cast("decimal(38,10)")).cast("bigint")
    return F.coalesce(floor, F.when(value > 0, high).otherwise(low)) + half


def entitlements_by_delay(
    delays: DataFrame, thresholds: DataFrame, previous: str | None = None
) -> DataFrame:
    """Add each entitlement whose min_delay_minutes the row's delay reaches; with
    `previous`, only if the delay in that column did not reach it already.

    A range join as an equality join, for any number of thresholds. [m, 2^BITS) is the
    disjoint union of the block of m itself and, for each zero bit of m, the block to its
    right; a delay lies in one block of each size. Distinct delays are matched, of which
    there are few, and joined back to the rows; values are compared in their own types.
    """
    keys = ["delay"] + ([previous] if previous else [])
    marks = thresholds.select(F.col("min_delay_minutes").alias("least"), "entitlement")
    marks = marks.where("least IS NOT NULL").withColumn("place", _place(F.col("least")))
    levels = F.sequence(F.lit(0), F.lit(BITS - 1))

    def block(value, level):
        return F.call_function("shiftright", value, level)

    right_of = F.filter(
        F.transform(
            levels,
            lambda k: F.struct(
                k.alias("level"),
                F.when(block(F.col("place"), k).bitwiseAND(F.lit(1)) == 0, block(F.col("place"), k) + 1).alias("block"),
            ),
        ),
        lambda b: b["block"].isNotNull(),
    )
    own = F.array(F.struct(F.lit(0).alias("level"), F.col("place").alias("block")))
    spread = marks.select("entitlement", "least", F.inline(F.concat(own, right_of)))
    values = delays.select(*keys).where("delay IS NOT NULL").distinct()
    blocks = F.transform(
        levels, lambda k: F.struct(k.alias("level"), block(_place(F.col("delay")), k).alias("block"))
    )
    reached = F.col("least") <= F.col("delay")
    if previous:
        reached &= F.col(previous).isNull() | (F.col(previous) < F.col("least"))
    pairs = (
        spread_join(values.select(*keys, F.inline(blocks)), spread, ["level", "block"], "delay", pieces=COPIES)
        .where(reached)
        .select(*(F.col(k).alias(f"of_{k}") for k in keys), "least", "entitlement")
    )
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) if k != "delay" else F.col(k) == F.col(f"of_{k}") for k in keys]
    # delays are few, so rows of one delay are dealt to pieces
    rows = delays.withColumn("__piece", F.pmod(F.xxhash64(*delays.columns), F.lit(COPIES)).cast("int"))
    copies = pairs.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    same.append(F.col("__piece") == F.col("__copy"))
    return rows.join(copies, same).select(*delays.columns, "entitlement")


def previous_delay(steps: DataFrame, bucket: str = "hour") -> DataFrame:
    """Add the delay of the flight's preceding snapshot.

    A flight may hold a large part of all snapshots, so the order is taken within
    (flight, bucket of time); the last delay of each bucket is carried to the next.
    """
    steps = steps.withColumn("bucket", F.date_trunc(bucket, "observed_at"))
    in_bucket = Window.partitionBy("flight_number", "bucket").orderBy("observed_at", "seq")
    over_buckets = Window.partitionBy("flight_number").orderBy("bucket")
    carried = (
        steps.groupBy("flight_number", "bucket")
        .agg(F.max_by("delay", F.struct("observed_at", "seq")).alias("last"))
        .select("flight_number", "bucket", F.lag("last").over(over_buckets).alias("carried"))
    )
    return (
        steps.withColumn("within", F.lag("delay").over(in_bucket))
        .join(carried, ["flight_number", "bucket"])
        .withColumn("previous", F.coalesce("within", "carried"))
        .drop("bucket", "within", "carried")
    )


def entitlement_changes(
    snapshots: DataFrame, thresholds: DataFrame, folder: str | None = None
) -> DataFrame:
    """(flight_number, seq, observed_at, gained): entitlements newly reached by a
    snapshot compared with the one before it; the first is compared with none.

    An entitlement is gained when the delay reaches its threshold and the delay of the
    previous snapshot did not. Snapshots without data change nothing.
    """
    delays = (
        decode_status(snapshots)
        .where("outcome = 'success'")
        .select("flight_number", "seq", "observed_at", F.col("new_delay").alias("delay"))
    )
    # read twice below; this way the responses are decoded once
    steps = previous_delay(materialise(delays, "delays", folder))
    return gained_entitlements(steps, thresholds)


def _marks(least: DataFrame) -> Column | None:
    """The thresholds as one array, where they are at most IN_PLACE."""
    rows = least.select("min_delay_minutes", "entitlement").limit(IN_PLACE + 1).collect()
    if len(rows) > IN_PLACE:
        return None
    kinds = {f.name: f.dataType for f in least.schema.fields}
    marks = [
        F.struct(
            F.lit(r.min_delay_minutes).cast(kinds["min_delay_minutes"]).alias("least"),
            F.lit(r.entitlement).cast(kinds["entitlement"]).alias("entitlement"),
        )
        for r in rows
    ]
    none = f"array<struct<least: {kinds['min_delay_minutes'].simpleString()}, entitlement: string>>"
    return F.array(*marks) if marks else F.array().cast(none)


def _gained(marks: Column) -> Column:
    """Entitlements that the row's delay reaches and its previous one did not."""
    new = F.filter(
        marks,
        lambda m: (m["least"] <= F.col("delay")) & (F.col("previous").isNull() | (F.col("previous") < m["least"])),
    )
    return F.transform(new, lambda m: m["entitlement"])


def _least(thresholds: DataFrame) -> DataFrame:
    least = thresholds.groupBy("entitlement").agg(F.min("min_delay_minutes").alias("min_delay_minutes"))
    return least.where("min_delay_minutes IS NOT NULL")


def gained_entitlements(steps: DataFrame, thresholds: DataFrame) -> DataFrame:
    """steps(flight_number, seq, observed_at, delay, previous) -> one row per gain."""
    least = _least(thresholds)
    marks = _marks(least)
    if marks is None:
        found = entitlements_by_delay(steps, least, previous="previous").withColumnRenamed("entitlement", "gained")
    else:
        found = steps.withColumn("gained", F.explode(_gained(marks)))
    return found.select("flight_number", "seq", "observed_at", "gained")


def gained_in_row(steps: DataFrame, thresholds: DataFrame) -> DataFrame:
    """gained_entitlements for a stream: a step meets the thresholds within its own row, so there
    is no join state. A late step gives one row with gained null."""
    least = _least(thresholds)
    marks = _marks(least)
    if marks is None:  # one row on the right: every step meets it once
        table = least.agg(F.collect_list(F.struct(F.col("min_delay_minutes").alias("least"), "entitlement")).alias("marks"))
        steps = steps.withColumn("one", F.lit(1)).join(F.broadcast(table.withColumn("one", F.lit(1))), "one")
        marks = F.col("marks")
    names = F.when(F.col("late"), F.array(F.lit(None).cast("string"))).otherwise(_gained(marks))
    return steps.select("flight_number", "seq", "observed_at", F.explode(names).alias("gained"))
