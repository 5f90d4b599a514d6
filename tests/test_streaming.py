"""Streams give what the batch operators give."""

import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import fixtures as fx
from claimloom.operators import dialogue, flights, gold
from claimloom.sources import snapshots as snapshot_source
from claimloom.plans import refresh as plan
from claimloom.sources import tables
from claimloom.streaming import cases as case_stream
from claimloom.streaming import refresh, stateful


def as_set(df):
    return {tuple(r) for r in df.collect()}


def run_to_memory(stream, name, checkpoint):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_snapshots(df, folder, column, bounds):
    """One JSON file per range of `column`, named so that they are read in order."""
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = df.where((F.col(column) >= low) & (F.col(column) < high))
        part.coalesce(1).write.mode("append").json(f"{folder}/part{n}")


def shuffled(df, folder, seed, files):
    """One JSON file per part of the rows, dealt at random: files are read in order of time."""
    for n in range(files):
        part = df.where(F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(files)) == n)
        part.coalesce(1).write.mode("append").json(f"{folder}/part{n}")


def json_stream(spark, schema, folder):
    """Files in the order of their folders' names: a source reads them by time."""
    for n, path in enumerate(sorted(Path(folder).rglob("*.json"))):
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").json(folder)
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_dialogue_stream_equals_fold_in_any_order(spark, sf_dir, tmp_path, seed):
    required = gold.required_fields(fx.view(spark, sf_dir, "fx_required_raw"))
    required = spark.createDataFrame(required.collect(), required.schema)
    messages = fx.view(spark, sf_dir, "fx_messages")
    # one conversation holds a third of all messages
    long = F.row_number().over(Window.orderBy("conv_id", "turn")) - 1
    third = messages.where("conv_id % 3 = 0").withColumns({"turn": long, "conv_id": F.lit(-1).cast("bigint")})
    messages = messages.where("conv_id % 3 <> 0").unionByName(third.select(messages.columns))
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    assert messages.withColumn("first", first).where("first <> 0").count() == 0
    messages = spark.createDataFrame(messages.collect(), messages.schema)
    folder = str(tmp_path / "messages")
    shuffled(messages, folder, seed, 4)
    out = stateful.dialogue_stream(json_stream(spark, messages.schema, folder), required)
    run_to_memory(out, f"dialogue_out{seed}", str(tmp_path / "cp"))
    got = as_set(spark.table(f"dialogue_out{seed}"))
    assert got == as_set(dialogue.dialogue_states(messages, required))
    assert {"initial", "awaiting_fields", "completed"} <= {r[3] for r in got}
    # where each conversation stands, from the stream's own state
    states = dialogue.dialogue_states(messages, required)
    want = dialogue.conversation_states(messages, states).select("conv_id", "state", "grievance_type")
    assert as_set(stateful.latest_states(spark, str(tmp_path / "cp"))) == as_set(want)


def test_missing_and_late_turns(spark, tmp_path):
    """A gap is waited for, then passed over; a turn that comes after that has no states."""
    required = spark.createDataFrame([("delay", "hours")], "grievance_type string, field_name string")
    required = required.selectExpr("*", "1 AS field_order", "'' AS field_description")
    schema = "conv_id long, turn int, role string, text string"
    batches = [
        [(1, 0, "user", "a delay"), (1, 2, "user", "hours: 3"), (2, 1, "user", "hours: 4"), (2, 1, "user", "hours: 4")],
        [(2, 0, "user", "a delay"), (3, 0, "assistant", "hello")],
        [(1, 1, "user", "hello"), (3, 1, "user", "a delay")],
    ]
    folder = tmp_path / "messages"
    for name, patience, late in (("patient", 3_600_000, []), ("hasty", 1, [(1, 1, None)])):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}/{name}/part{n}")
        stream = json_stream(spark, schema, f"{folder}/{name}")
        out = stateful.dialogue_stream(stream, required, patience_ms=patience)
        run_to_memory(out, name, str(tmp_path / f"cp-{name}"))
        got = as_set(spark.table(name).select("conv_id", "turn", "state_after"))
        assert {r for r in got if r[2] is None} == set(late)
        assert {(1, 0, "awaiting_fields"), (1, 2, "completed"), (2, 0, "awaiting_fields"), (3, 1, "awaiting_fields")} <= got
    assert (2, 1, "completed") in as_set(spark.table("patient").select("conv_id", "turn", "state_after"))


def test_dialogue_stream_takes_text_ids(spark, sf_dir, tmp_path):
    required = gold.required_fields(fx.view(spark, sf_dir, "fx_required_raw"))
    messages = fx.view(spark, sf_dir, "fx_messages").withColumn("conv_id", F.concat(F.lit("a-"), F.col("conv_id")))
    messages.coalesce(1).write.json(str(tmp_path / "messages"))
    stream = spark.readStream.schema(messages.schema).json(str(tmp_path / "messages"))
    run_to_memory(stateful.dialogue_stream(stream, required), "text_ids_out", str(tmp_path / "cp"))
    assert as_set(spark.table("text_ids_out")) == as_set(dialogue.dialogue_states(messages, required))


def test_silent_conversations_are_forgotten(spark, sf_dir, tmp_path):
    required = gold.required_fields(fx.view(spark, sf_dir, "fx_required_raw"))
    messages = fx.view(spark, sf_dir, "fx_messages")
    for name, kept in (("kept_out", 3_600_000), ("short_out", 1)):
        folder = str(tmp_path / name)
        write_snapshots(messages, folder, "turn", [0, 3, 100])
        stream = (
            spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").json(folder)
        )
        run_to_memory(stateful.dialogue_stream(stream, required, kept_ms=kept), name, str(tmp_path / f"cp-{name}"))
    anew = spark.table("short_out").where("turn >= 3 AND state_before = 'awaiting_fields'").count()
    assert anew < spark.table("kept_out").where("turn >= 3 AND state_before = 'awaiting_fields'").count()


@pytest.fixture
def by_event_time(spark):
    """A stream by event time ends with its last watermark, which takes a batch without data."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    yield
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def status_rows(spark, rows):
    table = [(f, s, datetime.fromisoformat(t), '{"data":[{"departure":{"delay":%d}}]}' % d) for f, s, t, d in rows]
    names = "flight_number string, seq long, observed_at timestamp_ntz, response_json string"
    return spark.createDataFrame(table, names).select("seq", "flight_number", "observed_at", "response_json")


def last_watermark(spark, flight="end"):
    """A snapshot long after all others, with which they are passed."""
    return status_rows(spark, [(flight, 10**9, "2200-01-01 00:00:00", 0)])


@pytest.mark.parametrize("seed", [1, 2])
def test_entitlement_stream_equals_batch_in_any_order(spark, sf_dir, tmp_path, by_event_time, seed):
    status = fx.view(spark, sf_dir, "fx_status")
    thresholds = fx.view(spark, sf_dir, "fx_thresholds")
    # few flights, so that each has several snapshots; one of them has a third of all
    flight = F.when(F.col("seq") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("F"), (F.col("seq") % 20).cast("string")))
    status = status.withColumn("flight_number", flight)
    folder = str(tmp_path / "status")
    shuffled(status, folder, seed, 4)
    last_watermark(spark).coalesce(1).write.json(f"{folder}/part9")
    stream = json_stream(spark, snapshot_source.SCHEMA, folder)
    name = f"gained_out{seed}"
    run_to_memory(stateful.entitlement_stream(stream, thresholds, late="3650 days"), name, str(tmp_path / "cp"))
    got = as_set(spark.table(name).select("flight_number", "seq", "gained"))
    want = flights.entitlement_changes(status, thresholds).select("flight_number", "seq", "gained")
    assert got == as_set(want) and got


def test_older_snapshots_within_the_watermark(spark, tmp_path, by_event_time):
    """Dealt by seq, an older observation comes later; behind the watermark it is late."""
    thresholds = spark.createDataFrame([("a", 60), ("b", 90), ("c", 150)], "entitlement string, min_delay_minutes int")
    rows = [
        [("X", 1, "2024-01-01 10:10:00", 100), ("Y", 2, "2024-01-01 10:00:00", 70)],
        [("X", 3, "2024-01-01 10:05:00", 200), ("Y", 4, "2024-01-01 10:00:00", 100), ("Z", 5, "2024-01-01 20:00:00", 0)],
        [("X", 6, "2024-01-01 09:00:00", 300)],  # by now the watermark is 18:00
        [("X", 7, "2024-01-02 10:00:00", 160)],
    ]
    folder = str(tmp_path / "in")
    parts = [status_rows(spark, part) for part in rows]
    for n, part in enumerate([*parts, last_watermark(spark)]):
        part.coalesce(1).write.json(f"{folder}/part{n}")
    stream = json_stream(spark, snapshot_source.SCHEMA, folder)
    run_to_memory(stateful.entitlement_stream(stream, thresholds), "older_out", str(tmp_path / "cp"))
    on_time = parts[0].unionByName(parts[1]).unionByName(parts[3])
    want = as_set(flights.entitlement_changes(on_time, thresholds).select("flight_number", "seq", "gained"))
    assert as_set(spark.table("older_out").select("flight_number", "seq", "gained")) == want | {("X", 6, None)}
    assert want == {("X", 3, "a"), ("X", 3, "b"), ("X", 3, "c"), ("X", 7, "c"), ("Y", 2, "a"), ("Y", 4, "b")}


def test_silent_flights_are_forgotten(spark, tmp_path, by_event_time):
    thresholds = spark.createDataFrame([("a", 60)], "entitlement string, min_delay_minutes int")
    days = ["2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-03-01 10:00:00", "2024-03-02 10:00:00"]
    folder = str(tmp_path / "in")
    for n, day in enumerate(days):
        flight = "X" if n != 2 else "other"  # its snapshot takes the watermark on
        status_rows(spark, [(flight, n, day, 70)]).coalesce(1).write.json(f"{folder}/part{n}")
    last_watermark(spark).coalesce(1).write.json(f"{folder}/part9")
    stream = json_stream(spark, snapshot_source.SCHEMA, folder)
    run_to_memory(stateful.entitlement_stream(stream, thresholds), "forgotten_out", str(tmp_path / "cp"))
    assert {r[1] for r in as_set(spark.table("forgotten_out").where("flight_number = 'X'"))} == {0, 3}


def test_case_run_stream(spark, tmp_path):
    required = spark.createDataFrame(
        [("delay", "hours", 1, "d", "critical", True, "why")],
        "grievance_type string, field_name string, field_order int, field_description string, "
        "importance string, is_required boolean, why_needed string",
    )
    rules = spark.createDataFrame(
        [("r", "delay", "1", "hours 4")],
        "rule_id string, scenario_type string, source_para string, retrieval_text string",
    )
    conditions = spark.createDataFrame([("r", "hours", ">=", "3")], "rule_id string, fact_key string, op string, operand string")
    intake = spark.createDataFrame(
        [(1, "s1", "a delay\nHours: 4"), (2, "s2", "a delay"), (3, "s3", "hello"), (4, "s4", "late delay\nhours: 1")],
        "case_id long, session_id string, user_text string",
    )
    folder = str(tmp_path / "intake")
    write_snapshots(intake, folder, "case_id", [0, 3, 9])
    stream = (
        spark.readStream.schema(intake.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").json(folder)
    )
    out, told, scratch = (str(tmp_path / n) for n in ("runs", "told", "scratch"))
    for checkpoint in ("a", "b"):  # the second run repeats both batches
        case_stream.start_case_runs(
            stream, required, rules, conditions, out, told, lambda n: fx.AS_OF, str(tmp_path / checkpoint), folder=scratch
        ).awaitTermination()
    stored = tables.read_case_runs(spark, out)
    got = as_set(stored.selectExpr("session_id", "get_json_object(match_json, '$.applicable_rule_ids')"))
    assert got == {("s1", '["r"]'), ("s4", "[]")} and stored.count() == 2
    # everyone is told something, also without a match
    status = as_set(spark.read.parquet(told).selectExpr("session_id", "status", "array_join(missing_critical_fields, ',')"))
    assert status == {("s1", "matched", ""), ("s4", "matched", ""), ("s2", "need_more_info", "hours"), ("s3", "unsupported", "")}
    # what a batch wrote on the way is gone
    assert not list((tmp_path / "scratch").rglob("*.parquet"))


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_refresh_does_not_depend_on_batches(spark, sf_dir, tmp_path, files_per_batch):
    tracked = fx.view(spark, sf_dir, "fx_flights")
    status = fx.view(spark, sf_dir, "fx_status")
    folders = {n: str(tmp_path / n) for n in ("flights", "status", "log", "in")}
    tables.write_keyed(tracked, folders["flights"], "flight_number")
    write_snapshots(status, folders["in"], "seq", [0, 200, 600, 100000])
    as_of = F.lit(fx.AS_OF).cast("timestamp_ntz")
    columns = sorted(tracked.columns)
    want = as_set(flights.refresh_flights(tracked, status, as_of).select(columns))
    log = as_set(plan.refresh(tracked, status, as_of)[1])
    for checkpoint in ("cp", "cp2"):  # the second one repeats the run, as after a lost checkpoint
        stream = snapshot_source.stream_snapshots(spark, folders["in"] + "/*", files_per_batch)
        refresh.refresh_run(
            stream, folders["flights"], folders["status"], folders["log"], 0, fx.AS_OF, str(tmp_path / checkpoint)
        )
        assert as_set(tables.read_table(spark, folders["flights"], 1).select(columns)) == want
        assert as_set(spark.read.parquet(folders["log"] + "/run=0")) == log
    assert {r[2] for r in log} == {"success", "no_data", "failed"}
    assert len(tables.versions(spark, folders["status"])) <= 2


def keyed(spark, folder):
    tables.write_keyed(spark.range(500).selectExpr("concat('F', id) AS k", "id AS v"), folder, "k")


def seen_files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_update_leaves_unchanged_pieces_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    keyed(spark, folder)
    changed = spark.createDataFrame([("F7",), ("new",)], "k string")
    before = seen_files(tables.read_table(spark, folder, 0))

    def update(rows):
        mended = rows.withColumn("v", F.expr("if(k = 'F7', -1, v)"))
        return mended.where("k <> 'F9'").unionByName(changed.where("k = 'new'").withColumn("v", F.lit(-2).cast("bigint")))

    tables.update_table(spark, folder, 0, changed, "k", update)
    after = tables.read_table(spark, folder, 1)
    want = {(f"F{n}", -1 if n == 7 else n) for n in range(500)} | {("new", -2)}
    got = as_set(after)
    assert got | {("F9", 9)} == want  # only rows of touched pieces can go
    now = seen_files(after)
    assert len(now - before) <= 2 and len(before - now) <= 2 and len(now & before) >= 60
    tables.retire_versions(spark, folder, keep=1)
    assert tables.versions(spark, folder) == [1] and as_set(tables.read_table(spark, folder)) == got
    assert seen_files(tables.read_table(spark, folder)) == now
    # the version that has been retired keeps only the pieces that are still listed
    left = {"file://" + str(p) for p in (tmp_path / "t").rglob("*.parquet") if "pieces" not in p.parts}
    assert {x.split("/t/")[1] for x in left} == {x.split("/t/")[1] for x in now}


def test_crash_before_publishing(spark, tmp_path, monkeypatch):
    """Readers keep to the old version until the new one's list of pieces is there."""
    folder = str(tmp_path / "t")
    keyed(spark, folder)
    before = as_set(tables.read_table(spark, folder))
    changed = spark.createDataFrame([(f"F{n}",) for n in range(9)], "k string")
    negative = lambda rows: rows.withColumn("v", -F.col("v"))

    def crash(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            tables.update_table(spark, folder, 0, changed, "k", negative)
    assert list((tmp_path / "t" / "version=1").rglob("*.parquet"))
    assert tables.versions(spark, folder) == [0] and as_set(tables.read_table(spark, folder)) == before
    tables.update_table(spark, folder, 0, changed, "k", negative)
    assert tables.versions(spark, folder) == [0, 1] and as_set(tables.read_table(spark, folder)) != before
    assert as_set(tables.read_table(spark, folder, 0)) == before


def test_update_of_an_empty_table_and_of_an_old_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.write_keyed(spark.createDataFrame([], "k string, v int"), folder, "k")
    assert as_set(tables.read_table(spark, folder)) == set()
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    tables.update_table(spark, folder, 0, one, "k", lambda rows: rows.unionByName(one))
    tables.update_table(spark, folder, 1, one, "k", lambda rows: rows.where("false"))
    assert as_set(tables.read_table(spark, folder, 1)) == {("a", 1)} and as_set(tables.read_table(spark, folder)) == set()
    with pytest.raises(ValueError, match="later versions"):
        tables.update_table(spark, folder, 0, one, "k", lambda rows: rows)


def test_status_batches_touch_only_their_pieces(spark, tmp_path):
    folder, source = str(tmp_path / "status"), str(tmp_path / "in")
    first = status_rows(spark, [(f"F{n}", n, "2024-01-01 10:00:00", n) for n in range(300)])
    second = status_rows(spark, [("F7", 900, "2024-01-01 11:00:00", 5), ("F8", 901, "2024-01-01 09:00:00", 5), ("new", 902, "2024-01-01 09:00:00", 5)])
    files = []
    for n, part in enumerate((first, second)):
        part.coalesce(1).write.json(f"{source}/part{n}")
        stream = snapshot_source.stream_snapshots(spark, source + "/*", 1)
        refresh.collect_status(stream, folder, str(tmp_path / "cp"))
        files.append(seen_files(tables.read_table(spark, folder)))
    assert len(files[1] - files[0]) <= 3 and len(files[0] & files[1]) >= 55
    got = {r.flight_number: r.seq for r in tables.read_table(spark, folder).collect()}
    assert got == {f"F{n}": n for n in range(300)} | {"F7": 900, "new": 902}
