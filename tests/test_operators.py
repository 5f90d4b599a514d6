"""Hand-computed cases for the points that are easy to get wrong."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions import sql as sql_functions
from claimloom.functions import text as text_functions
from claimloom.operators import dialogue, envelope, facts, flights, gold, letters, messages, rules
from claimloom.operators import messages as op_messages
from claimloom.plans import cases as case_plan
from claimloom.session import materialise
from claimloom.sources import extraction, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- text ------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", " a ", " \ta b\x1c\n", " ", "x　", "é ", "a​"])
def test_strip_is_unicode_aware(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(text_functions.strip(F.col("t")), text_functions.words(F.col("t"))).first()
    assert row[0] == text.strip()
    assert row[1] == text.split()


@pytest.mark.parametrize("text, term", [("aaaa", "aa"), ("abc", "x"), ("refunds refund", "refund"), ("", "a")])
def test_count_of(spark, text, term):
    df = spark.createDataFrame([(text, term)], "t string, k string")
    assert df.select(text_functions.count_of(F.col("t"), F.col("k"))).first()[0] == text.count(term)


def test_tokens_keep_dots(spark):
    df = spark.createDataFrame([("4 hours. Hours 4",), (None,)], "t string")
    got = [set(r[0]) for r in df.select(text_functions.tokens(F.col("t"))).collect()]
    assert got == [{"4", "hours.", "hours"}, set()]


# ---- gold ------------------------------------------------------------------------


def test_required_fields_ties_and_blanks(spark):
    raw = spark.createDataFrame(
        [
            ("Delay", " Hours ", "b", "minor", "xx"),
            ("delay ", "hours", "a", None, "yy"),
            ("delay", "Hours", "long", "CRITICAL ", None),
            ("delay", "  ", "d", "critical", None),
            (None, "k", "d", "critical", None),
            ("  ", "k", "d", "x", None),
            ("delay", "a_field", "d", "supporting", None),
        ],
        "grievance_type string, fact_key string, description string, importance string, why_needed string",
    )
    got = rows(gold.required_fields(raw).select("grievance_type", "field_name", "field_order", "field_description"))
    assert got == [("", "k", 1, "d"), ("delay", "a_field", 2, "d"), ("delay", "hours", 1, "long")]


def test_rule_defaults_and_text(spark):
    raw = spark.createDataFrame(
        [(" R1", None, "", "Baggage", None, "when", None, None, None, None)],
        "rule_id string, title string, source_para string, scenario_type string, rule_family string, "
        "applies_when_text string, does_not_apply_when_text string, passenger_gets_text string, "
        "references_json string, keywords_json string",
    )
    r = gold.rules(raw).first()
    assert (r.rule_id, r.scenario_type, r.rule_family) == ("r1", "cross_cutting", "entitlement")
    assert r.retrieval_text == " |  | when |  |  |  | "


# ---- envelopes -------------------------------------------------------------------


def test_envelope_errors_do_not_fail(spark):
    df = spark.createDataFrame(
        [
            ("a", '{"error_message":null,"response":{"rules":[{"rule_id":"x","references":[{"ref_text":"p"}]}]}}'),
            ("b", '{"error_message":"bad scan","response":null}'),
            ("c", "{broken"),
            ("d", None),
        ],
        "path string, extracted string",
    )
    decoded = envelope.decode_envelopes(df)
    # a null response decodes to a record without any field
    got = {r.path: (r.error_message, bool(r.resp and r.resp.rules)) for r in decoded.collect()}
    assert got == {"a": (None, True), "b": ("bad scan", False), "c": (None, False), "d": (None, False)}
    assert [tuple(r) for r in envelope.rule_rows(decoded).select("rule_id", "references_json").collect()] == [
        ("x", '[{"ref_text":"p"}]')
    ]


def test_json_round_trip(spark):
    df = spark.createDataFrame([(["a", 'q"uote', ""],), ([],), (None,)], "l array<string>")
    back = df.select("l", envelope.json_list_or_empty(F.to_json("l")).alias("b"))
    assert all((r.l or []) == r.b for r in back.collect())


def test_extraction_stage(spark):
    docs = spark.createDataFrame([("a", "ok"), ("b", None)], "path string, parsed string")

    def extractor(texts):
        return [{"document_id": text} if text else "empty" for text in texts]

    got = rows(envelope.decode_envelopes(extraction.extract_documents(docs, extractor)).select("path", "error_message", "resp.document_id"))
    assert got == [("a", None, "ok"), ("b", "empty", None)]


# ---- facts -----------------------------------------------------------------------

REQUIRED = [
    ("delay", "hours", 1, "d", "critical", True, None),
    ("delay", "gate", 2, "d", "supporting", False, "w"),
]
REQUIRED_DDL = (
    "grievance_type string, field_name string, field_order int, field_description string, "
    "importance string, is_required boolean, why_needed string"
)
FACTS_DDL = "case_id long, pos long, origin string, fact_key string, value string"


def test_facts_overrides(spark):
    cases = spark.createDataFrame([(1, "delay"), (2, "delay"), (3, "odd")], "case_id long, grievance_type string")
    required = spark.createDataFrame(REQUIRED, REQUIRED_DDL)
    given = spark.createDataFrame(
        [
            (1, 1, "message", " HOURS ", "3"),
            (1, 2, "message", "hours", " 4\t"),
            (1, 3, "message", "hours", "  "),
            (1, 4, "message", "unlisted", "x"),
            (1, 5, "extra", "unlisted", "kept"),
            (2, 1, "message", "hours", "5"),
            (2, 2, "extra", "hours", " "),
            (2, 0, "extra", "Gate", "B"),
            (3, 1, "message", "hours", "1"),
        ],
        FACTS_DDL,
    )
    known = facts.known_facts(cases, given, required)
    assert rows(known.select("case_id", "fact_key", "value")) == [
        (1, "hours", "4"), (1, "unlisted", "kept"), (2, "Gate", "B"), (2, "hours", " "),
    ]
    missing = facts.missing_fields(cases, known, required)
    assert rows(missing.select("case_id", "field_name")) == [(1, "gate"), (2, "gate"), (2, "hours")]
    status = facts.case_status(cases, missing)
    assert rows(status.select("case_id", "status")) == [(1, "matched"), (2, "need_more_info"), (3, "matched")]


# ---- rules -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "op, operand, value, code",
    [
        (">=", "3", "3", 2), (">=", "3", "2.5", 0), ("<", "3", "4 hours", 1), ("<", "3", "5d", 1),
        ("<", "3", None, 1), ("<", "3", "  ", 1), ("<=", "x", "1", 1), (">", " 2 ", " 3 ", 2),
        ("=", "4", "4.0", 2), ("=", "Yes", " yes ", 2), ("!=", "4", "4.0", 0), ("!=", "a", "b", 2),
        ("in", "a, B ,c", "b", 2), ("in", "a,b", "d", 0), ("is_true", None, "YES", 2),
        ("=>", "3", "4", 1), (">=", "3", "\t4", 2), ("in", "a,\u00a0b", " B", 2),
        ("is_true", None, "no", 0), ("is_true", None, "perhaps", 1), ("is_false", None, "false", 2),
    ],
)
def test_condition(spark, op, operand, value, code):
    cases = spark.createDataFrame([(1, "delay")], "case_id long, grievance_type string")
    known = spark.createDataFrame([(1, "k", value)], "case_id long, fact_key string, value string")
    conditions = spark.createDataFrame([("r", "k", op, operand)], "rule_id string, fact_key string, op string, operand string")
    kind = rules.MATCH_KINDS[code]
    pairs = spark.createDataFrame([(1, "r")], "case_id long, rule_id string")
    got = rules.candidate_outcomes(pairs, known, conditions).first()
    assert got.match_kind == kind
    assert got.missing_facts == (["k"] if code == 1 else [])
    table = spark.createDataFrame(
        [("r", "cross_cutting", "entitlement", None, "t", "g")],
        "rule_id string, scenario_type string, rule_family string, source_para string, title string, passenger_gets_text string",
    )
    evaluated = [r.match_kind for r in rules.eval_rules(cases, known, table, conditions).collect()]
    assert evaluated == ([kind] if code else [])
    # the SQL table function agrees
    table.createOrReplaceTempView("t_rules")
    conditions.createOrReplaceTempView("t_conditions")
    sql_functions.register_eval_rules(spark, "t_rules", "t_conditions")
    given = json.dumps({} if value is None else {"k": value})
    called = spark.sql("SELECT match_kind FROM eval_rules_det('delay', :given) ORDER BY match_kind", args={"given": given})
    assert [r[0] for r in called.collect()] == evaluated


def many_conditions(spark):
    """Cases with six answers each, rules with up to six conditions and 300 rules that are alike."""
    cases = spark.createDataFrame([(1, "delay"), (2, "delay"), (3, "delay"), (4, "downgrade")], "case_id long, grievance_type string")
    said = {1: "yyyyyy", 2: "yyyyyn", 3: "yyyyy?", 4: "nyyyyy"}
    answers = {"y": "yes", "n": "no", "?": None}
    known = spark.createDataFrame(
        [(c, f"k{n}", answers[a]) for c, all_said in said.items() for n, a in enumerate(all_said)], "case_id long, fact_key string, value string"
    )
    asked = {"six": range(6), "five": range(5), "last": [5], "free": []} | {f"a{n:03}": [0] for n in range(300)}
    conditions = spark.createDataFrame(
        [(r, f"k{n}", "is_true", None) for r, ns in asked.items() for n in ns], "rule_id string, fact_key string, op string, operand string"
    )
    table = spark.createDataFrame(
        [(r, "delay" if r in ("last", "a299") else "cross_cutting", "entitlement", None if r == "a007" else str(len(r)), r, "g") for r in asked],
        "rule_id string, scenario_type string, rule_family string, source_para string, title string, passenger_gets_text string",
    )

    def kind(case, r):
        if r in ("last", "a299") and case == 4 or any(said[case][n] == "n" for n in asked[r]):
            return None
        return "exact" if asked[r] and all(said[case][n] == "y" for n in asked[r]) else "maybe"

    want = {(c, r): kind(c, r) for c in said for r in asked}
    return cases, known, table, conditions, {k: v for k, v in want.items() if v}


def test_rules_with_many_conditions_and_many_rules_alike(spark):
    cases, known, table, conditions, want = many_conditions(spark)
    got = rules.eval_rules(cases, known, table, conditions).collect()
    assert len(got) == len(want) and {(r.case_id, r.rule_id): r.match_kind for r in got} == want


@pytest.mark.parametrize("shown", [rules.exact_rule_summary, rules.top_rule_lines, rules.rule_summaries, rules.evaluation_order, None])
def test_classes_of_rules_are_not_broadcast(spark, shown):
    """They are repeated per piece, which the planner does not see when it takes them for small."""
    cases, known, table, conditions, _ = many_conditions(spark)
    members = rules.case_signatures(cases, known, conditions)
    found = rules.eval_signatures(members, table, conditions)
    df = found if shown is None else shown(found, by="signature")
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [scenario_type" in plan and not re.search(r"BroadcastHashJoin \[(scenario_type|class)", plan)


@pytest.mark.parametrize("n, leading", [(1, 1), (3, 1), (3, 128), (400, 128)])
def test_first_rules_are_those_of_all(spark, monkeypatch, n, leading):
    monkeypatch.setattr(rules, "LEADING", leading)
    cases, known, table, conditions, _ = many_conditions(spark)
    members = rules.case_signatures(cases, known, conditions)
    found = [rules.eval_signatures(members, table, conditions, first=f) for f in (None, n)]
    want, got = (rows(rules.top_rule_lines(f, n, by="signature")) for f in found)
    assert got == want and want
    if n < 4 and leading > 1:
        assert found[1].count() < found[0].count() // 4


def test_true_and_unknown_is_maybe(spark):
    known = spark.createDataFrame([(1, "a", "yes")], "case_id long, fact_key string, value string")
    conditions = spark.createDataFrame(
        [("r", "a", "is_true", None), ("r", "b", "is_true", None)],
        "rule_id string, fact_key string, op string, operand string",
    )
    pairs = spark.createDataFrame([(1, "r"), (1, "free")], "case_id long, rule_id string")
    assert rows(rules.candidate_outcomes(pairs, known, conditions)) == [
        (1, "free", "maybe", []), (1, "r", "maybe", ["b"]),
    ]


def test_ai_extract_in_sql(spark):
    sql_functions.register_ai_extract(spark, lambda text, schema, options: {"n": len(text), "v": options["version"]})
    got = spark.sql(
        "SELECT parse_json(ai_extract(t, '{}', map('version', '2.0'))) AS e FROM VALUES ('abc') AS x(t)"
    ).selectExpr("e:response.n::INT AS n", "e:response.v::STRING AS v", "e:error_message::STRING AS err").first()
    assert tuple(got) == (3, "2.0", None)


# ---- flights ---------------------------------------------------------------------


def test_due_boundary(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (1, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(NULL AS TIMESTAMP_NTZ)),
        (2, TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-15 11:00:00'),
        (3, TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-15 11:00:01'),
        (4, TIMESTAMP_NTZ '2024-01-15 11:00:00.9', TIMESTAMP_NTZ '2024-01-15 10:00:00'),
        (5, TIMESTAMP_NTZ '2024-01-16 00:00:00', TIMESTAMP_NTZ '2024-01-01 00:00:00'),
        (6, CAST(NULL AS TIMESTAMP_NTZ), TIMESTAMP_NTZ '2024-01-15 11:00:00')
        AS t(id, initial_departure_time, last_check)"""
    )
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    assert rows(flights.due_flights(df, as_of).select("id")) == [(1,), (2,), (4,), (6,)]


def test_refresh_is_idempotent_and_keeps_no_data(spark):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    table = spark.sql(
        """SELECT f AS flight_number, u AS user_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS initial_departure_time,
                  7 AS delay, 'old' AS raw_data, c AS last_check
           FROM VALUES ('A', 1, CAST(NULL AS TIMESTAMP_NTZ)), ('A', 2, TIMESTAMP_NTZ '2024-01-15 11:59:00'),
                       ('B', 1, CAST(NULL AS TIMESTAMP_NTZ)), ('C', 1, CAST(NULL AS TIMESTAMP_NTZ)) AS t(f, u, c)"""
    )
    status = spark.sql(
        """SELECT n AS seq, f AS flight_number, TIMESTAMP_NTZ '2024-01-15 00:00:00' AS observed_at, r AS response_json
           FROM VALUES (1, 'A', '{"data":[{"departure":{"delay":5}}]}'),
                       (2, 'A', '{"data":[{"departure":{"delay":null}},{"departure":{"delay":9}}]}'),
                       (3, 'B', '{"data":[]}') AS t(n, f, r)"""
    )
    once = flights.refresh_flights(table, status, as_of)
    got = rows(once.select("flight_number", "user_id", "delay", F.col("last_check").isNotNull()))
    assert got == [("A", 1, 0, True), ("A", 2, 0, True), ("B", 1, 7, False), ("C", 1, 7, False)]
    assert rows(flights.refresh_flights(once, status, as_of)) == rows(once)


@pytest.mark.parametrize("previous", [None, "previous"])
@pytest.mark.parametrize("kind", ["int", "double"])
def test_entitlements_equal_plain_comparison(spark, previous, kind):
    """Any delay of the type, also the extreme ones, against whole and broken thresholds."""
    rng = random.Random(3)
    ends = [-(2**31), 2**31 - 1, -1500000000, 1500000000, 0, 100, -1]
    one = rng.randint if kind == "int" else lambda a, b: rng.uniform(a, b)
    thresholds = [(float(rng.randint(-50, 300)), f"e{n}") for n in range(40)]
    thresholds += [(100.5, "half"), (100.5, "half"), (-2e9, "low"), (2147483647.0, "top"), (1e300, "never"), (-1e300, "always"), (None, "x")]

    def value():
        return rng.choice([None, *(e if kind == "int" else float(e) for e in ends), *(one(-60, 400) for _ in range(9))])

    delays = [(n, value(), value()) for n in range(150)]
    got = flights.entitlements_by_delay(
        spark.createDataFrame(delays, f"id int, delay {kind}, previous {kind}"),
        spark.createDataFrame(thresholds, "min_delay_minutes double, entitlement string"),
        previous,
    )
    want = [
        (n, d, b, e)
        for n, d, b in delays
        for m, e in thresholds
        if d is not None and m is not None and d >= m and not (previous and b is not None and b >= m)
    ]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_conditions_with_unknown_operators_are_reported(spark):
    conditions = spark.createDataFrame([("r", "k", "=>", "3"), ("r", "k", ">=", "3"), ("q", "k", None, "1")], "rule_id string, fact_key string, op string, operand string")
    assert rows(rules.invalid_conditions(conditions).select("rule_id", "op")) == [("q", None), ("r", "=>")]


HOT_KEY_QUERIES = (
    "rules_matched", "signature_rules", "required_fields_of_case", "missing_fields", "candidate_rules_topk",
    "rule_outcomes", "missing_facts_for_maybe", "escalation_checklist", "parsed_answers", "entitlements_by_delay",
)


def test_small_tables_are_joined_without_hot_keys(spark, sf_dir):
    """With broadcasts off, no rows meet a table on a key of a few values alone."""
    from claimloom import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in HOT_KEY_QUERIES:
            plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            joined = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[(.*?)\]", plan)
            few = {"scenario_type", "grievance_type", "fact_key", "form", "answer_key", "level", "block", "delay", "class"}
            hot = [k for k in joined if {re.sub(r"#\d+L?", "", c).strip() for c in k.split(",")} <= few]
            assert not hot, (name, hot)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_intermediate_results_go_only_where_the_caller_says(spark, tmp_path):
    df = spark.range(3)
    assert materialise(df, "t", None) is df
    back = materialise(df, "t", str(tmp_path))
    assert rows(back) == rows(df) and list(tmp_path.glob("t-*"))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_cluster_writes_where_the_caller_says(spark, tmp_path, monkeypatch, scheme):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:1")
    back = materialise(spark.range(3), "t", f"{scheme}{tmp_path}/")
    assert rows(back) == rows(spark.range(3)) and list(tmp_path.glob("t-*"))


@pytest.mark.parametrize("turns", [5, 2500])
def test_whole_conversations_and_pieces(spark, turns):
    messages = spark.range(turns).selectExpr("'c' AS conv_id", "id + 1500 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t\"', id) AS text")
    whole = op_messages.conversation_requests(messages, [("q", "a")]).collect()
    assert len(whole) == 1 and len(json.loads(whole[0].request)) == turns + 2
    assert op_messages.transcripts(messages).first().transcript.count("\n") == turns - 1
    pieces = op_messages.conversation_requests(messages, [("q", "a")], segment=1000).orderBy("segment").collect()
    assert [json.loads(p.request)[0]["content"] == "q" for p in pieces] == [True] + [False] * (len(pieces) - 1)
    assert sum(len(json.loads(p.request)) for p in pieces) == turns + 2


# ---- messages and dialogue -------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("a: 1\nnothing\n b :2: 3", [("a", "1"), ("b", "2: 3")]),
        ('{"a": 1, "b": "x"}', [("a", "1"), ("b", "x")]),
        ('{"a": 1} trailing: x', [('{"a"', "1} trailing: x")]),
        ('["a: b"]', []), ('"a: b"', []), ("5", []), ("5 hours: x", [("5 hours", "x")]), ("{}", []),
        ("{'a': 1}", [("{'a'", "1}")]),
    ],
)
def test_answer_parsing(spark, text, want):
    df = spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string")
    got = messages.answer_pairs(df).orderBy("pos").select("name", "value").collect()
    assert [tuple(r) for r in got] == want


def test_labels(spark):
    df = spark.createDataFrame(
        [("Delay, or a cancellation",), (" DELAY ",), ("none",), (None,)], "t string"
    )
    got = [tuple(r) for r in df.select(messages.label_in_reply(F.col("t")), messages.exact_label(F.col("t"))).collect()]
    assert got == [
        ("cancellation", "unsupported"), ("delay", "delay"), (None, "unsupported"), (None, "unsupported"),
    ]


@pytest.mark.parametrize(
    "name, description, want",
    [
        ("was_late", "x", "boolean"), ("a", "Yes/No", "boolean"), ("flight", "flight number", "number"),
        ("fare_date", "x", "number"), ("gate_time", "x", "datetime"), ("a", "update", "datetime"), ("a", None, "text"),
    ],
)
def test_field_type(spark, name, description, want):
    df = spark.createDataFrame([(name, description)], "n string, d string")
    assert df.select(messages.field_type(F.col("n"), F.col("d"))).first()[0] == want


def sequential_states(log, fields):
    """The dialogue, one message after another."""
    out = []
    for conv in sorted({c for c, *_ in log}):
        state, kind = "initial", None
        for c, turn, role, text in sorted(log):
            if c != conv or role != "user" or not text.strip():
                continue
            before = state
            if state == "initial":
                low = text.lower()
                kind = next((t for t in ("delay", "downgrade") if t in low), None)
                state = "awaiting_fields" if kind else "initial"
            elif state == "awaiting_fields":
                named = {line.split(":", 1)[0].strip().lower().replace(" ", "_") for line in text.split("\n") if ":" in line}
                state = "completed" if set(fields[kind]) <= named else state
            else:
                state, kind = "initial", None
            out.append((c, turn, before, state, kind))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, fan", [(0, 1000), (1, 1000), (1, 4), (2, 3)])
def test_long_conversation_in_pieces(spark, levels, fan):
    rng = random.Random(levels * 10 + fan)
    fields = {"delay": ["a_b", "c"], "downgrade": ["c"]}
    said = ["a delay", "downgrade!", "hello", "A b: 1\nc: 2", "c: 3", "  ", "a_b: 1"]
    log = [
        (conv, turn, rng.choice(["user", "user", "assistant"]), rng.choice(said))
        for conv, length in ((1, 70), (2, 5), (3, 1))
        for turn in range(length)
    ]
    required = spark.createDataFrame(
        [(t, f, n, True) for t, names in fields.items() for n, f in enumerate(names)]
        + [("cancellation", "x", 0, True), ("denied_boarding", "x", 0, True)],
        "grievance_type string, field_name string, field_order int, is_required boolean",
    )
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string")
    got = dialogue.dialogue_states(df, required, fan=fan)
    want = sequential_states(log, fields)
    assert rows(got) == want
    assert {"initial", "awaiting_fields", "completed"} == {r[3] for r in want}


# ---- letters ---------------------------------------------------------------------


def test_letter_values_are_not_expanded_again(spark):
    form = {c: c for c in letters.FORM_COLUMNS} | {"airline_name": "Air $PNR", "expense_amount": " ₹1,200 "}
    df = spark.createDataFrame([tuple(form.values())], ", ".join(f"{c} string" for c in form))
    filled = letters.parse_forms(df)
    got = letters.letters(filled, "To $AIRLINE_NAME: $PNR $TOTAL_EXPENSES$NOTICE_WINDOW", "re $PNR").first()
    assert got.letter == "To Air $PNR: pnr 1200intimation_time"
    assert got.subject == "re pnr" and got.error is None
    incomplete = letters.letters(df, "$PNR", "$PNR").first()
    assert incomplete.letter is None and "NOTICE_WINDOW, COMPENSATION_TYPE_1" in incomplete.error


@pytest.mark.parametrize("kind, want", [("cancellation", True), ("Denied_Boarding", True), ("delay", False), ("downgrade", False), (None, False)])
def test_letter_available(spark, kind, want):
    df = spark.createDataFrame([(kind,)], "k string")
    assert df.select(letters.letter_available(F.col("k"))).first()[0] is want


# ---- tables ----------------------------------------------------------------------


def test_versions_and_case_runs(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert tables.replace_table(spark.range(3), folder) == 0
    assert tables.replace_table(spark.range(5), folder) == 1
    assert tables.read_table(spark, folder).count() == 5
    assert tables.read_table(spark, folder, 0).count() == 3

    intake = spark.createDataFrame(
        [(1, "s1", "A delay", ), (2, None, "hello"), (3, "s3", 'delay "now"\\')],
        "case_id long, session_id string, user_text string",
    )
    given = spark.createDataFrame([(1, 1, "message", "hours", "4"), (3, 1, "extra", "x", None)], FACTS_DDL)
    required = spark.createDataFrame(REQUIRED, REQUIRED_DDL)
    table = spark.createDataFrame(
        [("r", "delay", "entitlement", "1", "t", "g", "hours 4")],
        "rule_id string, scenario_type string, rule_family string, source_para string, title string, "
        "passenger_gets_text string, retrieval_text string",
    )
    conditions = spark.createDataFrame([("r", "hours", ">=", "3")], "rule_id string, fact_key string, op string, operand string")
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    runs = case_plan.run_cases(intake, given, required, table, conditions, as_of)
    assert rows(runs.select("case_id", "status")) == [(1, "matched"), (2, "unsupported"), (3, "need_more_info")]
    out = str(tmp_path / "runs")
    for batch in ("one", "two", "two"):  # a batch that is stored again does not count twice
        tables.append_case_runs(runs, out, batch)
    stored = tables.read_case_runs(spark, out)
    assert stored.count() == 2 and {r.batch for r in stored.collect()} == {"one", "two"}
    assert json.loads(stored.first().match_json)["applicable_rule_ids"] == ["r"]
    assert json.loads(stored.first().facts_json) == {"hours": "4"}
