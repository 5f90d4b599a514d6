"""Queries whose intermediate results go to a cluster's shared folder that is named by a path alone."""

import pytest

from claimloom import registry

QUERIES = [
    "candidate_rules_topk",
    "case_payload",
    "case_runs",
    "case_runs_by_date",
    "case_signatures",
    "case_status",
    "conversation_history",
    "conversation_state",
    "dialogue_state",
    "entitlement_changes",
    "eval_rules_sql",
    "exact_rule_summary",
    "form_open_present",
    "form_open_strict",
    "known_facts",
    "missing_critical",
    "missing_facts_for_maybe",
    "missing_fields",
    "packed_context",
    "required_fields_of_case",
    "parsed_answers",
    "rule_outcomes",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    made = {
        "events": spark.range(160).selectExpr(
            "id AS event_id", "timestamp_ntz'2024-01-14 00:00:00' + make_dt_interval(0, 0, id * 7) AS ts", "id * 31 % 97 AS user_id",
            "element_at(array('view', 'error', 'buy'), cast(id % 3 + 1 AS int)) AS event_type", "id * 13 % 400 + 0.5D AS value", "concat('{\"k\": ', id, '}') AS props",
        ),
        "part": spark.range(160).selectExpr(
            "if(id < 80, id, id * 4) AS p_partkey", "concat('hot bolt ', id % 9) AS p_name", "concat('Brand#', id % 7) AS p_brand",
            "element_at(array('MEDIUM', 'STANDARD', 'LARGE', 'PROMO', 'SMALL', 'ECONOMY'), cast(id * 5 % 7 % 6 + 1 AS int)) AS p_type", "cast(id * 11 % 50 AS int) AS p_size",
        ),
        "conversations": spark.range(48).selectExpr(
            "id div 6 AS conv_id", "id % 6 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('a delay of ', id, ' hours') AS text"
        ),
        "documents": spark.range(12).selectExpr(
            "id AS doc_id", "'en' AS lang", "concat_ws('\n', transform(sequence(1, 15), k -> concat('line ', k, ' on a refund, delay or facility ', id))) AS text"
        ),
        "region": spark.range(3).selectExpr("cast(id AS int) AS r_regionkey"),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_a_query_goes_on_from_a_folder_named_without_a_scheme(spark, tables, tmp_path, monkeypatch, name):
    get = type(spark.conf).get
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:1")
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *a: str(tmp_path) if key == "spark.checkpoint.dir" else get(conf, key, *a))
    assert registry.queries()[name](spark, tables).take(1) and list(tmp_path.glob("*-*"))
