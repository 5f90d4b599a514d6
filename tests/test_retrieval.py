"""Retrieval: worked cases, and agreement with set algebra in SQL."""

import random

import duckdb
import pytest

from claimloom.operators import retrieval

CASES = "case_id long, grievance_type string"
KNOWN = "case_id long, grievance_type string, fact_key string, value string"
RULES = "rule_id string, scenario_type string, source_para string, retrieval_text string"


def found(spark, cases, known, rules, k):
    kinds = dict(cases)
    rows = retrieval.candidate_rules(
        spark.createDataFrame(cases, CASES),
        spark.createDataFrame([(c, kinds[c], a, b) for c, a, b in known], KNOWN),
        spark.createDataFrame(rules, RULES),
        k,
    ).collect()
    return sorted((r.case_id, r.rank, r.rule_id, r.score) for r in rows)


def test_worked_cases(spark):
    rules = [
        ("a", "delay", "2", "delay of 4 hours"),
        ("b", "delay", "1", "meals"),
        ("c", "cross_cutting", None, "fact_1 and 4"),
        ("d", "downgrade", "0", "delay 4 hours fact_1"),
        ("e", "delay", "1", "meals"),
    ]
    known = [(1, "fact_1", "4"), (3, "fact_1", "4")]
    got = found(spark, [(1, "delay"), (2, "delay"), (3, "delay"), (4, "strike")], known, rules, 3)
    # two for the type; a shares 'delay' and '4', c shares 'fact_1' and '4'; ties by paragraph
    by_case = {c: [r[1:] for r in got if r[0] == c] for c in (1, 2, 3, 4)}
    assert by_case[1] == by_case[3] == [(1, "a", 4), (2, "c", 2), (3, "b", 2)]
    assert by_case[2] == [(1, "a", 3), (2, "b", 2), (3, "e", 2)]
    assert by_case[4] == [(1, "c", 0)]  # only rules for every type


def by_sql(cases, known, rules, k):
    con = duckdb.connect()
    con.execute("CREATE TABLE cases(case_id BIGINT, kind TEXT)")
    con.execute("CREATE TABLE known(case_id BIGINT, key TEXT, value TEXT)")
    con.execute("CREATE TABLE rules(rule_id TEXT, scenario TEXT, para TEXT, words TEXT)")
    for table, rows in (("cases", cases), ("known", known), ("rules", rules)):
        for row in rows:
            con.execute(f"INSERT INTO {table} VALUES ({', '.join('?' * len(row))})", list(row))
    words = "SELECT {0}, unnest(regexp_extract_all(lower({1}), '[a-z0-9_.]+')) AS word FROM {2}"
    return con.execute(f"""
        WITH asks AS (
            {words.format("case_id", "kind", "cases")} UNION {words.format("case_id", "key", "known")}
            UNION {words.format("case_id", "coalesce(value, 'None')", "known")}
        ), holds AS (SELECT DISTINCT * FROM ({words.format("rule_id", "words", "rules")})),
        shared AS (SELECT case_id, rule_id, count(*) AS n FROM asks JOIN holds USING (word) GROUP BY ALL),
        points AS (
            SELECT c.case_id, r.rule_id, coalesce(r.para, '') AS para,
                   coalesce(s.n, 0) + CASE WHEN r.scenario = c.kind THEN 2 ELSE 0 END AS score
            FROM cases c JOIN rules r ON r.scenario IN (c.kind, 'cross_cutting')
            LEFT JOIN shared s ON s.case_id = c.case_id AND s.rule_id = r.rule_id
        ), places AS (
            SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, para, rule_id) AS place FROM points
        )
        SELECT case_id, place, rule_id, score FROM places {f"WHERE place <= {k}" if k and k > 0 else ""} ORDER BY 1, 2
    """).fetchall()


@pytest.mark.parametrize("k, seed", [(1, 1), (3, 2), (12, 3), (12, 4), (None, 5), (0, 6)])
def test_same_as_set_algebra(spark, k, seed):
    rng = random.Random(seed)
    kinds = ["delay", "denied_boarding", "cancellation", "strike"]
    words = "delay 4 hours. hours refund yes meal denied_boarding fact_1 None 7 hotel".split()
    # many copies, so that classes hold more than k rules; many cases alike
    rules = [
        (f"r{n}", rng.choice(kinds[:3] + ["cross_cutting"]), rng.choice([None, "", "1.10", "1.2", "3"]), " ".join(rng.choices(words, k=rng.randint(0, 3))))
        for n in range(120)
    ]
    cases = [(n, rng.choice(kinds)) for n in range(40)]
    known = [(c, f"fact_{f}", rng.choice(words + [None, " ", "4 hours."])) for c, _ in cases for f in rng.sample(range(5), rng.randint(0, 4))]
    assert found(spark, cases, known, rules, k) == by_sql(cases, known, rules, k)
