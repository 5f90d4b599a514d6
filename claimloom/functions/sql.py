"""SQL functions for people who write SQL rather than DataFrame code."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimloom.functions.vocabulary import ANY_SCENARIO
from claimloom.operators.rules import condition_sql, fact_sql, holds_sql

_EVAL = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(grievance STRING, given_json STRING)
RETURNS TABLE (rule_id STRING, match_kind STRING, source_para STRING, title STRING,
               passenger_gets_text STRING, actions_json STRING)
RETURN
  WITH checked AS (
    SELECT r.rule_id, r.source_para, r.title, r.passenger_gets_text, {actions} AS actions_json,
           claim_condition_code(
             c.fact_key, c.op, c.operand,
             try_element_at(from_json(given_json, 'MAP<STRING, STRING>'), c.fact_key)
           ) AS one
    FROM (SELECT explode(array_distinct(array(grievance, '{any_scenario}'))) AS scenario) s
    JOIN {rules} r ON r.scenario_type = s.scenario
    LEFT JOIN {conditions} c ON c.rule_id = r.rule_id
  ), rule_codes AS (
    SELECT rule_id, source_para, title, passenger_gets_text, actions_json, min(one) AS code
    FROM checked GROUP BY rule_id, source_para, title, passenger_gets_text, actions_json
  )
  SELECT rule_id, CASE code WHEN 2 THEN 'exact' ELSE 'maybe' END, source_para, title,
         passenger_gets_text, actions_json
  FROM rule_codes WHERE code > 0
"""

# 0 false, 1 unknown, 2 true; the comparison is the one of operators.rules
_CONDITION_CODE = f"""
CREATE OR REPLACE TEMPORARY FUNCTION claim_condition_code(fact_key STRING, op STRING, operand STRING, given STRING)
RETURNS INT
RETURN (
  SELECT coalesce(CAST({holds_sql("c", "f")} AS INT) * 2, 1)
  FROM (SELECT {condition_sql("fact_key", "op", "operand")} AS c, {fact_sql("given")} AS f)
)
"""


def register_eval_rules(
    spark: SparkSession, rules: str, conditions: str, name: str = "eval_rules_det"
) -> None:
    """A table function `eval_rules_det(grievance_type, values_json)` over two tables.

    Its body is SQL, so a call is planned together with the query around it; joined
    laterally it serves a table of cases, though operators.rules.eval_rules reads facts and
    conditions only once for that. actions_json is NULL where the rules have none.
    """
    actions = "r.actions_json" if "actions_json" in spark.table(rules).columns else "CAST(NULL AS STRING)"
    spark.sql(_CONDITION_CODE)
    spark.sql(_EVAL.format(name=name, rules=rules, conditions=conditions, actions=actions, any_scenario=ANY_SCENARIO))


def register_ai_extract(
    spark: SparkSession,
    extractor: Callable[[str, dict, dict], dict],
    name: str = "ai_extract",
) -> None:
    """A function `ai_extract(value, schema_json, options)` giving JSON text
    {"error_message", "response"}; apply parse_json(...) to address it by path."""

    def run(value: pd.Series, schema: pd.Series, options: pd.Series) -> pd.Series:
        schemas = {text: json.loads(text) for text in schema.unique()}

        def one(text, schema_json, given):
            try:
                response = extractor(text, schemas[schema_json], dict(given or {}))
                return json.dumps({"error_message": None, "response": response}, ensure_ascii=False)
            except ValueError as error:
                return json.dumps({"error_message": str(error), "response": None})

        return pd.Series([one(*row) for row in zip(value, schema, options)])

    spark.udf.register(name, F.pandas_udf(run, "string"))
