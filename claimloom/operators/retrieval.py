"""Retrieval of candidate rules for every case at once.

Score of a rule for a case: tokens shared by the rule's retrieval text and the case
(type, fact keys and values) plus 2 when the rule's scenario is the case's type.
Candidates are the rules of the case's type and the cross-cutting ones; the first
top_k by (score desc, source_para, rule_id) are kept.

Comparing every case with every rule would be a product. Two facts give the exact
same result with far less work:

* Rules of one scenario that contain the same case tokens (a *class*) score alike for
  every case, so only the first top_k of a class, by (source_para, rule_id), can be
  kept. Copies of a rule collapse. The class is named after its first rule.
* A rule that shares no fact token with a case has a score that depends on the case's
  type alone. Whatever stands before it in the type's own ranking also stands before
  it for the case, so only the first top_k classes of that ranking matter. All others
  come from an equi-join of fact tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import tokens
from claimloom.functions.vocabulary import ANY_SCENARIO
from claimloom.operators.joins import spread_join
from claimloom.session import materialise

TOP_K = 12
SAME_SCENARIO_BOOST = 2


def rule_tokens(rules: DataFrame) -> DataFrame:
    return rules.select(
        "rule_id", "scenario_type", F.explode(tokens(F.col("retrieval_text"))).alias("token")
    )


def _scenarios(grievance_type: str = "grievance_type") -> Column:
    return F.explode(F.array_distinct(F.array(F.col(grievance_type), F.lit(ANY_SCENARIO))))


def _boost() -> Column:
    return F.when(
        F.col("scenario_type") == F.col("grievance_type"), SAME_SCENARIO_BOOST
    ).otherwise(0)


def _para() -> Column:
    return F.coalesce(F.col("source_para"), F.lit(""))


def case_tokens(known: DataFrame) -> DataFrame:
    """Distinct (case_id, grievance_type, token) of fact keys and values, without the
    tokens of the type itself. A missing value reads 'None', as Python prints it."""
    text = F.concat_ws(" ", "fact_key", F.coalesce("value", F.lit("None")))
    return known.select(
        "case_id",
        "grievance_type",
        F.explode(F.array_except(tokens(text), tokens(F.col("grievance_type")))).alias("token"),
    ).distinct()


def _all_pairs(cases: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every candidate of every case: the result itself is the full pairing."""
    pairs = cases.select("case_id", "grievance_type", _scenarios().alias("scenario_type")).join(
        rules.select("scenario_type", "rule_id", _para().alias("para"), "retrieval_text"),
        "scenario_type",
    )
    fact_hits = (
        facts.select("case_id", "token", _scenarios().alias("scenario_type"))
        .join(rule_tokens(rules), ["scenario_type", "token"])
        .groupBy("case_id", "rule_id")
        .agg(F.count("*").alias("overlap"))
    )
    type_hits = F.size(
        F.array_intersect(tokens(F.col("grievance_type")), tokens(F.col("retrieval_text")))
    )
    return (
        pairs.withColumn("base", _boost() + type_hits)
        .join(fact_hits, ["case_id", "rule_id"], "left")
        .select(
            "case_id", "grievance_type", "rule_id", "para",
            (F.col("base") + F.coalesce("overlap", F.lit(0))).alias("score"),
        )
    )


def _top_pairs(
    cases: DataFrame, facts: DataFrame, rules: DataFrame, top_k: int, folder: str | None
) -> DataFrame:
    types = cases.select("grievance_type").distinct()
    vocabulary = (
        facts.select("token")
        .union(types.select(F.explode(tokens(F.col("grievance_type")))))
        .distinct()
    )

    # classes: scenario and set of case tokens; members: their first top_k rules
    signatures = (
        rule_tokens(rules)
        .join(vocabulary, "token", "left_semi")
        .groupBy("rule_id")
        .agg(F.sort_array(F.collect_set("token")).alias("signature"))
    )
    in_class = Window.partitionBy("scenario_type", "signature").orderBy("para", "rule_id")
    members = (
        rules.select("rule_id", "scenario_type", _para().alias("para"))
        .join(signatures, "rule_id", "left")
        .withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))
        .withColumn("place", F.row_number().over(in_class))
        .where(F.col("place") <= top_k)
        .groupBy("scenario_type", "signature")
        .agg(F.sort_array(F.collect_list(F.struct("para", "rule_id"))).alias("members"))
        .withColumn("first", F.element_at("members", 1))
    )
    members = materialise(members, "rule_classes", folder)

    # score of a class for a type, before facts are looked at
    type_tokens = tokens(F.col("grievance_type"))
    classes = (
        types.select("grievance_type", _scenarios().alias("scenario_type"))
        .join(members, "scenario_type")
        .select(
            "grievance_type",
            "first",
            (_boost() + F.size(F.array_intersect(type_tokens, "signature"))).alias("base"),
            F.array_except("signature", type_tokens).alias("fact_tokens"),
        )
    )
    classes = materialise(classes, "type_classes", folder)
    by_base = Window.partitionBy("grievance_type").orderBy(F.desc("base"), "first")
    leading = (
        classes.withColumn("place", F.row_number().over(by_base))
        .where(F.col("place") <= top_k)
        .select("grievance_type", "first", "base")
    )
    postings = classes.select(
        "grievance_type", F.explode("fact_tokens").alias("token"), "first", "base"
    )

    by_token = facts.join(postings, ["grievance_type", "token"]).select(
        "case_id", "grievance_type", "first", "base", F.lit(1).alias("hit")
    )
    by_type = spread_join(cases, leading, ["grievance_type"], "case_id").select(
        "case_id", "grievance_type", "first", "base", F.lit(0).alias("hit")
    )
    scored = (
        by_token.union(by_type)
        .groupBy("case_id", "grievance_type", "first", "base")
        .agg(F.sum("hit").alias("overlap"))
        .withColumn("score", F.col("base") + F.col("overlap"))
    )

    # a rule among the first top_k belongs to one of the first top_k classes
    in_case = Window.partitionBy("case_id", "grievance_type").orderBy(F.desc("score"), "first")
    kept = scored.withColumn("place", F.row_number().over(in_case)).where(
        F.col("place") <= top_k
    )
    return (
        kept.join(members.select("first", "members"), "first")
        .select("case_id", "grievance_type", "score", F.explode("members").alias("rule"))
        .select("case_id", "grievance_type", "rule.rule_id", "rule.para", "score")
    )


def _alike(cases: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, grievance_type, asked): the tokens of a case that some rule contains."""
    vocabulary = rule_tokens(rules).select("token").distinct()
    asked = (
        case_tokens(known)
        .join(vocabulary, "token", "left_semi")
        .groupBy("case_id", "grievance_type")
        .agg(F.sort_array(F.collect_set("token")).alias("asked"))
    )
    none = F.array().cast("array<string>")
    return cases.join(asked, ["case_id", "grievance_type"], "left").withColumn("asked", F.coalesce("asked", none))


def candidate_rules(
    cases: DataFrame,
    known: DataFrame,
    rules: DataFrame,
    top_k: int | None = TOP_K,
    folder: str | None = None,
) -> DataFrame:
    """(case_id, grievance_type, rank, rule_id, score); top_k None or <= 0 keeps all.

    Cases of one type that ask with the same tokens get the same rules, so only the first
    of them is ranked. `folder` takes intermediate results (see session.materialise).
    """
    own = materialise(_alike(cases.select("case_id", "grievance_type"), known, rules), "asked", folder)
    alike = own.groupBy("grievance_type", "asked").agg(F.min("case_id").alias("first"))
    firsts = alike.select(F.col("first").alias("case_id"), "grievance_type")
    facts = alike.select(F.col("first").alias("case_id"), "grievance_type", F.explode("asked").alias("token"))
    keep_all = top_k is None or top_k <= 0
    pairs = (
        _all_pairs(firsts, facts, rules) if keep_all else _top_pairs(firsts, facts, rules, top_k, folder)
    )
    order = Window.partitionBy("case_id", "grievance_type").orderBy(
        F.desc("score"), "para", "rule_id"
    )
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    if not keep_all:
        ranked = ranked.where(F.col("rank") <= top_k)
    ranked = ranked.select(
        F.col("case_id").alias("first"), "rank", "rule_id", F.col("score").cast("int").alias("score")
    )
    takers = own.join(alike, ["grievance_type", "asked"]).select("case_id", "grievance_type", "first")
    return takers.join(ranked, "first").drop("first")


def case_payloads(
    cases: DataFrame,
    known: DataFrame,
    required: DataFrame,
    candidates: DataFrame,
    rules: DataFrame,
) -> DataFrame:
    """(case_id, payload): one JSON text per case with its type, facts, required fields
    and candidate rules in rank order, ready for a matching model."""
    facts = facts_as_map(known)
    fields = required.groupBy("grievance_type").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "field_order", "field_name", "field_description", "importance",
                    "is_required", "why_needed",
                )
            )
        ).alias("required_fields")
    )
    rule = F.struct(
        "rank", "rule_id", "title", "source_para", "scenario_type", "rule_family",
        "applies_when_text", "does_not_apply_when_text", "passenger_gets_text",
        "references_json", "keywords_json",
    )
    packed = (
        candidates.drop("grievance_type")
        .join(rules, "rule_id")
        .groupBy("case_id")
        .agg(F.sort_array(F.collect_list(rule)).alias("candidate_rules"))
    )
    references = "ARRAY<STRUCT<ref_text: STRING, purpose: STRING>>"

    def public_rule(r):
        def listed(name, ddl):
            return F.coalesce(F.from_json(r[name], ddl), F.from_json(F.lit("[]"), ddl))

        return F.struct(
            *(
                r[c].alias(c)
                for c in (
                    "rule_id", "title", "source_para", "scenario_type", "rule_family",
                    "applies_when_text", "does_not_apply_when_text", "passenger_gets_text",
                )
            ),
            listed("references_json", references).alias("references"),
            listed("keywords_json", "ARRAY<STRING>").alias("candidate_keywords"),
        )

    def public_field(f):
        return f.dropFields("field_order")

    payload = F.struct(
        "grievance_type",
        F.coalesce("facts", F.from_json(F.lit("{}"), "MAP<STRING, STRING>")).alias("facts"),
        F.coalesce(F.transform("required_fields", public_field), F.array()).alias("required_fields"),
        F.coalesce(F.transform("candidate_rules", public_rule), F.array()).alias("candidate_rules"),
    )
    return (
        cases.join(facts, "case_id", "left")
        .join(packed, "case_id", "left")
        .transform(lambda found: spread_join(found, fields, ["grievance_type"], "case_id", "left"))
        .select("case_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
    )


def facts_as_map(known: DataFrame) -> DataFrame:
    """(case_id, facts): one entry per known key, in key order."""
    return known.groupBy("case_id").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("fact_key", "value")))
        ).alias("facts")
    )
