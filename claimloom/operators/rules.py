"""Deterministic rule evaluation and its renderings.

Conditions: rule_conditions(rule_id, fact_key, op, operand) with op one of
= != < <= > >= in is_true is_false. A condition is true, false or unknown (the fact is
missing, blank or not convertible). A rule is 'non_applicable' when a condition is
false, otherwise 'maybe' when one is unknown or it has none, otherwise 'exact'.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import WHITE_SPACE, numbered
from claimloom.functions.vocabulary import ANY_SCENARIO
from claimloom.operators.joins import spread_join

MATCH_KINDS = ("non_applicable", "maybe", "exact")

# Plain decimal numbers only: casting alone would also take texts like '5d' or 'NaN'.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPACES = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE) + "'"

# What a condition compares, as SQL over texts: the only definition, for columns and for
# the SQL functions alike.
TEXT_SQL = f"lower(btrim({{0}}, {_SPACES}))"
NUMBER_SQL = f"CASE WHEN {{0}} RLIKE r'{NUMBER}' THEN try_cast({{0}} AS DOUBLE) END"
LIST_SQL = f"transform(split({{0}}, ','), part -> btrim(part, {_SPACES}))"
TRUTH_SQL = "CASE WHEN {0} IN ('true', 'yes') THEN true WHEN {0} IN ('false', 'no') THEN false END"
_EQUAL = "coalesce({fact}.number = {c}.number, {fact}.text = {c}.text)"
OPERATORS = {
    "=": _EQUAL,
    "!=": f"NOT {_EQUAL}",
    "<": "{fact}.number < {c}.number",
    "<=": "{fact}.number <= {c}.number",
    ">": "{fact}.number > {c}.number",
    ">=": "{fact}.number >= {c}.number",
    "in": "array_contains({c}.listed, {fact}.text)",
    "is_true": "{fact}.truth",
    "is_false": "NOT {fact}.truth",
}


def holds_sql(c: str, fact: str) -> str:
    """True, false, or NULL when unknown, of a readable condition and fact."""
    arms = " ".join(f"WHEN '{op}' THEN {text.format(c=c, fact=fact)}" for op, text in OPERATORS.items())
    return f"CASE {c}.op {arms} END"


def fact_sql(text: str) -> str:
    """A fact's value read as text, number and truth value; NULL when it is blank."""
    clean = TEXT_SQL.format(text)
    parts = f"'text', {clean}, 'number', {NUMBER_SQL.format(clean)}, 'truth', {TRUTH_SQL.format(clean)}"
    return f"CASE WHEN {clean} <> '' THEN named_struct({parts}) END"


def condition_sql(fact_key: str, op: str, operand: str) -> str:
    """A condition with its operand read the same way."""
    clean = TEXT_SQL.format(operand)
    return (
        f"named_struct('fact_key', {fact_key}, 'op', {op}, 'text', {clean}, "
        f"'number', {NUMBER_SQL.format(clean)}, 'listed', {LIST_SQL.format(clean)})"
    )


def invalid_conditions(conditions: DataFrame) -> DataFrame:
    """Conditions whose op is none of the known ones; they stay unknown for every fact."""
    return conditions.where(F.col("op").isNull() | ~F.col("op").isin(*OPERATORS))


def readable_facts(known: DataFrame) -> DataFrame:
    """Non-blank facts read once: (case_id, fact_key, fact)."""
    read = known.select("case_id", "fact_key", F.expr(fact_sql("value")).alias("fact"))
    return read.where("fact IS NOT NULL")


def _condition_id() -> Column:
    """64 bits that tell distinct conditions apart."""
    parts = [p for c in ("op", "operand") for p in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64("fact_key", *parts)


def _conditions_by_rule(conditions: DataFrame) -> DataFrame:
    """(rule_id, conditions): the distinct ones, each by id and the fact it asks for."""
    own = conditions.select("rule_id", F.struct(_condition_id().alias("id"), "fact_key").alias("condition"))
    return own.groupBy("rule_id").agg(F.sort_array(F.collect_set("condition")).alias("conditions"))


def judged_values(known: DataFrame, conditions: DataFrame) -> DataFrame:
    """(fact_key, text, holding, failing): each distinct value of a fact, judged once by each
    distinct condition on that fact. Ids of the true and of the false ones; others are unknown."""
    distinct = conditions.select("fact_key", "op", "operand").distinct()
    read = distinct.select(
        "fact_key", _condition_id().alias("id"), F.expr(condition_sql("fact_key", "op", "operand")).alias("condition")
    )
    values = readable_facts(known).select("fact_key", F.col("fact.text").alias("text"), "fact").distinct()
    holds = F.expr(holds_sql("condition", "fact"))
    judged = spread_join(values, read, ["fact_key"], "text").select("fact_key", "text", "id", holds.alias("holds"))
    return judged.groupBy("fact_key", "text").agg(
        *(F.collect_list(F.when(F.col("holds") == truth, F.col("id"))).alias(name) for name, truth in _VERDICTS)
    )


_VERDICTS = (("holding", True), ("failing", False))


def judged_cases(known: DataFrame, conditions: DataFrame) -> DataFrame:
    """(case_id, holding, failing): what the conditions say of a case's facts, by their ids."""
    facts = readable_facts(known).select("case_id", "fact_key", F.col("fact.text").alias("text"))
    met = spread_join(facts, judged_values(known, conditions), ["fact_key", "text"], "case_id")
    return met.groupBy("case_id").agg(
        *(F.sort_array(F.flatten(F.collect_list(name))).alias(name) for name, _ in _VERDICTS)
    )


def _with_verdicts(cases: DataFrame, known: DataFrame, conditions: DataFrame) -> DataFrame:
    """cases with their judged conditions; none for a case without facts."""
    none = F.array().cast("array<bigint>")
    joined = cases.join(judged_cases(known, conditions), "case_id", "left")
    return joined.withColumns({name: F.coalesce(name, none) for name, _ in _VERDICTS})


def candidate_outcomes(
    candidates: DataFrame, known: DataFrame, conditions: DataFrame
) -> DataFrame:
    """Three-way outcome of each candidate rule, with the facts still needed.

    (case_id, rule_id, match_kind, missing_facts): missing_facts lists the keys of
    unknown conditions of 'maybe' rules. Rows are cases * top_k throughout, since a rule
    brings the ids of its conditions and a case those that hold and fail for its facts.
    """
    none = F.array().cast("array<string>")
    ids = F.transform("conditions", lambda c: c["id"])
    unknown = F.filter("conditions", lambda c: ~F.array_contains("holding", c["id"]))
    open_keys = F.array_sort(F.array_distinct(F.transform(unknown, lambda c: c["fact_key"])))
    ruled_out = F.coalesce(F.arrays_overlap(ids, "failing"), F.lit(False))
    return (
        _with_verdicts(candidates.select("case_id", "rule_id"), known, conditions)
        .join(_conditions_by_rule(conditions), "rule_id", "left")
        .select(
            "case_id",
            "rule_id",
            F.when(ruled_out, None).otherwise(F.coalesce(open_keys, none)).alias("open"),
            F.col("conditions").isNull().alias("free"),
        )
        .select(
            "case_id",
            "rule_id",
            F.when(F.col("open").isNull(), "non_applicable")
            .when(F.col("free") | (F.size("open") > 0), "maybe")
            .otherwise("exact")
            .alias("match_kind"),
            F.coalesce("open", none).alias("missing_facts"),
        )
    )


def missing_facts_for_maybe(
    outcomes: DataFrame, cases: DataFrame, required: DataFrame
) -> DataFrame:
    """Distinct facts per case that would settle its 'maybe' rules."""
    why = required.select(
        "grievance_type", F.col("field_name").alias("fact_key"), "why_needed"
    )
    needed = (
        outcomes.where("match_kind = 'maybe'")
        .select("case_id", F.explode("missing_facts").alias("fact_key"))
        .distinct()
        .join(cases, "case_id")
    )
    return spread_join(needed, why, ["grievance_type", "fact_key"], "case_id", "left").select(
        "case_id", "fact_key", "why_needed"
    )


def case_signatures(cases: DataFrame, known: DataFrame, conditions: DataFrame) -> DataFrame:
    """(case_id, grievance_type, signature, holding, failing): cases of one type for which the
    same conditions hold and fail have the same rules; the signature is their smallest case_id."""
    own = _with_verdicts(cases.select("case_id", "grievance_type"), known, conditions)
    alike = ["grievance_type", "holding", "failing"]
    firsts = own.groupBy(*alike).agg(F.min("case_id").alias("signature"))
    return own.join(firsts, alike)


def _any_listed(ids: str, listed: str) -> Column:
    """Whether one of the ids is listed: the first few one by one, which is far cheaper than comparing sets."""
    first = (F.coalesce(F.array_contains(listed, F.get(ids, F.lit(n))), F.lit(False)) for n in range(_FEW))
    more = F.arrays_overlap(F.slice(ids, _FEW + 1, F.greatest(F.size(ids), F.lit(1))), listed)
    return reduce(or_, first) | ((F.size(ids) > _FEW) & more)


def _all_listed(ids: str, listed: str) -> Column:
    first = ((F.size(ids) <= n) | F.array_contains(listed, F.get(ids, F.lit(n))) for n in range(_FEW))
    more = F.size(F.array_except(ids, listed)) == 0
    return reduce(and_, first) & ((F.size(ids) <= _FEW) | more)


_FEW = 4

#: Rules of a class that one row lists.
RULES_A_ROW = 256


def _rule_classes(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """(scenario_type, ids, rules): rules of one scenario with the same conditions, by rows of RULES_A_ROW
    in the order in which they are shown."""
    actions = F.col("actions_json") if "actions_json" in rules.columns else F.lit(None)
    ids = F.transform("conditions", lambda c: c["id"])
    by_rule = rules.select("rule_id", "scenario_type").join(_conditions_by_rule(conditions), "rule_id", "left")
    by_rule = by_rule.select("rule_id", "scenario_type", F.coalesce(ids, F.array().cast("array<bigint>")).alias("ids"))
    shown = rules.select(
        "rule_id", "source_para", "title", "passenger_gets_text", actions.cast("string").alias("actions_json"),
        (F.col("rule_family") == "exception").alias("is_exception"),
    )
    alike = Window.partitionBy("scenario_type", "ids").orderBy(F.col("source_para").asc_nulls_first(), "rule_id")
    listed = by_rule.join(shown, "rule_id").withColumn("part", F.floor((F.row_number().over(alike) - 1) / RULES_A_ROW))
    one = F.sort_array(F.collect_list(F.struct("source_para", *(c for c in shown.columns if c != "source_para"))))
    return listed.groupBy("scenario_type", "ids", "part").agg(one.alias("rules")).drop("part")


#: Rows of rules per scenario, the first ones as they are shown, that a bound is taken from.
LEADING = 128


def _nth_shown(firsts: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(signature, nth): the place of the n-th leading rule that matches, where there are as many."""
    by_place = Window.partitionBy("scenario_type").orderBy("best")
    leading = classes.withColumn("at", F.row_number().over(by_place)).where(F.col("at") <= LEADING).drop("at")
    met = spread_join(firsts.hint("merge"), leading, ["scenario_type"], "signature").where(~_any_listed("ids", "failing"))
    places = met.select("signature", F.explode(F.transform(F.slice("rules", 1, n), _place)).alias("nth"))
    in_order = places.withColumn("at", F.row_number().over(Window.partitionBy("signature").orderBy("nth")))
    return in_order.where(F.col("at") == n).drop("at")


def _place(rule: Column) -> Column:
    return F.struct(rule["source_para"].alias("source_para"), rule["rule_id"].alias("rule_id"))


def eval_signatures(
    members: DataFrame, rules: DataFrame, conditions: DataFrame, first: int | None = None
) -> DataFrame:
    """(signature, rule_id, match_kind, ...): rules of the signature's type (and the cross-cutting
    ones) that match exactly or may match, with the columns a rule shows to the passenger.

    Rules of one scenario with the same conditions are one class. A signature meets classes, and
    a meeting compares ids: none of the class's conditions fails, and how many of them hold. The
    class brings its rules. Neither side is broadcast: lists of ids are far larger than their
    files, and the classes are repeated per piece.

    With `first`, rules that cannot be among a signature's first ones in evaluation order are
    left out: behind so many matching rules, only exact ones can still be.
    """
    scenarios = F.explode(F.array_distinct(F.array("grievance_type", F.lit(ANY_SCENARIO))))
    firsts = members.where("case_id = signature").select("signature", "holding", "failing", scenarios.alias("scenario_type"))
    classes = _rule_classes(rules, conditions)
    all_hold = (F.size("ids") > 0) & _all_listed("ids", "holding")
    wanted = F.lit(True)
    if first is not None:
        classes = classes.withColumn("best", _place(F.get("rules", F.lit(0))))
        firsts = firsts.join(_nth_shown(firsts, classes, first), "signature", "left")
        classes = classes.withColumn("rules", F.slice("rules", 1, first))
        wanted = F.col("nth").isNull() | (F.col("best") <= F.col("nth")) | all_hold
    met = spread_join(firsts.hint("merge"), classes, ["scenario_type"], "signature").where(wanted & ~_any_listed("ids", "failing"))
    kind = F.when(all_hold, "exact").otherwise("maybe")
    found = met.select("signature", kind.alias("match_kind"), F.inline("rules"))
    return found.select("signature", "match_kind", "rule_id", *(c for c in found.columns[2:] if c != "rule_id"))


def of_cases(members: DataFrame, rows: DataFrame) -> DataFrame:
    """What has been found of each signature, for each of its cases."""
    own = members.select("case_id", "signature").hint("shuffle_hash")  # the rows lie by signature already
    return own.join(rows, "signature").drop("signature")


def eval_rules(
    cases: DataFrame, known: DataFrame, rules: DataFrame, conditions: DataFrame
) -> DataFrame:
    """Every matching pair of case and rule: eval_signatures for each case."""
    members = case_signatures(cases, known, conditions)
    found = eval_signatures(members, rules, conditions)
    return members.select("case_id", "grievance_type", "signature").join(found, "signature").drop("signature")


def evaluation_order(evaluated: DataFrame, by: str = "case_id") -> DataFrame:
    """Add place: the order in which the rules of a case (or signature) are shown, from 1."""
    order = Window.partitionBy(by).orderBy(
        "match_kind", F.col("source_para").asc_nulls_first(), "rule_id"
    )
    return evaluated.withColumn("place", F.row_number().over(order))


def top_rule_lines(evaluated: DataFrame, n: int = 3, by: str = "case_id") -> DataFrame:
    """The first n rules of a case as numbered lines for a draft."""
    shown = F.concat(
        F.coalesce("title", F.lit("N/A")), F.lit(": "),
        F.coalesce("passenger_gets_text", F.lit("N/A")),
    )
    first = (
        evaluation_order(evaluated, by)
        .where(F.col("place") <= n)
        .select(by, "place", shown.alias("line"))
    )
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    return first.groupBy(by).agg(
        numbered(F.transform(lines, lambda x: x["line"])).alias("rules_text")
    )


def _in_evaluation_order(columns: dict[str, Column], shown: Callable) -> Column:
    """Rules of a case in evaluation order, each turned into what is shown of it."""
    keyed = F.struct(
        "match_kind",
        F.coalesce("source_para", F.lit("")).alias("para"),
        "rule_id",
        *(c.alias(name) for name, c in columns.items()),
    )
    return F.transform(F.sort_array(F.collect_list(keyed)), shown)


def rule_summaries(evaluated: DataFrame, by: str = "case_id") -> DataFrame:
    """(case_id, matched_rules): the evaluated rules of a case (or signature) as one JSON list."""
    object_ddl = "MAP<STRING, STRING>"

    def shown(r):
        actions = F.coalesce(
            F.from_json(r["actions_json"], object_ddl), F.from_json(F.lit("{}"), object_ddl)
        )
        return F.struct(
            r["rule_id"].alias("rule_id"),
            r["title"].alias("title"),
            F.coalesce(r["match_kind"], F.lit("unknown")).alias("match_kind"),
            r["passenger_gets"].alias("passenger_gets"),
            r["source"].alias("source"),
            actions.alias("actions"),
        )

    columns = {
        "title": F.coalesce("title", F.lit("N/A")),
        "passenger_gets": F.coalesce("passenger_gets_text", F.lit("Not specified")),
        "source": F.coalesce("source_para", F.lit("N/A")),
        "actions_json": F.col("actions_json"),
    }
    return evaluated.groupBy(by).agg(
        F.to_json(_in_evaluation_order(columns, shown)).alias("matched_rules")
    )


def exact_rule_summary(evaluated: DataFrame, by: str = "case_id") -> DataFrame:
    """(case_id, summary): numbered title and benefit of each exactly matching rule."""
    columns = {
        "title": F.coalesce("title", F.lit("N/A")),
        "gets": F.coalesce("passenger_gets_text", F.lit("Not specified")),
    }

    def shown(r, i):
        number = (i + 1).cast("string")
        return F.concat(
            F.lit("**"), number, F.lit(". "), r["title"], F.lit("**\n   "), r["gets"], F.lit("\n\n")
        )

    return (
        evaluated.where("match_kind = 'exact'")
        .groupBy(by)
        .agg(F.array_join(_in_evaluation_order(columns, shown), "").alias("summary"))
    )
