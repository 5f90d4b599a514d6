"""Every operator as a query over the given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixtures as fx
from claimloom import samples
from claimloom.functions import sql as sql_functions
from claimloom.operators import (
    dialogue,
    envelope,
    facts,
    flights,
    gold,
    letters,
    messages,
    retrieval,
    rules,
    sections,
)
from claimloom.plans import cases as case_plan
from claimloom.plans import refresh as refresh_plan
from claimloom.plans import regulations
from claimloom.session import materialise, pin_semantics
from claimloom.sources import extraction, silver, snapshots, tables

def as_of() -> Column:
    """The clock of every query."""
    return F.lit(fx.AS_OF).cast("timestamp_ntz")


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


class Inputs:
    """The fixture views and what is derived from them, built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_semantics(spark)
        self.sf_dir = sf_dir
        # where shared intermediate results go, if the session names a folder
        self.folder = spark.conf.get("spark.checkpoint.dir", None)

    def new_folder(self, name: str) -> str:
        """A folder for tables that a query writes and reads back."""
        return f"{self.folder or tempfile.mkdtemp(prefix='claimloom-')}/{name}-{uuid.uuid4().hex}"

    def view(self, name: str) -> DataFrame:
        return fx.view(self.spark, self.sf_dir, name)

    @property
    def documents(self) -> DataFrame:
        return fx.regulation_documents(self.spark, self.sf_dir)

    @property
    def envelopes(self) -> DataFrame:
        return fx.packed_envelopes(self.spark, self.sf_dir)

    def required_query(self) -> DataFrame:
        return gold.required_fields(self.view("fx_required_raw"))

    def rules_query(self) -> DataFrame:
        raw = self.view("fx_rules_raw")
        reference = F.array(F.struct("ref_text"))
        words = F.array("keyword", F.lit("all"))
        return gold.rules(
            raw.withColumn(
                "references_json", F.when(F.col("ref_text").isNotNull(), F.to_json(reference))
            ).withColumn("keywords_json", F.when(F.col("keyword").isNotNull(), F.to_json(words)))
        )

    # gold tables are written once and then read, as in a real pipeline

    @cached_property
    def required(self) -> DataFrame:
        return materialise(self.required_query(), "required_fields", self.folder)

    @cached_property
    def rules(self) -> DataFrame:
        return materialise(self.rules_query(), "rules", self.folder)

    @cached_property
    def cases(self) -> DataFrame:
        return self.view("fx_cases")

    @cached_property
    def facts(self) -> DataFrame:
        return self.view("fx_facts_raw")

    @cached_property
    def conditions(self) -> DataFrame:
        return self.view("fx_conditions")

    @cached_property
    def known(self) -> DataFrame:
        return facts.known_facts(self.cases, self.facts, self.required)

    @cached_property
    def missing(self) -> DataFrame:
        return facts.missing_fields(self.cases, self.known, self.required)

    @cached_property
    def candidates(self) -> DataFrame:
        return retrieval.candidate_rules(self.cases, self.known, self.rules, folder=self.folder)

    @cached_property
    def outcomes(self) -> DataFrame:
        return rules.candidate_outcomes(self.candidates, self.known, self.conditions)

    @cached_property
    def with_actions(self) -> DataFrame:
        return self.rules.withColumn(
            "actions_json",
            F.when(F.col("scenario_type") == "delay", '{"next":"wait","fee":"0"}').when(
                F.col("scenario_type") == "cross_cutting", "{broken"
            ),
        )

    @cached_property
    def alike(self) -> DataFrame:
        found = rules.case_signatures(self.cases, self.known, self.conditions)
        return materialise(found, "case_signatures", self.folder)

    @cached_property
    def evaluated(self) -> DataFrame:
        """Rules by signature; a case's rules are those of its signature."""
        return rules.eval_signatures(self.alike, self.with_actions, self.conditions)

    @cached_property
    def sections(self) -> DataFrame:
        return sections.sections(self.documents)

    @cached_property
    def messages(self) -> DataFrame:
        return self.view("fx_messages")

    @cached_property
    def states(self) -> DataFrame:
        return dialogue.dialogue_states(self.messages, self.required, folder=self.folder)


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- gold tables -----------------------------------------------------------------


@query
def required_fields(i: Inputs) -> DataFrame:
    return i.required_query()


@query
def required_fields_preview(i: Inputs) -> DataFrame:
    return gold.required_fields_preview(i.required_query()).select(
        "grievance_type", "field_order", "field_name", "importance"
    )


@query
def rules_all(i: Inputs) -> DataFrame:
    return i.rules_query()


@query
def rules_preview(i: Inputs) -> DataFrame:
    return gold.rules_preview(i.rules_query())


@query
def rule_counts(i: Inputs) -> DataFrame:
    return gold.rule_counts(i.rules_query())


# ---- extraction results ----------------------------------------------------------


@query
def envelope_errors(i: Inputs) -> DataFrame:
    decoded = envelope.decode_envelopes(i.envelopes)
    return decoded.select(
        "path",
        "error_message",
        F.col("resp.document_id").alias("document_id"),
        F.size("resp.rules").alias("n_rules"),
    )


def _stored_extractions(i: Inputs) -> DataFrame:
    folder = i.new_folder("extractions")
    silver.write_extractions(i.envelopes, folder)
    return silver.read_extractions(i.spark, folder)


@query
def stored_envelopes(i: Inputs) -> DataFrame:
    """Results stored as VARIANT and addressed by path."""
    return _stored_extractions(i).select(
        "path",
        silver.at("$.error_message").alias("error_message"),
        silver.at("$.response.document_id").alias("document_id"),
        F.size(silver.at("$.response.rules", "array<variant>")).alias("n_rules"),
    )


@query
def stored_rules(i: Inputs) -> DataFrame:
    """The rules table from stored results."""
    return regulations.gold_tables(_stored_extractions(i))[1]


@query
def envelope_required(i: Inputs) -> DataFrame:
    return regulations.gold_tables(i.envelopes)[0]


@query
def envelope_rules(i: Inputs) -> DataFrame:
    return regulations.gold_tables(i.envelopes)[1]


@query
def tolerant_decode(i: Inputs) -> DataFrame:
    keywords = envelope.json_list_or_empty(F.col("keywords_json"))
    actions = envelope.json_object_or_empty(F.col("actions_json"))
    return i.view("fx_tolerant_json").select(
        "event_id",
        F.array_join(keywords, "+").alias("keywords"),
        F.size(keywords).alias("n_keywords"),
        F.try_element_at(actions, F.lit("k")).alias("k"),
        F.size(actions).alias("n_actions"),
    )


def numbered_rules(texts: pd.Series) -> list[dict | str]:
    """A small extractor over a batch: one rule per line 'Section x.y: title', or what is wrong."""
    found = texts.str.extractall(r"(?m)^Section (?P<para>\d+\.\d+): (?P<title>.+)$")
    rules = found.assign(rule_id="s" + found["para"]).rename(columns={"para": "source_para"})
    by_text = {k: g.to_dict("records") for k, g in rules.groupby(level=0)}
    return [{"rules": by_text[k]} if k in by_text else "no numbered section" for k in texts.index]


@query
def extracted_documents(i: Inputs) -> DataFrame:
    documents = i.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("parsed"),
    )
    decoded = envelope.decode_envelopes(extraction.extract_documents(documents, numbered_rules))
    return decoded.select(
        "path",
        "error_message",
        F.array_join(F.transform("resp.rules", lambda r: r["rule_id"]), ",").alias("rule_ids"),
    )


# ---- facts -----------------------------------------------------------------------


@query
def required_fields_of_case(i: Inputs) -> DataFrame:
    return facts.required_fields_of_cases(i.cases, i.required).select(
        "case_id", "grievance_type", "field_name", "field_order", "is_required"
    )


@query
def allowed_facts(i: Inputs) -> DataFrame:
    return facts.allowed_facts(i.cases, i.facts, i.required)


@query
def known_facts(i: Inputs) -> DataFrame:
    return i.known


@query
def missing_fields(i: Inputs) -> DataFrame:
    return i.missing


@query
def missing_critical(i: Inputs) -> DataFrame:
    return facts.missing_fields(i.cases, i.known, i.required, only_critical=True).select(
        "case_id", "field_name", "field_order"
    )


def _form_answers(i: Inputs) -> DataFrame:
    return i.facts.where("origin = 'extra'").select("case_id", "fact_key", "value")


@query
def form_open_strict(i: Inputs) -> DataFrame:
    return facts.unanswered_fields(_form_answers(i), i.cases, i.required, strict=True).select(
        "case_id", "field_name"
    )


@query
def form_open_present(i: Inputs) -> DataFrame:
    return facts.unanswered_fields(_form_answers(i), i.cases, i.required, strict=False).select(
        "case_id", "field_name"
    )


@query
def case_status(i: Inputs) -> DataFrame:
    status = facts.case_status(i.cases, i.missing)
    return status.withColumns({c: F.array_join(c, ",") for c in ("missing_fields", "missing_critical_fields")})


# ---- retrieval -------------------------------------------------------------------


@query
def rule_tokens(i: Inputs) -> DataFrame:
    return retrieval.rule_tokens(i.rules_query())


@query
def candidate_rules_topk(i: Inputs) -> DataFrame:
    return i.candidates


@query
def case_payload(i: Inputs) -> DataFrame:
    return retrieval.case_payloads(i.cases, i.known, i.required, i.candidates, i.rules)


# ---- rule evaluation -------------------------------------------------------------


@query
def rule_outcomes(i: Inputs) -> DataFrame:
    return i.outcomes.select(
        "case_id", "rule_id", "match_kind", F.array_join("missing_facts", ",").alias("missing_facts")
    )


@query
def missing_facts_for_maybe(i: Inputs) -> DataFrame:
    return rules.missing_facts_for_maybe(i.outcomes, i.cases, i.required)


@query
def case_signatures(i: Inputs) -> DataFrame:
    return i.alike.select("case_id", "grievance_type", "signature")


@query
def signature_rules(i: Inputs) -> DataFrame:
    return i.evaluated.select("signature", "rule_id", "match_kind")


@query
def rules_matched(i: Inputs) -> DataFrame:
    return rules.eval_rules(i.cases, i.known, i.with_actions, i.conditions)


@query
def rules_in_order(i: Inputs) -> DataFrame:
    ordered = rules.evaluation_order(i.evaluated, "signature")
    return rules.of_cases(i.alike, ordered.select("signature", "place", "rule_id", "match_kind"))


@query
def invalid_conditions(i: Inputs) -> DataFrame:
    return rules.invalid_conditions(i.conditions)


@query
def eval_rules_sql(i: Inputs) -> DataFrame:
    """The SQL table function, joined laterally to the cases and their facts."""
    given = i.cases.join(retrieval.facts_as_map(i.known), "case_id", "left").select(
        "case_id", "grievance_type", F.to_json(F.coalesce("facts", F.create_map().cast("map<string,string>"))).alias("given")
    )
    names = {"claimloom_rules": i.with_actions, "claimloom_conditions": i.conditions, "claimloom_given": given}
    for name, df in names.items():
        df.createOrReplaceTempView(name)
    sql_functions.register_eval_rules(i.spark, "claimloom_rules", "claimloom_conditions", "claimloom_eval_rules")
    return i.spark.sql(
        "SELECT g.case_id, r.* FROM claimloom_given g, LATERAL claimloom_eval_rules(g.grievance_type, g.given) r"
    )


@query
def top3_rule_lines(i: Inputs) -> DataFrame:
    evaluated = rules.eval_signatures(i.alike, i.with_actions, i.conditions, first=3)
    return rules.of_cases(i.alike, rules.top_rule_lines(evaluated, 3, by="signature"))


@query
def rule_summaries(i: Inputs) -> DataFrame:
    return rules.of_cases(i.alike, rules.rule_summaries(i.evaluated, by="signature"))


@query
def exact_rule_summary(i: Inputs) -> DataFrame:
    return rules.of_cases(i.alike, rules.exact_rule_summary(i.evaluated, by="signature"))


# ---- flights ---------------------------------------------------------------------


@query
def due_flights(i: Inputs) -> DataFrame:
    return flights.due_flights(i.view("fx_flights"), as_of())


@query
def latest_status(i: Inputs) -> DataFrame:
    return flights.latest_status(i.view("fx_status"))


@query
def status_decoded(i: Inputs) -> DataFrame:
    return flights.decode_status(i.view("fx_status")).select(
        "seq", "flight_number", "outcome", "new_delay"
    )


@query
def flights_refreshed(i: Inputs) -> DataFrame:
    return flights.refresh_flights(i.view("fx_flights"), i.view("fx_status"), as_of())


@query
def refresh_log(i: Inputs) -> DataFrame:
    return refresh_plan.refresh(i.view("fx_flights"), i.view("fx_status"), as_of())[1]


@query
def refresh_summary(i: Inputs) -> DataFrame:
    return flights.refresh_summary(refresh_log(i))


@query
def entitlements_by_delay(i: Inputs) -> DataFrame:
    tracked = i.view("fx_flights").select("row_id", "flight_number", "user_id", "delay")
    return flights.entitlements_by_delay(tracked, i.view("fx_thresholds"))


@query
def entitlement_changes(i: Inputs) -> DataFrame:
    return flights.entitlement_changes(i.view("fx_status"), i.view("fx_thresholds"), i.folder)


# ---- regulation text -------------------------------------------------------------


@query
def page_documents(i: Inputs) -> DataFrame:
    return sections.documents_from_pages(i.view("fx_pages"))


@query
def section_headers(i: Inputs) -> DataFrame:
    return sections.section_headers(i.documents)


@query
def document_sections(i: Inputs) -> DataFrame:
    return i.sections


@query
def section_overview(i: Inputs) -> DataFrame:
    return sections.section_overview(i.sections)


@query
def section_scores(i: Inputs) -> DataFrame:
    return sections.section_scores(i.view("fx_queries"), i.sections)


@query
def packed_context(i: Inputs) -> DataFrame:
    written = materialise(i.sections, "sections", i.folder)
    return sections.packed_contexts(i.view("fx_queries"), written)


# ---- messages --------------------------------------------------------------------


@query
def message_labels(i: Inputs) -> DataFrame:
    return i.view("fx_replies").select(
        "conv_id",
        "turn",
        messages.label_in_reply(F.col("reply")).alias("reply_label"),
        messages.exact_label(F.col("reply")).alias("exact_label"),
        messages.classify_by_keywords(F.col("text")).alias("keyword_label"),
    )


def shouting_model(texts):
    """Stands for a remote classifier in the query below."""
    return texts.str.upper()


@query
def model_labels(i: Inputs) -> DataFrame:
    replied = messages.classify_with(i.messages.select("conv_id", "turn", "text"), shouting_model)
    return replied.select("conv_id", "turn", messages.label_in_reply(F.col("reply")).alias("label"))


def labelling_model(texts: pd.Series) -> pd.DataFrame:
    """Stands for a remote classifier that explains itself, not always truthfully."""
    size = texts.str.len()
    return pd.DataFrame(
        {
            "primary_label": texts.str.contains("delay", case=False).map({True: " Delay", False: "none"}),
            "reason_span": texts.str.slice(0, 12).where(size % 2 == 0, "words of its own"),
            "confidence": ((size % 120) / 100).astype("string"),
        }
    )


@query
def model_classifications(i: Inputs) -> DataFrame:
    """Labels with their reasons and confidences, checked against the texts."""
    said = i.messages.select("conv_id", "turn", "text")
    return messages.classify_in_full(said, labelling_model).select("conv_id", "turn", "classification.*")


@query
def flight_related(i: Inputs) -> DataFrame:
    return i.messages.select(
        "conv_id", "turn", messages.is_flight_related(F.col("text")).alias("flight_related")
    )


@query
def field_types(i: Inputs) -> DataFrame:
    kind = messages.field_type(F.col("field_name"), F.col("field_description"))
    return i.view("fx_field_names").select("field_id", kind.alias("field_type"))


@query
def type_labels(i: Inputs) -> DataFrame:
    kind = F.col("grievance_type")
    return i.cases.select(
        "case_id",
        messages.type_label(kind).alias("label"),
        letters.letter_available(kind).alias("letter_available"),
        letters.follow_ups(kind, samples.FOLLOW_UPS).alias("follow_ups"),
    )


@query
def answer_pairs(i: Inputs) -> DataFrame:
    return messages.answer_pairs(dialogue.user_messages(i.messages)).select(
        "conv_id", "turn", "from_json", "pos", "name", "value"
    )


@query
def parsed_answers(i: Inputs) -> DataFrame:
    return dialogue.handled_answers(i.messages, i.states, i.required)


@query
def conversation_transcripts(i: Inputs) -> DataFrame:
    return messages.transcripts(i.messages)


@query
def conversation_requests(i: Inputs) -> DataFrame:
    return messages.conversation_requests(i.messages, samples.CHAT_EXAMPLES)


# ---- dialogue --------------------------------------------------------------------


@query
def dialogue_state(i: Inputs) -> DataFrame:
    return i.states


@query
def conversation_state(i: Inputs) -> DataFrame:
    return dialogue.conversation_states(i.messages, i.states, i.folder)


@query
def conversation_history(i: Inputs) -> DataFrame:
    cleared = i.states.where("state_before = 'completed'").groupBy("conv_id").agg(
        F.max("turn").alias("cleared_at")
    )
    return dialogue.history_since_clear(i.messages, cleared)


# ---- letters ---------------------------------------------------------------------


@query
def form_parsed(i: Inputs) -> DataFrame:
    return letters.parse_forms(i.view("fx_forms"))


@query
def compensation_letters(i: Inputs) -> DataFrame:
    filled = letters.parse_forms(i.view("fx_forms"))
    return letters.letters(filled, samples.LETTER_TEMPLATE, samples.LETTER_SUBJECT).select(
        "form_id", "subject", "letter", "error"
    )


@query
def letter_errors(i: Inputs) -> DataFrame:
    unparsed = i.view("fx_forms").withColumns(
        {
            "notice_window": F.col("intimation_time"),
            "compensation_type_1": F.lit("first"),
            "compensation_type_2": F.lit("second"),
            "total_expenses": F.col("expense_amount"),
        }
    )
    return letters.letters(unparsed, samples.LETTER_TEMPLATE, samples.LETTER_SUBJECT).select(
        "form_id", F.col("letter").isNotNull().alias("rendered"), "error"
    )


@query
def case_letters(i: Inputs) -> DataFrame:
    """Forms handed in for a case: only some types are offered a letter."""
    filled = letters.parse_forms(i.view("fx_forms")).withColumnRenamed("form_id", "case_id")
    kind = F.col("grievance_type")
    return letters.letters(
        filled.join(i.cases, "case_id"), samples.LETTER_TEMPLATE, samples.LETTER_SUBJECT, kind
    ).select("case_id", "grievance_type", "subject", "letter", "error")


@query
def escalation_checklist(i: Inputs) -> DataFrame:
    checklists = letters.escalation_checklists(i.view("fx_checklist"))
    labelled = case_plan.label_cases(i.view("fx_intake"))
    return letters.guidance(labelled, checklists).select("case_id", "grievance_type", "checklist")


# ---- whole cases -----------------------------------------------------------------


@query
def case_runs(i: Inputs) -> DataFrame:
    runs = case_plan.run_cases(
        i.view("fx_intake"), i.facts, i.required, i.rules, i.conditions, as_of(), folder=i.folder
    )
    lists = {c: F.array_join(c, ",") for c in ("missing_fields", "missing_critical_fields")}
    return runs.drop("created_at").withColumns(lists)


# ---- tables, files and SQL functions: what is written is read back ------------------


@query
def stored_flights(i: Inputs) -> DataFrame:
    """A table replaced by its refreshed version; readers get the newest."""
    folder = i.new_folder("flights")
    tables.replace_table(i.view("fx_flights"), folder)
    before = tables.read_table(i.spark, folder)
    tables.replace_table(flights.refresh_flights(before, i.view("fx_status"), as_of()), folder)
    return tables.read_table(i.spark, folder)


@query
def updated_flights(i: Inputs) -> DataFrame:
    """The same by a keyed update, which writes only the pieces with refreshed flights."""
    folder = i.new_folder("keyed")
    tables.write_keyed(i.view("fx_flights"), folder, "flight_number")
    before = tables.read_table(i.spark, folder, 0)
    outcomes = flights.due_outcomes(before, i.view("fx_status"), as_of())
    changed = outcomes.where("outcome = 'success'").select("flight_number")
    tables.update_table(
        i.spark, folder, 0, changed, "flight_number", lambda part: flights.apply_status(part, outcomes, as_of())
    )
    return tables.read_table(i.spark, folder, 1)


def _dated_runs(i: Inputs) -> str:
    """A case-run table of two days: each day's batch stored twice."""
    folder = i.new_folder("case_runs")
    runs = case_plan.run_cases(
        i.view("fx_intake"), i.facts, i.required, i.rules, i.conditions, as_of(), folder=i.folder
    )
    runs = materialise(runs, "case_runs", folder + "-in")
    later = runs.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    for _ in range(2):
        tables.append_case_runs(runs, folder, "first")
        tables.append_case_runs(later, folder, "second")
    return folder


@query
def stored_case_runs(i: Inputs) -> DataFrame:
    """The case-run table after a batch has been stored twice."""
    stored = tables.read_case_runs(i.spark, _dated_runs(i), until=fx.AS_OF[:10])
    return stored.drop("run_date").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def case_runs_by_date(i: Inputs) -> DataFrame:
    """How many runs each day and batch hold, from the first day on."""
    stored = tables.read_case_runs(i.spark, _dated_runs(i), since=fx.AS_OF[:10])
    return stored.groupBy("run_date", "batch").agg(F.count("*").alias("n_runs"))


@query
def snapshots_read(i: Inputs) -> DataFrame:
    folder = i.new_folder("snapshots")
    snapshots.write_snapshots(i.view("fx_status"), folder)
    return snapshots.read_snapshots(i.spark, folder)


@query
def ai_extract_sql(i: Inputs) -> DataFrame:
    """The SQL extraction function over whole texts, its answer addressed by path."""
    sql_functions.register_ai_extract(
        i.spark,
        lambda text, schema, options: {"length": len(text), "asked": sorted(schema), "version": options["version"]},
        "claimloom_ai_extract",
    )
    call = """claimloom_ai_extract(text, '{"length": "int"}', map('version', '2.0'))"""
    found = table_of(i, "documents").withColumn("e", F.expr(f"parse_json({call})"))
    return found.selectExpr("doc_id", "e:response.length::BIGINT AS length", "e:response.asked[0]::STRING AS asked", "e:response.version::STRING AS version")


def table_of(i: Inputs, name: str) -> DataFrame:
    return fx.table(i.spark, i.sf_dir, name)
