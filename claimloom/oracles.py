"""The registered queries as DuckDB SQL, written independently of the Spark plans:
plain joins over all pairs, window functions, and recursion where Spark folds."""

from __future__ import annotations

import re

from claimloom import fixtures as fx
from claimloom import samples
from claimloom.functions import vocabulary as v
from claimloom.functions.text import WHITE_SPACE
from claimloom.operators import letters as letters_op
from claimloom.operators.sections import MAX_CONTEXT

AS_OF = f"TIMESTAMP '{fx.AS_OF}'"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = _lit(WHITE_SPACE)
TYPES = ", ".join(_lit(t) for t in v.GRIEVANCE_TYPES)
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_.]+'))"


def _contains_case(text: str, groups) -> str:
    """CASE giving the first group whose keyword the text contains."""
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({text}, {_lit(k)})' for k in words)} THEN {_lit(name)}"
        for name, words in groups
    )
    return f"CASE {arms} END"


def _first_word(text: str, groups) -> str:
    """CASE giving the first keyword the text contains, as it stands in the text."""
    arms = " ".join(
        f"WHEN contains(lower({text}), {_lit(k)}) THEN substr({text}, instr(lower({text}), {_lit(k)}), {len(k)})"
        for _, words in groups
        for k in words
    )
    return f"CASE {arms} END"


# Named relations; a query lists only what it selects from, the rest follows.
R: dict[str, str] = {name: text for name, text in fx.VIEWS.items()}

R["numbered"] = fx.DUCKDB_NUMBERED
R["fx_reg_lines"] = fx.DUCKDB_LINES

# One row per field: the smallest of comparable structs, in which a preferred value comes first.
R["required_read"] = """
SELECT lower(trim(grievance_type)) AS kind, lower(trim(fact_key)) AS field,
       coalesce(lower(trim(importance)), '') = 'critical' AS needed, trim(why_needed) AS why, trim(description) AS about
FROM fx_required_raw
"""

R["required_best"] = """
SELECT kind, field, min({'later': NOT needed, 'why': -length(coalesce(why, '')), 'about': -length(coalesce(about, '')),
                         'has_why': why IS NOT NULL, 'why_text': coalesce(why, ''),
                         'has_about': about IS NOT NULL, 'about_text': coalesce(about, '')}) AS best
FROM required_read WHERE kind IS NOT NULL AND field > '' GROUP BY kind, field
"""

R["required_lists"] = """
SELECT kind, list({'later': best.later, 'field': field, 'best': best} ORDER BY best.later, field) AS fields
FROM required_best GROUP BY kind
"""

R["required"] = """
SELECT kind AS grievance_type, one.field AS field_name, CAST(n AS INTEGER) AS field_order,
       CASE WHEN one.best.has_about THEN one.best.about_text END AS field_description,
       CASE WHEN one.later THEN 'supporting' ELSE 'critical' END AS importance, NOT one.later AS is_required,
       CASE WHEN one.best.has_why THEN one.best.why_text END AS why_needed
FROM (SELECT kind, unnest(fields) AS one, generate_subscripts(fields, 1) AS n FROM required_lists)
"""

R["scenarios"] = f"SELECT unnest([{TYPES}, {_lit(v.ANY_SCENARIO)}]) AS scenario"
R["families"] = "SELECT unnest(['entitlement', 'exception', 'facility']) AS family"

R["rules_read"] = f"""
SELECT lower(trim(r.rule_id)) AS rule_id,
       {{'paragraph_missing': coalesce(trim(r.source_para), '') = '',
        'applies': -length(coalesce(trim(r.applies_when_text), '')), 'gets': -length(coalesce(trim(r.passenger_gets_text), '')),
        'order': [{', '.join("coalesce('+' || " + c + ", '')" for c in (
            "trim(r.title)", "trim(r.source_para)", f"coalesce(k.scenario, {_lit(v.ANY_SCENARIO)})",
            "coalesce(f.family, 'entitlement')", "trim(r.applies_when_text)", "trim(r.does_not_apply_when_text)",
            "trim(r.passenger_gets_text)", """'[{"ref_text":"' || r.ref_text || '"}]'""", """'["' || r.keyword || '","all"]'"""))}]}} AS place
FROM fx_rules_raw r
LEFT JOIN scenarios k ON k.scenario = lower(trim(r.scenario_type))
LEFT JOIN families f ON f.family = lower(trim(r.rule_family))
"""

# A column of the winning row: '+' and its text, or empty for NULL.
R["rules_best"] = "SELECT rule_id, min(place)['order'] AS best FROM rules_read WHERE rule_id > '' GROUP BY rule_id"
_RULE_COLUMNS = (
    "title", "source_para", "scenario_type", "rule_family", "applies_when_text",
    "does_not_apply_when_text", "passenger_gets_text", "references_json", "keywords_json",
)
R["rules"] = f"""
SELECT rule_id, {', '.join(f"nullif(best[{n}], '')[2:] AS {c}" for n, c in enumerate(_RULE_COLUMNS, 1))},
       array_to_string([best[n][2:] FOR n IN [1, 2, 5, 6, 7, 8, 9]], ' | ') AS retrieval_text
FROM rules_best
"""

R["allowed"] = """
SELECT f.case_id, c.grievance_type, lower(trim(f.fact_key)) AS fact_key, trim(f.value) AS value, f.pos,
       f.evidence_span, f.confidence
FROM fx_facts_raw f JOIN fx_cases c ON c.case_id = f.case_id
WHERE f.origin = 'message' AND f.value IS NOT NULL AND trim(f.value) <> ''
  AND EXISTS (SELECT 1 FROM required r WHERE r.grievance_type = c.grievance_type
              AND r.field_name = lower(trim(f.fact_key)))
"""

R["known"] = """
SELECT case_id, grievance_type, fact_key, value,
       CASE WHEN pr = 1 THEN 'extra' ELSE 'message' END AS origin, evidence_span, confidence
FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, fact_key ORDER BY pr DESC, pos DESC) AS rn
  FROM (
    SELECT case_id, grievance_type, fact_key, value, pos, 0 AS pr, evidence_span, confidence FROM allowed
    UNION ALL
    SELECT f.case_id, c.grievance_type, f.fact_key, f.value, f.pos, 1, f.evidence_span, f.confidence
    FROM fx_facts_raw f JOIN fx_cases c ON c.case_id = f.case_id WHERE f.origin = 'extra'
  )
) WHERE rn = 1
"""

R["missing"] = """
SELECT c.case_id, r.*
FROM fx_cases c JOIN required r ON r.grievance_type = c.grievance_type
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.case_id = c.case_id AND k.fact_key = r.field_name
                  AND k.value IS NOT NULL AND trim(k.value) <> '')
"""

# cases_in, known_in are the cases and facts that retrieval runs on
R["cases_in"] = "SELECT case_id, grievance_type FROM fx_cases"
R["known_in"] = "SELECT * FROM known"

R["candidates"] = """
WITH q AS (
  SELECT c.case_id, c.grievance_type, """ + TOKENS.format(
    "c.grievance_type || ' ' || coalesce(string_agg(k.fact_key || ' ' || coalesce(k.value, 'None'), ' '), '')"
) + """ AS toks
  FROM cases_in c LEFT JOIN known_in k ON k.case_id = c.case_id
  GROUP BY c.case_id, c.grievance_type
), t AS (
  SELECT rule_id, scenario_type, coalesce(source_para, '') AS para, """ + TOKENS.format(
    "retrieval_text"
) + """ AS toks FROM rules
), scored AS (
  SELECT q.case_id, q.grievance_type, t.rule_id, t.para,
         len(list_intersect(q.toks, t.toks))
         + CASE WHEN t.scenario_type = q.grievance_type THEN 2 ELSE 0 END AS score
  FROM q JOIN t ON t.scenario_type IN (q.grievance_type, 'cross_cutting')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, para, rule_id) AS rank
  FROM scored
)
SELECT case_id, grievance_type, CAST(rank AS INTEGER) AS rank, rule_id, CAST(score AS INTEGER) AS score
FROM ranked WHERE rank <= 12
"""


def _number(text: str) -> str:
    pattern = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return f"CASE WHEN regexp_full_match(trim({text}), '{pattern}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


_VALUE, _OPERAND = _number("value"), _number("operand")
CODE = f"""
CASE WHEN op IS NULL OR value IS NULL OR trim(value) = '' THEN 1 ELSE coalesce(CASE op
  WHEN '=' THEN coalesce(({_VALUE}) = ({_OPERAND}), lower(trim(value)) = lower(trim(operand)))
  WHEN '!=' THEN NOT coalesce(({_VALUE}) = ({_OPERAND}), lower(trim(value)) = lower(trim(operand)))
  WHEN '<' THEN ({_VALUE}) < ({_OPERAND}) WHEN '<=' THEN ({_VALUE}) <= ({_OPERAND})
  WHEN '>' THEN ({_VALUE}) > ({_OPERAND}) WHEN '>=' THEN ({_VALUE}) >= ({_OPERAND})
  WHEN 'in' THEN list_contains(list_transform(string_split(lower(operand), ','), lambda x: trim(x)),
                               lower(trim(value)))
  WHEN 'is_true' THEN CASE WHEN lower(trim(value)) IN ('true', 'yes') THEN true
                           WHEN lower(trim(value)) IN ('false', 'no') THEN false END
  WHEN 'is_false' THEN CASE WHEN lower(trim(value)) IN ('true', 'yes') THEN false
                            WHEN lower(trim(value)) IN ('false', 'no') THEN true END
END::INT * 2, 1) END"""

R["outcomes"] = f"""
WITH checked AS (
  SELECT a.case_id, a.rule_id, c.fact_key, c.op, c.operand, k.value
  FROM candidates a LEFT JOIN fx_conditions c ON c.rule_id = a.rule_id
  LEFT JOIN known_in k ON k.case_id = a.case_id AND k.fact_key = c.fact_key
), coded AS (SELECT *, {CODE} AS code FROM checked)
SELECT case_id, rule_id,
       CASE min(code) WHEN 0 THEN 'non_applicable' WHEN 1 THEN 'maybe' ELSE 'exact' END AS match_kind,
       CASE WHEN min(code) = 1
            THEN coalesce(string_agg(DISTINCT fact_key, ',' ORDER BY fact_key) FILTER (code = 1), '')
            ELSE '' END AS missing_facts
FROM coded GROUP BY case_id, rule_id
"""

R["needed"] = """
SELECT DISTINCT o.case_id, f.fact_key, r.why_needed
FROM (SELECT case_id, unnest(string_split(missing_facts, ',')) AS fact_key
      FROM outcomes WHERE match_kind = 'maybe' AND missing_facts <> '') f
JOIN (SELECT DISTINCT case_id FROM outcomes) o ON o.case_id = f.case_id
JOIN cases_in c ON c.case_id = f.case_id
LEFT JOIN required r ON r.grievance_type = c.grievance_type AND r.field_name = f.fact_key
"""

R["evaluated"] = f"""
WITH checked AS (
  SELECT c.case_id, c.grievance_type, r.rule_id, r.source_para, r.title, r.passenger_gets_text,
         r.rule_family, r.scenario_type, n.op, n.operand, k.value
  FROM fx_cases c JOIN rules r ON r.scenario_type = c.grievance_type OR r.scenario_type = 'cross_cutting'
  LEFT JOIN fx_conditions n ON n.rule_id = r.rule_id
  LEFT JOIN known k ON k.case_id = c.case_id AND k.fact_key = n.fact_key
), coded AS (
  SELECT case_id, grievance_type, rule_id, any_value(source_para) AS source_para, any_value(title) AS title,
         any_value(passenger_gets_text) AS passenger_gets_text, any_value(rule_family) AS rule_family,
         any_value(scenario_type) AS scenario_type, min({CODE}) AS code
  FROM checked GROUP BY case_id, grievance_type, rule_id
)
SELECT case_id, grievance_type, rule_id, CASE code WHEN 2 THEN 'exact' ELSE 'maybe' END AS match_kind,
       source_para, title, passenger_gets_text,
       CASE scenario_type WHEN 'delay' THEN '{{"next":"wait","fee":"0"}}'
                          WHEN 'cross_cutting' THEN '{{broken' END AS actions_json,
       rule_family = 'exception' AS is_exception
FROM coded WHERE code > 0
"""

R["due"] = f"""
SELECT * FROM fx_flights
WHERE last_check IS NULL OR least(
  epoch({AS_OF}) - floor(epoch(last_check)),
  epoch({AS_OF}) - floor(epoch(initial_departure_time))) >= 3600
"""

R["newest"] = """
SELECT flight_number, observed_at, response_json FROM (
  SELECT *, row_number() OVER (PARTITION BY flight_number ORDER BY observed_at DESC, seq DESC) AS rn
  FROM fx_status) WHERE rn = 1
"""

_DATA = "CASE WHEN json_valid(response_json) THEN json_extract(response_json, '$.data[0]') END"
_DELAY = f"coalesce(json_extract_string({_DATA}, '$.departure.delay'), '0')"
_DECODED = f"""
       CASE WHEN ({_DATA}) IS NULL THEN 'no_data' WHEN TRY_CAST({_DELAY} AS INTEGER) IS NULL THEN 'failed'
            ELSE 'success' END AS outcome,
       CASE WHEN ({_DATA}) IS NOT NULL THEN TRY_CAST({_DELAY} AS INTEGER) END AS new_delay"""

R["decoded"] = f"SELECT *, {_DECODED} FROM fx_status"

R["due_status"] = f"""
SELECT d.flight_number, coalesce(n.outcome, 'no_data') AS outcome, n.new_delay, n.response_json
FROM (SELECT DISTINCT flight_number FROM due) d
LEFT JOIN (SELECT *, {_DECODED} FROM newest) n ON n.flight_number = d.flight_number
"""

R["log"] = """
SELECT d.flight_number AS flight, d.user_id, s.outcome AS status, s.new_delay AS delay,
       CASE s.outcome WHEN 'no_data' THEN 'no status data' WHEN 'failed' THEN 'delay is not a whole number' END AS error
FROM due d JOIN due_status s ON s.flight_number = d.flight_number
"""

_P1 = r"^(?:Section|SECTION|Chapter|CHAPTER)\s+(\d+(?:\.\d+)?)[:\s]*([^\n]+)"
_P2 = r"^(\d+\.\d+(?:\.\d+)?)[:\.\s]+([A-Z][^\n]+)"
_P3 = r"^([A-Z][A-Z\s]{10,})"

R["headers"] = f"""
WITH l AS (SELECT doc_id, line_no, trim(line, {WS}) AS line FROM fx_reg_lines)
SELECT doc_id, line_no, line,
       CASE WHEN regexp_matches(line, '{_P1}') THEN 'word' WHEN regexp_matches(line, '{_P2}') THEN 'number'
            WHEN regexp_matches(line, '{_P3}') THEN 'capitals' END AS kind,
       CASE WHEN regexp_matches(line, '{_P1}') THEN regexp_extract(line, '{_P1}', 1)
            WHEN regexp_matches(line, '{_P2}') THEN regexp_extract(line, '{_P2}', 1) END AS number,
       trim(CASE WHEN regexp_matches(line, '{_P1}') THEN regexp_extract(line, '{_P1}', 2)
                 WHEN regexp_matches(line, '{_P2}') THEN regexp_extract(line, '{_P2}', 2)
                 ELSE regexp_extract(line, '{_P3}', 1) END, {WS}) AS title
FROM l WHERE line <> ''
"""

R["sects"] = """
WITH o AS (
  SELECT *, sum(CASE WHEN kind IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS occ
  FROM headers
), b AS (
  SELECT doc_id, occ, max(kind) AS kind, max(number) AS number,
         max(CASE WHEN kind IS NOT NULL THEN title END) AS title,
         coalesce(string_agg(CASE WHEN kind IS NULL THEN line END, chr(10) ORDER BY line_no), '') AS content
  FROM o GROUP BY doc_id, occ
  UNION ALL
  SELECT doc_id, 0, NULL, NULL, NULL, '' FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE occ = 0)
), keyed AS (
  SELECT *, CASE WHEN occ = 0 THEN 'General' WHEN kind = 'capitals' THEN '#' || CAST(occ AS STRING)
                 ELSE number END AS key FROM b
), spans AS (
  SELECT *, min(occ) OVER (PARTITION BY doc_id, key) AS first, max(occ) OVER (PARTITION BY doc_id, key) AS last
  FROM keyed
), kept AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS position
  FROM spans WHERE occ = last
)
SELECT doc_id, position,
       CASE WHEN kind = 'capitals' THEN 'section_' || CAST(position AS STRING) ELSE key END AS section_id,
       CASE WHEN key = 'General' THEN 'General Provisions' ELSE title END AS title, content
FROM kept
"""

_KEYWORDS = ", ".join(
    f"({_lit(g)}, {_lit(k)})" for g, words in v.SECTION_KEYWORDS.items() for k in words
)

R["scores"] = f"""
WITH kw(grp, word) AS (VALUES {_KEYWORDS}),
terms AS (
  SELECT q.query_id, q.doc_id, kw.word, 10 AS weight FROM fx_queries q JOIN kw ON contains(lower(q.query), kw.grp)
  UNION ALL
  SELECT query_id, doc_id, word, 1
  FROM (SELECT query_id, doc_id, unnest(regexp_split_to_array(lower(query), '\\s+')) AS word FROM fx_queries)
  WHERE length(word) > 3
), body AS (SELECT doc_id, position, lower(title || ' ' || content) AS txt FROM sects)
SELECT t.query_id, t.doc_id, b.position,
       CAST(sum(t.weight * ((length(b.txt) - length(replace(b.txt, t.word, ''))) // length(t.word))) AS BIGINT) AS score
FROM terms t JOIN body b ON b.doc_id = t.doc_id
GROUP BY t.query_id, t.doc_id, b.position
HAVING sum(t.weight * ((length(b.txt) - length(replace(b.txt, t.word, ''))) // length(t.word))) > 0
"""

R["packed"] = f"""
WITH RECURSIVE ordered AS (
  SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.position) AS n,
         x.section_id, '## ' || x.title || chr(10) || x.content || chr(10) || chr(10) AS block
  FROM scores s JOIN sects x ON x.doc_id = s.doc_id AND x.position = s.position
), walk AS (
  SELECT query_id, doc_id, CAST(0 AS BIGINT) AS n, CAST({len(v.CONTEXT_HEADING)} AS BIGINT) AS used,
         '' AS ids, {_lit(v.CONTEXT_HEADING)} AS txt FROM fx_queries
  UNION ALL
  SELECT w.query_id, w.doc_id, o.n,
         CASE WHEN w.used + length(o.block) <= {MAX_CONTEXT} THEN w.used + length(o.block) ELSE w.used END,
         CASE WHEN w.used + length(o.block) <= {MAX_CONTEXT}
              THEN w.ids || CASE WHEN w.ids = '' THEN '' ELSE ',' END || o.section_id ELSE w.ids END,
         CASE WHEN w.used + length(o.block) <= {MAX_CONTEXT} THEN w.txt || o.block ELSE w.txt END
  FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.n = w.n + 1
  WHERE w.used < {MAX_CONTEXT}
)
SELECT query_id, doc_id, ids AS section_ids, used AS packed_length, txt || {_lit(v.CONTEXT_NOTE)} AS context
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC) AS rn FROM walk) WHERE rn = 1
"""

R["users"] = f"""
SELECT *, {_contains_case("lower(text)", v.CLASSIFIER_KEYWORDS)} AS label,
       CASE WHEN json_valid(text) THEN json_type(text::JSON) END AS json_kind
FROM fx_messages WHERE coalesce(role, 'user') = 'user' AND trim(text, {WS}) <> ''
"""

R["pairs"] = f"""
SELECT conv_id, turn, false AS from_json, CAST(pos AS INTEGER) AS pos,
       trim(split_part(line, ':', 1), {WS}) AS name,
       trim(substr(line, instr(line, ':') + 1), {WS}) AS value
FROM (
  SELECT conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos
  FROM (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda l: contains(l, ':')) AS lines
        FROM users WHERE json_kind IS NULL)
)
UNION ALL
SELECT conv_id, turn, true, CAST(pos AS INTEGER), name, json_extract_string(text, '$."' || name || '"')
FROM (SELECT conv_id, turn, text, unnest(json_keys(text)) AS name,
             generate_subscripts(json_keys(text), 1) - 1 AS pos
      FROM users WHERE json_kind = 'OBJECT')
"""

R["matches"] = """
SELECT p.conv_id, p.turn, r.grievance_type, r.field_name, r.field_order, p.pos, p.value
FROM pairs p JOIN required r
  ON p.name = r.field_name OR (NOT p.from_json AND lower(p.name) = lower(replace(r.field_name, '_', ' ')))
"""

R["states"] = """
WITH RECURSIVE full_types AS (
  SELECT m.conv_id, m.turn, m.grievance_type
  FROM (SELECT conv_id, turn, grievance_type, count(DISTINCT field_name) AS n FROM matches GROUP BY ALL) m
  JOIN (SELECT grievance_type, count(*) AS n FROM required GROUP BY ALL) r
    ON r.grievance_type = m.grievance_type AND r.n = m.n
), steps AS (
  SELECT u.conv_id, u.turn, u.label, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS n,
         coalesce((SELECT list(f.grievance_type) FROM full_types f
                   WHERE f.conv_id = u.conv_id AND f.turn = u.turn), []) AS answered
  FROM users u
), walk AS (
  SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS n, CAST(NULL AS STRING) AS state_before,
         'initial' AS state_after, CAST(NULL AS STRING) AS grievance_type FROM steps
  UNION ALL
  SELECT s.conv_id, s.turn, s.n, w.state_after,
         CASE w.state_after
           WHEN 'initial' THEN CASE WHEN s.label IS NULL THEN 'initial' ELSE 'awaiting_fields' END
           WHEN 'awaiting_fields' THEN CASE WHEN list_contains(s.answered, w.grievance_type)
                                            THEN 'completed' ELSE 'awaiting_fields' END
           ELSE 'initial' END,
         CASE w.state_after WHEN 'initial' THEN s.label WHEN 'awaiting_fields' THEN w.grievance_type END
  FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.n = w.n + 1
)
SELECT conv_id, turn, state_before, state_after, grievance_type FROM walk WHERE n > 0
"""

R["spoken"] = f"""
SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM fx_messages
WHERE coalesce(role, 'user') IN ('user', 'assistant')
"""

R["history"] = f"""
SELECT m.* FROM spoken m
LEFT JOIN (SELECT conv_id, max(turn) AS cleared_at FROM states WHERE state_before = 'completed' GROUP BY conv_id) c
  ON c.conv_id = m.conv_id
WHERE (c.cleared_at IS NULL OR m.turn > c.cleared_at)
  AND (m.role = 'assistant' OR trim(m.text, {WS}) <> '')
"""

_GIVEN = ", ".join(
    f"trim(coalesce({c}, ''), {WS}) AS {c}" for c in letters_op.FORM_COLUMNS[:11]
)
_DISRUPTION = "lower(trim(coalesce(disruption_type, '')))"


def _relief(n: int) -> str:
    arms = " ".join(
        f"WHEN contains({_DISRUPTION}, {_lit(r[0])}) THEN {_lit(r[n])}" for r in letters_op.RELIEF
    )
    return f"CASE {arms} ELSE {_lit(letters_op.OTHER_RELIEF[n - 1])} END"


R["parsed"] = f"""
SELECT *, TRY_CAST(total_expenses AS DECIMAL(18, 2)) AS total_expenses_amount FROM (
SELECT form_id, {_GIVEN}, trim(coalesce(intimation_time, '')) AS notice_window,
       {_relief(1)} AS compensation_type_1, {_relief(2)} AS compensation_type_2,
       CASE WHEN expense_amount IS NULL OR upper(trim(expense_amount)) IN ('NA', '') THEN '0'
            ELSE trim(replace(replace(expense_amount, '₹', ''), ',', '')) END AS total_expenses
FROM fx_forms)
"""


def _template(text: str) -> str:
    parts = re.split(r"\$([A-Z_][A-Z0-9_]*)", text)
    return " || ".join(p.lower() if i % 2 else _lit(p) for i, p in enumerate(parts))


R["labelled"] = f"""
SELECT *, coalesce({_contains_case("lower(user_text)", v.CLASSIFIER_KEYWORDS)}, 'unsupported') AS grievance_type,
       {_first_word("user_text", v.CLASSIFIER_KEYWORDS)} AS reason_span, CAST(NULL AS DOUBLE) AS confidence
FROM fx_intake
"""

# ---- queries: text, and relations replaced for that query only ----------------------

Q: dict[str, str] = {}

Q["required_fields"] = "SELECT * FROM required"
Q["required_fields_preview"] = "SELECT grievance_type, field_order, field_name, importance FROM required ORDER BY 1, 2"
Q["rules_all"] = "SELECT * FROM rules"
Q["rules_preview"] = """
SELECT source_para, scenario_type, rule_family, rule_id, title, applies_when_text,
       does_not_apply_when_text, passenger_gets_text FROM rules ORDER BY source_para NULLS FIRST, rule_id"""
Q["rule_counts"] = """
SELECT scenario_type, rule_family, count(*) AS cnt FROM rules GROUP BY scenario_type, rule_family ORDER BY 1, 2"""
Q["envelope_errors"] = """
SELECT 'doc-' || CAST(seq // 100 AS STRING) AS path,
       CASE WHEN (seq // 100) % 20 = 19 THEN 'partly unreadable' END AS error_message,
       'doc-' || CAST(seq // 100 AS STRING) AS document_id, CAST(count(*) AS INTEGER) AS n_rules
FROM fx_rules_raw GROUP BY seq // 100"""
Q["stored_envelopes"] = Q["envelope_errors"]
Q["stored_rules"] = "SELECT * FROM rules"
Q["envelope_required"] = "SELECT * FROM required"
Q["envelope_rules"] = "SELECT * FROM rules"
Q["tolerant_decode"] = """
SELECT event_id, coalesce(array_to_string(kw, '+'), '') AS keywords, CAST(coalesce(len(kw), 0) AS INTEGER) AS n_keywords,
       k, CAST(coalesce(n, 0) AS INTEGER) AS n_actions
FROM (SELECT event_id,
             CASE WHEN json_valid(keywords_json) THEN from_json(keywords_json, '["VARCHAR"]') END AS kw,
             CASE WHEN json_valid(actions_json) THEN json_extract_string(actions_json, '$.k') END AS k,
             CASE WHEN json_valid(actions_json) THEN len(json_keys(actions_json)) END AS n
      FROM fx_tolerant_json)"""
Q["extracted_documents"] = """
SELECT 'doc-' || CAST(d.doc_id AS STRING) AS path,
       CASE WHEN f.ids IS NULL THEN 'no numbered section' END AS error_message, f.ids AS rule_ids
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg('s' || regexp_extract(line, '^Section (\\d+\\.\\d+): (.+)$', 1), ',' ORDER BY line_no) AS ids
  FROM fx_reg_lines WHERE regexp_matches(line, '^Section (\\d+\\.\\d+): (.+)$') GROUP BY doc_id) f
ON f.doc_id = d.doc_id"""
Q["required_fields_of_case"] = """
SELECT case_id, c.grievance_type, field_name, field_order, is_required
FROM fx_cases c JOIN required r ON r.grievance_type = c.grievance_type"""
Q["allowed_facts"] = "SELECT * FROM allowed"
Q["known_facts"] = "SELECT * FROM known"
Q["missing_fields"] = "SELECT * FROM missing"
Q["missing_critical"] = "SELECT case_id, field_name, field_order FROM missing WHERE importance = 'critical'"
_OPEN = """
SELECT c.case_id, r.field_name FROM fx_cases c JOIN required r ON r.grievance_type = c.grievance_type
WHERE NOT EXISTS (SELECT 1 FROM fx_facts_raw f WHERE f.origin = 'extra' AND f.case_id = c.case_id
                  AND f.fact_key = r.field_name{blank})"""
Q["form_open_strict"] = _OPEN.format(blank=" AND trim(coalesce(f.value, '')) <> ''")
Q["form_open_present"] = _OPEN.format(blank="")
_OPEN_LISTS = """
       coalesce(string_agg(m.field_name, ',' ORDER BY m.field_order), '') AS missing_fields,
       coalesce(string_agg(m.field_name, ',' ORDER BY m.field_order) FILTER (m.is_required), '') AS missing_critical_fields,"""
Q["case_status"] = f"""
SELECT c.case_id, c.grievance_type, count(m.field_name) AS n_missing,
       count(CASE WHEN m.is_required THEN 1 END) AS n_missing_critical, {_OPEN_LISTS}
       CASE WHEN count(CASE WHEN m.is_required THEN 1 END) > 0 THEN 'need_more_info' ELSE 'matched' END AS status
FROM fx_cases c LEFT JOIN missing m ON m.case_id = c.case_id GROUP BY c.case_id, c.grievance_type"""
Q["rule_tokens"] = f"""
SELECT rule_id, scenario_type, unnest({TOKENS.format('retrieval_text')}) AS token FROM rules"""
Q["candidate_rules_topk"] = "SELECT * FROM candidates"
Q["case_payload"] = """
SELECT c.case_id, '{"grievance_type":"' || c.grievance_type || '","facts":{' || coalesce(f.facts, '')
       || '},"required_fields":' || coalesce(q.fields, '[]') || ',"candidate_rules":' || coalesce(a.cands, '[]') || '}' AS payload
FROM fx_cases c
LEFT JOIN (SELECT case_id, string_agg('"' || fact_key || '":' || coalesce('"' || value || '"', 'null'), ',' ORDER BY fact_key) AS facts
           FROM known GROUP BY case_id) f ON f.case_id = c.case_id
LEFT JOIN (SELECT grievance_type, CAST(to_json(list({'field_name': field_name, 'field_description': field_description,
             'importance': importance, 'is_required': is_required, 'why_needed': why_needed} ORDER BY field_order)) AS STRING) AS fields
           FROM required GROUP BY grievance_type) q ON q.grievance_type = c.grievance_type
LEFT JOIN (SELECT a.case_id, '[' || string_agg(
             regexp_replace(CAST(to_json({'rule_id': r.rule_id, 'title': r.title, 'source_para': r.source_para,
               'scenario_type': r.scenario_type, 'rule_family': r.rule_family, 'applies_when_text': r.applies_when_text,
               'does_not_apply_when_text': r.does_not_apply_when_text, 'passenger_gets_text': r.passenger_gets_text}) AS STRING), '}$', '')
             || ',"references":' || coalesce(replace(r.references_json, '"}', '","purpose":null}'), '[]')
             || ',"candidate_keywords":' || coalesce(r.keywords_json, '[]') || '}', ',' ORDER BY a.rank) || ']' AS cands
           FROM candidates a JOIN rules r ON r.rule_id = a.rule_id GROUP BY a.case_id) a ON a.case_id = c.case_id"""
Q["rule_outcomes"] = "SELECT * FROM outcomes"
Q["missing_facts_for_maybe"] = "SELECT * FROM needed"
Q["rules_matched"] = "SELECT * FROM evaluated"
_ORDER = "ORDER BY match_kind, coalesce(source_para, ''), rule_id"
R["alike"] = f"""
WITH judged AS (
  SELECT DISTINCT c.case_id, c.grievance_type, n.fact_key, n.op, n.operand, {CODE} AS code
  FROM fx_cases c JOIN known k ON k.case_id = c.case_id JOIN fx_conditions n ON n.fact_key = k.fact_key
), verdicts AS (
  SELECT c.case_id, c.grievance_type,
         coalesce(list_sort(list({{'k': fact_key, 'o': op, 'v': operand, 'c': code}}) FILTER (WHERE code <> 1)), []) AS said
  FROM fx_cases c LEFT JOIN judged j ON j.case_id = c.case_id GROUP BY ALL
)
SELECT case_id, grievance_type, min(case_id) OVER (PARTITION BY grievance_type, said) AS signature FROM verdicts
"""
Q["case_signatures"] = "SELECT * FROM alike"
Q["signature_rules"] = """
SELECT case_id AS signature, rule_id, match_kind FROM evaluated e
WHERE case_id IN (SELECT signature FROM alike)"""
Q["rules_in_order"] = """
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY match_kind, source_para NULLS FIRST, rule_id) AS INTEGER) AS place,
       rule_id, match_kind FROM evaluated"""
Q["eval_rules_sql"] = "SELECT case_id, rule_id, match_kind, source_para, title, passenger_gets_text, actions_json FROM evaluated"
Q["invalid_conditions"] = """
SELECT rule_id, fact_key, op, operand FROM fx_conditions
WHERE op IS NULL OR op NOT IN ('=', '!=', '<', '<=', '>', '>=', 'in', 'is_true', 'is_false')"""
Q["top3_rule_lines"] = f"""
SELECT case_id, string_agg(CAST(n AS STRING) || '. ' || coalesce(title, 'N/A') || ': '
       || coalesce(passenger_gets_text, 'N/A') || chr(10), '' ORDER BY n) AS rules_text
FROM (SELECT *, row_number() OVER (PARTITION BY case_id {_ORDER}) AS n FROM evaluated) WHERE n <= 3 GROUP BY case_id"""
Q["rule_summaries"] = f"""
SELECT case_id, '[' || string_agg('{{"rule_id":"' || rule_id || '","title":"' || coalesce(title, 'N/A')
       || '","match_kind":"' || match_kind || '","passenger_gets":"' || coalesce(passenger_gets_text, 'Not specified')
       || '","source":"' || coalesce(source_para, 'N/A') || '","actions":'
       || CASE WHEN json_valid(actions_json) THEN actions_json ELSE '{{}}' END || '}}', ',' {_ORDER}) || ']' AS matched_rules
FROM evaluated GROUP BY case_id"""
Q["exact_rule_summary"] = f"""
SELECT case_id, string_agg('**' || CAST(n AS STRING) || '. ' || coalesce(title, 'N/A') || '**' || chr(10) || '   '
       || coalesce(passenger_gets_text, 'Not specified') || chr(10) || chr(10), '' ORDER BY n) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY case_id {_ORDER}) AS n FROM evaluated WHERE match_kind = 'exact')
GROUP BY case_id"""
Q["due_flights"] = "SELECT * FROM due"
Q["latest_status"] = "SELECT * FROM newest"
Q["status_decoded"] = "SELECT seq, flight_number, outcome, new_delay FROM decoded"
Q["flights_refreshed"] = f"""
SELECT f.row_id, f.flight_number, f.user_id, f.initial_departure_time, coalesce(s.new_delay, f.delay) AS delay,
       CASE WHEN s.flight_number IS NULL THEN f.raw_data ELSE s.response_json END AS raw_data,
       CASE WHEN s.flight_number IS NULL THEN f.last_check ELSE {AS_OF} END AS last_check
FROM fx_flights f
LEFT JOIN (SELECT * FROM due_status WHERE outcome = 'success') s ON s.flight_number = f.flight_number"""
Q["stored_flights"] = Q["updated_flights"] = Q["flights_refreshed"]
Q["snapshots_read"] = "SELECT seq, flight_number, observed_at, response_json FROM fx_status"
Q["ai_extract_sql"] = "SELECT doc_id, length(text) AS length, 'length' AS asked, '2.0' AS version FROM documents"
Q["refresh_log"] = "SELECT * FROM log"
Q["refresh_summary"] = """
SELECT count(*) AS processed, count(CASE WHEN status = 'success' THEN 1 END) AS successful,
       count(CASE WHEN status <> 'success' THEN 1 END) AS failed FROM log"""
Q["entitlements_by_delay"] = """
SELECT f.row_id, f.flight_number, f.user_id, f.delay, t.entitlement
FROM fx_flights f JOIN fx_thresholds t ON f.delay >= t.min_delay_minutes"""
Q["entitlement_changes"] = """
WITH steps AS (
  SELECT flight_number, seq, observed_at, new_delay,
         lag(new_delay) OVER (PARTITION BY flight_number ORDER BY observed_at, seq) AS previous
  FROM decoded WHERE outcome = 'success'
)
SELECT flight_number, seq, observed_at, entitlement AS gained FROM steps JOIN fx_thresholds t
ON new_delay >= t.min_delay_minutes WHERE previous IS NULL OR previous < t.min_delay_minutes"""
Q["page_documents"] = """
SELECT doc_id, string_agg(page_text || chr(10) || chr(10), '' ORDER BY page_no) AS text
FROM fx_pages WHERE page_text IS NOT NULL AND page_text <> '' GROUP BY doc_id"""
Q["section_headers"] = """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, number, title FROM headers WHERE kind IS NOT NULL"""
Q["document_sections"] = "SELECT * FROM sects"
Q["section_overview"] = "SELECT doc_id, position, '- ' || title AS line FROM sects WHERE position < 10"
Q["section_scores"] = "SELECT * FROM scores"
Q["packed_context"] = "SELECT * FROM packed"
_LABEL = _contains_case("{}", [(t, (t,)) for t in v.GRIEVANCE_TYPES])
Q["message_labels"] = f"""
SELECT conv_id, turn, {_LABEL.replace('{}', f'lower(trim(reply, {WS}))')} AS reply_label,
       CASE WHEN lower(trim(reply, {WS})) IN ({TYPES}) THEN lower(trim(reply, {WS})) ELSE 'unsupported' END AS exact_label,
       {_contains_case("lower(text)", v.CLASSIFIER_KEYWORDS)} AS keyword_label
FROM fx_replies"""
Q["model_labels"] = f"""
SELECT conv_id, turn, {_LABEL.replace('{}', 'lower(text)')} AS label FROM fx_messages"""
Q["model_classifications"] = """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'delay') THEN 'delay' ELSE 'unsupported' END AS label,
       CASE WHEN length(text) % 2 = 0 AND trim(text) <> '' THEN substr(text, 1, 12) END AS reason_span,
       CASE WHEN length(text) % 120 <= 100 THEN (length(text) % 120) / 100.0::DOUBLE END AS confidence
FROM fx_messages"""
Q["flight_related"] = f"""
SELECT conv_id, turn, regexp_matches(lower(text), '{"|".join(v.FLIGHT_WORDS)}') AS flight_related
FROM fx_messages"""


def _field_type() -> str:
    arms = " ".join(
        f"WHEN {' OR '.join([f'contains(n, {_lit(x)})' for x in names] + [f'contains(d, {_lit(x)})' for x in texts])}"
        f" THEN {_lit(kind)}"
        for kind, names, texts in v.FIELD_TYPE_INDICATORS
    )
    return f"CASE {arms} ELSE 'text' END"


Q["field_types"] = f"""
SELECT field_id, {_field_type()} AS field_type
FROM (SELECT field_id, lower(field_name) AS n, lower(coalesce(field_description, '')) AS d FROM fx_field_names)"""
Q["type_labels"] = f"""
SELECT case_id, CASE grievance_type {' '.join(f'WHEN {_lit(t)} THEN {_lit(x)}' for t, x in v.TYPE_LABELS.items())} END AS label,
       grievance_type IN ('cancellation', 'denied_boarding') AS letter_available,
       CASE WHEN grievance_type IN ('cancellation', 'denied_boarding')
            THEN {_lit(''.join(f'{n}. {t}{chr(10)}' for n, t in enumerate(samples.FOLLOW_UPS, 1)))} ELSE '' END AS follow_ups
FROM fx_cases"""
Q["answer_pairs"] = "SELECT * FROM pairs"
Q["parsed_answers"] = """
SELECT conv_id, turn, grievance_type, field_name, value FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, field_name ORDER BY pos DESC) AS rn FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.conv_id, m.turn, m.pos ORDER BY m.field_order) AS fn
    FROM matches m JOIN states s ON s.conv_id = m.conv_id AND s.turn = m.turn
     AND s.state_before = 'awaiting_fields' AND s.grievance_type = m.grievance_type) WHERE fn = 1
) WHERE rn = 1"""
Q["conversation_transcripts"] = """
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM spoken GROUP BY conv_id"""
_EXAMPLES = "".join(
    f'{{"role":"{role}","content":"{text}"}},'
    for pair in samples.CHAT_EXAMPLES
    for role, text in zip(("user", "assistant"), pair)
)
Q["conversation_requests"] = f"""
SELECT conv_id, '[' || {_lit(_EXAMPLES)}
       || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}', ',' ORDER BY turn) || ']' AS request
FROM spoken GROUP BY conv_id"""
Q["dialogue_state"] = "SELECT * FROM states"
Q["conversation_state"] = """
SELECT e.conv_id, coalesce(l.state_after, 'initial') AS state, l.grievance_type, coalesce(h.n, 0) AS n_messages
FROM (SELECT DISTINCT conv_id FROM spoken) e
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM states) l
  ON l.conv_id = e.conv_id AND l.rn = 1
LEFT JOIN (SELECT conv_id, count(*) AS n FROM history GROUP BY conv_id) h ON h.conv_id = e.conv_id"""
Q["conversation_history"] = "SELECT * FROM history"
Q["form_parsed"] = "SELECT * FROM parsed"
Q["compensation_letters"] = f"""
SELECT form_id, {_template(samples.LETTER_SUBJECT)} AS subject, {_template(samples.LETTER_TEMPLATE)} AS letter,
       CAST(NULL AS STRING) AS error FROM parsed"""
_ERRORS = " || ".join(
    f"CASE WHEN {dict(notice_window='intimation_time', total_expenses='expense_amount').get(c, c)} IS NULL "
    f"THEN ', {c.upper()}' ELSE '' END"
    for c in letters_op.LETTER_COLUMNS
    if not c.startswith("compensation")
)
Q["letter_errors"] = f"""
SELECT form_id, e = '' AS rendered, CASE WHEN e <> '' THEN 'Missing required fields: ' || substr(e, 3) END AS error
FROM (SELECT form_id, {_ERRORS} AS e FROM fx_forms)"""
Q["case_letters"] = f"""
SELECT case_id, grievance_type, CASE WHEN ok THEN subject END AS subject, CASE WHEN ok THEN letter END AS letter,
       CASE WHEN NOT ok THEN 'no letter is offered for this type' END AS error
FROM (SELECT c.case_id, c.grievance_type, c.grievance_type IN ('cancellation', 'denied_boarding') AS ok,
             {_template(samples.LETTER_SUBJECT)} AS subject, {_template(samples.LETTER_TEMPLATE)} AS letter
      FROM parsed p JOIN fx_cases c ON c.case_id = p.form_id)"""
Q["escalation_checklist"] = """
SELECT l.case_id, l.grievance_type, coalesce(x.txt, '') AS checklist FROM labelled l LEFT JOIN (
  SELECT grievance_type, 'Required documents:' || chr(10)
         || coalesce(string_agg(CAST(n AS STRING) || '. ' || item_text || chr(10), '' ORDER BY n) FILTER (kind = 'document'), '')
         || chr(10) || 'Steps:' || chr(10)
         || coalesce(string_agg(CAST(n AS STRING) || '. ' || item_text || chr(10), '' ORDER BY n) FILTER (kind = 'step'), '') AS txt
  FROM (SELECT *, row_number() OVER (PARTITION BY grievance_type, kind ORDER BY item_no) AS n FROM fx_checklist)
  GROUP BY grievance_type) x ON x.grievance_type = l.grievance_type"""
Q["case_runs"] = """
SELECT l.case_id, l.session_id, l.user_text, l.grievance_type, l.reason_span, l.confidence, coalesce(s.status, 'unsupported') AS status,
       l.grievance_type IN ('cancellation', 'denied_boarding') AS letter_available,
       coalesce(s.n_missing, 0) AS n_missing, coalesce(s.n_crit, 0) AS n_missing_critical,
       coalesce(s.missing_fields, '') AS missing_fields, coalesce(s.missing_critical_fields, '') AS missing_critical_fields,
       '{' || coalesce(k.facts, '') || '}' AS facts_json,
       '{"grievance_type":"' || l.grievance_type || '","known_facts":{' || coalesce(k.facts, '') || '}}' AS intake_json,
       '{"applicable_rule_ids":[' || coalesce(o.yes, '') || '],"maybe_rule_ids":[' || coalesce(o.maybe, '')
       || '],"non_applicable_rule_ids":[' || coalesce(o.no, '') || '],"missing_facts":[' || coalesce(n.facts, '')
       || '],"passenger_summary":"' || CAST(o.n_yes AS STRING) || ' rule(s) apply, '
       || CAST(o.n_maybe AS STRING) || ' may apply."}' AS match_json
FROM labelled l
LEFT JOIN status s ON s.case_id = l.case_id
LEFT JOIN (SELECT case_id, string_agg('"' || fact_key || '":' || coalesce('"' || value || '"', 'null'), ',' ORDER BY fact_key) AS facts
           FROM known GROUP BY case_id) k ON k.case_id = l.case_id
LEFT JOIN (SELECT case_id,
             string_agg('"' || rule_id || '"', ',' ORDER BY rule_id) FILTER (match_kind = 'exact') AS yes,
             string_agg('"' || rule_id || '"', ',' ORDER BY rule_id) FILTER (match_kind = 'maybe') AS maybe,
             string_agg('"' || rule_id || '"', ',' ORDER BY rule_id) FILTER (match_kind = 'non_applicable') AS no,
             count(*) FILTER (match_kind = 'exact') AS n_yes, count(*) FILTER (match_kind = 'maybe') AS n_maybe
           FROM outcomes GROUP BY case_id) o ON o.case_id = l.case_id
LEFT JOIN (SELECT case_id, string_agg('{"fact_key":"' || fact_key || '","why_needed":'
                    || coalesce('"' || why_needed || '"', 'null') || '}', ',' ORDER BY fact_key) AS facts
           FROM needed GROUP BY case_id) n ON n.case_id = l.case_id"""

Q["stored_case_runs"] = f"""
SELECT session_id, user_text, grievance_type, facts_json, intake_json, match_json, {AS_OF} AS created_at, 'first' AS batch
FROM ({Q["case_runs"]}) WHERE status = 'matched'"""

Q["case_runs_by_date"] = f"""
SELECT CAST({AS_OF} AS DATE) + CAST(d AS INTEGER) AS run_date, CASE d WHEN 0 THEN 'first' ELSE 'second' END AS batch, count(*) AS n_runs
FROM ({Q["case_runs"]}), (SELECT unnest([0, 1]) AS d) WHERE status = 'matched' GROUP BY ALL"""

_STATUS = f"""
SELECT c.case_id, count(m.field_name) AS n_missing, count(CASE WHEN m.is_required THEN 1 END) AS n_crit, {_OPEN_LISTS}
       CASE WHEN count(CASE WHEN m.is_required THEN 1 END) > 0 THEN 'need_more_info' ELSE 'matched' END AS status
FROM fx_cases c LEFT JOIN missing m ON m.case_id = c.case_id GROUP BY c.case_id"""

# cases come from the classified intake, and only matched ones are retrieved for
_OF_INTAKE = {
    "fx_cases": "SELECT case_id, grievance_type FROM labelled WHERE grievance_type <> 'unsupported'",
    "status": _STATUS,
    "cases_in": "SELECT c.* FROM fx_cases c JOIN status s ON s.case_id = c.case_id AND s.status = 'matched'",
    "known_in": "SELECT k.* FROM known k JOIN cases_in c ON c.case_id = k.case_id",
}

REPLACED: dict[str, dict[str, str]] = {"case_runs": _OF_INTAKE, "stored_case_runs": _OF_INTAKE, "case_runs_by_date": _OF_INTAKE}


def _needed(text: str, relations: dict[str, str]) -> list[str]:
    """Relations a text uses, dependencies first."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in relations:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(relations[name])
                order.append(name)

    visit(text)
    return order


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, text in Q.items():
        relations = R | REPLACED.get(key, {})
        names = _needed(text, relations)
        if names:
            ctes = ",\n".join(f"{n} AS ({relations[n]})" for n in names)
            body = re.sub(r"^\s*WITH ", ", ", text) if text.lstrip().startswith("WITH ") else text
            text = f"WITH {ctes}\n{body}"
        out[key] = text
    return out
