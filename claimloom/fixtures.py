"""Input views on top of the given tables (see FIXTURES.md).

Each text runs unchanged on Spark and DuckDB, except for the two that need to
number lines; those are given once per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The clock of every compared query.
AS_OF = "2024-01-15 12:00:00"

VIEWS: dict[str, str] = {}

VIEWS["fx_flights"] = """
SELECT event_id AS row_id,
       'FX' || CAST(CAST(floor(event_id / 7) AS BIGINT) AS STRING) AS flight_number,
       user_id,
       ts AS initial_departure_time,
       CAST(floor(value) AS INT) AS delay,
       props AS raw_data,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + INTERVAL 2 HOUR END AS last_check
FROM events
"""

VIEWS["fx_status"] = """
SELECT event_id AS seq,
       'FX' || CAST(CAST(floor(event_id / 7) AS BIGINT) AS STRING) AS flight_number,
       ts AS observed_at,
       CASE CASE WHEN event_id % 11 = 4 THEN 5 ELSE event_id % 5 END
         WHEN 5 THEN '{"data":[{"departure":{"delay":"about ' || event_type || '"}}]}'
         WHEN 0 THEN '{"data":[]}'
         WHEN 1 THEN '{"data":[{"departure":{"delay":null}}]}'
         WHEN 2 THEN '{bad'
         ELSE '{"data":[{"departure":{"delay":' || CAST(event_id % 240 AS STRING)
              || '}},{"departure":{"delay":9}}]}'
       END AS response_json
FROM events
"""

# Every message as it is, each followed by one whose form is known.
VIEWS["fx_messages"] = """
SELECT conv_id, turn * 2 AS turn, role, text FROM conversations
UNION ALL
SELECT conv_id, turn * 2 + 1, 'user',
       CASE (conv_id * 7 + turn) % 8
         WHEN 0 THEN 'Our trip: cancellation notice arrived 5 hours ahead'
         WHEN 1 THEN 'A delay of 4.5 hours so far, still at the gate'
         WHEN 2 THEN 'denied_boarding at the desk, seats oversold'
         WHEN 3 THEN 'They made a downgrade from business'
         WHEN 4 THEN CASE WHEN conv_id % 3 = 0 THEN 'hello!' ELSE 'block_time_hours: 1.8' END
         WHEN 5 THEN 'Here you are' || chr(10) || 'fact_0: 1' || chr(10) || ' Fact 1 : yes: really'
                     || chr(10) || 'fact_2: ' || chr(10) || 'FACT 3: no' || chr(10) || 'fact_4: 4'
                     || chr(10) || 'fact_5: 5' || chr(10) || 'fact 0: ' || CAST(conv_id % 9 AS STRING)
         WHEN 6 THEN '{"fact_0":"7","fact_1":"no","fact_2":3,"fact_3":"x","fact_4":true,"fact_5":"'
                     || CAST(turn AS STRING) || '"}'
         ELSE ' ' END
FROM conversations
"""

# What a classifier may answer to each message: a bare label, one in a sentence, or anything.
VIEWS["fx_replies"] = """
SELECT conv_id, turn, text,
       CASE (conv_id + turn) % 5 WHEN 0 THEN ' Delay' || chr(10) WHEN 1 THEN 'denied_boarding'
                                 WHEN 2 THEN 'The type is "cancellation", surely.'
                                 WHEN 3 THEN 'downgrade ' ELSE text END AS reply
FROM conversations
"""

VIEWS["fx_rules_raw"] = """
SELECT p_partkey AS seq,
       ' R' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) || ' ' AS rule_id,
       p_name AS title,
       CASE WHEN p_partkey % 4 = 0 THEN ''
            ELSE CAST(1 + p_size % 3 AS STRING) || '.' || CAST(p_size AS STRING) END AS source_para,
       CASE p_type WHEN 'MEDIUM' THEN 'Delay ' WHEN 'STANDARD' THEN 'CANCELLATION'
                   WHEN 'LARGE' THEN 'denied_boarding' WHEN 'PROMO' THEN 'downgrade'
                   WHEN 'SMALL' THEN NULL ELSE 'baggage' END AS scenario_type,
       CASE p_partkey % 5 WHEN 0 THEN 'Entitlement' WHEN 1 THEN 'exception'
                          WHEN 2 THEN ' FACILITY' WHEN 3 THEN NULL ELSE 'definition' END AS rule_family,
       'applies to ' || p_name || ' over ' || CAST(p_size AS STRING) || ' hours delay' AS applies_when_text,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'not for ' || p_brand END AS does_not_apply_when_text,
       'receives ' || p_type AS passenger_gets_text,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'para ' || CAST(p_size AS STRING) END AS ref_text,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_brand) END AS keyword
FROM part
"""

VIEWS["fx_required_raw"] = """
SELECT p_partkey AS seq,
       CASE p_type WHEN 'MEDIUM' THEN 'Delay' WHEN 'STANDARD' THEN ' cancellation'
                   WHEN 'LARGE' THEN 'denied_boarding' WHEN 'PROMO' THEN 'downgrade'
                   ELSE NULL END AS grievance_type,
       CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 13 = 0 THEN NULL
            ELSE 'Fact_' || CAST(p_size % 6 AS STRING) END AS fact_key,
       p_name AS description,
       CASE WHEN p_size % 6 < 3 AND p_partkey % 4 = 0 THEN 'Critical '
            WHEN p_partkey % 4 = 1 THEN 'supporting' WHEN p_partkey % 4 = 2 THEN NULL
            ELSE 'minor' END AS importance,
       CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'needed by ' || p_brand END AS why_needed
FROM part
"""

VIEWS["fx_cases"] = """
SELECT CAST(floor(event_id / 8) AS BIGINT) AS case_id,
       CASE sum(user_id) % 4 WHEN 0 THEN 'cancellation' WHEN 1 THEN 'delay'
                             WHEN 2 THEN 'denied_boarding' ELSE 'downgrade' END AS grievance_type
FROM events GROUP BY CAST(floor(event_id / 8) AS BIGINT)
"""

VIEWS["fx_intake"] = """
SELECT CAST(floor(event_id / 8) AS BIGINT) AS case_id,
       'session-' || CAST(min(event_id) AS STRING) AS session_id,
       CASE sum(user_id) % 5 WHEN 0 THEN 'They cancelled my trip, "no reason" given: ' || max(event_type)
                             WHEN 1 THEN 'delay of ' || CAST(max(user_id) % 12 AS STRING) || ' hours.'
                             WHEN 2 THEN 'Denied boarding: the desk said overbooked'
                             WHEN 3 THEN 'moved to a Lower Class seat'
                             ELSE 'hello there, ' || min(event_type) END AS user_text
FROM events GROUP BY CAST(floor(event_id / 8) AS BIGINT)
"""

VIEWS["fx_facts_raw"] = """
SELECT CAST(floor(event_id / 8) AS BIGINT) AS case_id,
       event_id AS pos,
       CASE WHEN event_id % 8 >= 6 THEN 'extra' ELSE 'message' END AS origin,
       CASE WHEN event_id % 9 = 0 THEN 'unlisted'
            WHEN event_id % 8 >= 6 THEN 'fact_' || CAST(user_id % 6 AS STRING)
            ELSE ' FACT_' || CAST(user_id % 6 AS STRING) END AS fact_key,
       CASE event_id % 10 WHEN 0 THEN '   ' WHEN 1 THEN NULL WHEN 2 THEN 'yes' WHEN 3 THEN 'false'
                          ELSE ' ' || CAST(event_id % 50 AS STRING) END AS value,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type || ' at ' || CAST(event_id AS STRING) END AS evidence_span,
       CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence
FROM events
"""

VIEWS["fx_conditions"] = """
SELECT CASE WHEN floor(p_partkey / 4) % 7 = 3 THEN 'other' ELSE 'r' END
         || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) AS rule_id,
       'fact_' || CAST(p_size % 6 AS STRING) AS fact_key,
       CASE p_partkey % 7 WHEN 0 THEN CASE WHEN p_partkey % 21 = 0 THEN '=>' ELSE '=' END WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN 'is_true' WHEN 4 THEN 'is_false'
                          WHEN 5 THEN '!=' ELSE 'in' END AS op,
       CASE p_partkey % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL
                          WHEN 6 THEN 'yes, ' || CAST(p_size AS STRING) || ',7'
                          ELSE CAST(p_size AS STRING) END AS operand
FROM part
"""

VIEWS["fx_forms"] = """
SELECT o_orderkey AS form_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            ELSE ' Passenger ' || CAST(o_custkey AS STRING) || '  ' END AS full_name,
       'p' || CAST(o_custkey AS STRING) || '@example.com' AS email_address,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '+00 ' || CAST(o_custkey AS STRING) END AS phone_number,
       CASE WHEN o_orderkey % 17 = 0 THEN 'Air $PNR $NAME' ELSE 'Air ' || o_orderstatus END AS airline_name,
       'P' || CAST(o_orderkey AS STRING) AS pnr,
       'FX' || CAST(o_orderkey % 997 AS STRING) AS flight_number,
       'City ' || CAST(o_custkey % 25 AS STRING) AS origin,
       'City ' || CAST(o_custkey % 7 AS STRING) || chr(9) AS destination,
       '2024-01-' || CAST(10 + o_orderkey % 20 AS STRING) || ' 14:30' AS scheduled_departure,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Flight Cancellation' WHEN '2-HIGH' THEN 'Denied Boarding'
                            WHEN '3-MEDIUM' THEN 'Delay' WHEN '4-NOT SPECIFIED' THEN 'Cancelled'
                            ELSE 'Other' END AS disruption_type,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            ELSE CAST(o_orderkey % 9 AS STRING) || ' hours before departure' END AS intimation_time,
       'none offered' AS alternate_details,
       CASE o_orderkey % 5 WHEN 0 THEN 'na' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'about 40'
            ELSE '₹1,' || CAST(100 + o_orderkey % 900 AS STRING) || ' ' END AS expense_amount
FROM orders
"""

VIEWS["fx_queries"] = """
SELECT doc_id * 3 + k AS query_id, doc_id,
       CASE (doc_id + k) % 5 WHEN 0 THEN 'Is a refund due after they cancel'
                             WHEN 1 THEN 'delay compensation and hotel hotel'
                             WHEN 2 THEN 'Denied because of overbooking'
                             WHEN 3 THEN 'weather today'
                             ELSE 'facility conditions of ' || lang || ' carriage' END AS query
FROM (SELECT doc_id, lang, 0 AS k FROM documents UNION ALL SELECT doc_id, lang, 1 FROM documents
      UNION ALL SELECT doc_id, lang, 2 FROM documents) AS asked
"""

VIEWS["fx_thresholds"] = """
SELECT r_regionkey AS threshold_id, 30 + 60 * r_regionkey AS min_delay_minutes,
       'benefit_' || CAST(r_regionkey AS STRING) AS entitlement
FROM region
"""

VIEWS["fx_checklist"] = """
SELECT CASE n_nationkey % 4 WHEN 0 THEN 'cancellation' WHEN 1 THEN 'delay'
                            WHEN 2 THEN 'denied_boarding' ELSE 'downgrade' END AS grievance_type,
       CASE WHEN n_nationkey % 3 = 0 THEN 'document' ELSE 'step' END AS kind,
       n_nationkey AS item_no,
       'Item from ' || n_name AS item_text
FROM nation
"""

VIEWS["fx_pages"] = """
SELECT conv_id AS doc_id, turn * 2 AS page_no, text AS page_text FROM conversations
UNION ALL
SELECT conv_id, turn * 2 + 1, CASE WHEN turn % 2 = 0 THEN '' END FROM conversations
"""

VIEWS["fx_field_names"] = """
SELECT p_partkey AS field_id,
       CASE p_size % 8 WHEN 0 THEN 'Was_rebooked' WHEN 1 THEN 'block_time_hours' WHEN 2 THEN 'notice_date'
                       WHEN 3 THEN 'flight_ref' WHEN 4 THEN 'arrival_time' WHEN 5 THEN 'fare_class'
                       ELSE replace(p_name, ' ', '_') END AS field_name,
       CASE p_partkey % 6 WHEN 0 THEN 'Answer Yes/No' WHEN 1 THEN 'The flight number' WHEN 2 THEN 'Time of day'
                          WHEN 3 THEN NULL WHEN 4 THEN 'Update on seats' ELSE p_name END AS field_description
FROM part
"""

VIEWS["fx_tolerant_json"] = """
SELECT event_id,
       CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[broken' WHEN 2 THEN '[]'
            ELSE '["' || event_type || '","k' || CAST(event_id % 4 AS STRING) || '"]' END AS keywords_json,
       CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '' ELSE '{oops' END AS actions_json
FROM events
"""

# Whole documents, with a heading put in after some of their lines.
_HEADINGS = """
         CASE line_no % 12
           WHEN 1 THEN 'Section ' || CAST(doc_id % 3 + 1 AS STRING) || '.' || CAST(line_no % 5 AS STRING)
                       || ': Refund on cancellation'
           WHEN 4 THEN CAST(doc_id % 4 AS STRING) || '.' || CAST(line_no % 3 AS STRING)
                       || '. Delay and hotel facilities'
           WHEN 7 THEN 'GENERAL CONDITIONS OF CARRIAGE'
           WHEN 9 THEN '  '
         END"""

DUCKDB_LINES = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS line_no, line
FROM (
  SELECT doc_id, line_no * 2 AS place, line FROM numbered
  UNION ALL
  SELECT doc_id, line_no * 2 + 1, {_HEADINGS} FROM numbered WHERE line_no % 12 IN (1, 4, 7, 9)
)"""

DUCKDB_NUMBERED = """
SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
       unnest(string_split(text, chr(10))) AS line
FROM documents"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of one folder."""
    used = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", VIEWS[name])) & set(TABLES))
    # tables are handed over by name for this statement alone, so no view of the caller is replaced
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", VIEWS[name].replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def regulation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): whole documents, with headings put in between their lines."""
    doc = F.col("doc_id")

    def with_heading(line, n):
        section = F.concat(
            F.lit("Section "), (doc % 3 + 1).cast("string"), F.lit("."),
            (n % 5).cast("string"), F.lit(": Refund on cancellation"),
        )
        number = F.concat(
            (doc % 4).cast("string"), F.lit("."), (n % 3).cast("string"),
            F.lit(". Delay and hotel facilities"),
        )
        return (
            F.when(n % 12 == 1, F.array(line, section))
            .when(n % 12 == 4, F.array(line, number))
            .when(n % 12 == 7, F.array(line, F.lit("GENERAL CONDITIONS OF CARRIAGE")))
            .when(n % 12 == 9, F.array(line, F.lit("  ")))
            .otherwise(F.array(line))
        )

    lines = F.flatten(F.transform(F.split("text", "\n"), with_heading))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(lines, "\n").alias("text")
    )


def packed_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, extracted): the flat raw views packed into extraction results."""
    bucket = F.floor(F.col("seq") / 100).alias("bucket")
    rules = (
        view(spark, sf_dir, "fx_rules_raw")
        .withColumn(
            "references",
            F.when(
                F.col("ref_text").isNotNull(),
                F.array(F.struct("ref_text", F.lit(None).cast("string").alias("purpose"))),
            ),
        )
        .withColumn(
            "candidate_keywords",
            F.when(F.col("keyword").isNotNull(), F.array("keyword", F.lit("all"))),
        )
        .groupBy(bucket)
        .agg(
            F.collect_list(
                F.struct(
                    "rule_id", "title", "source_para", "scenario_type", "rule_family",
                    "applies_when_text", "does_not_apply_when_text",
                    "passenger_gets_text", "references", "candidate_keywords",
                )
            ).alias("rules")
        )
    )
    scenarios = (
        view(spark, sf_dir, "fx_required_raw")
        .groupBy(bucket, "grievance_type")
        .agg(
            F.collect_list(
                F.struct("fact_key", "description", "importance", "why_needed")
            ).alias("facts")
        )
        .groupBy("bucket")
        .agg(
            F.collect_list(F.struct("grievance_type", "facts")).alias(
                "required_facts_by_scenario"
            )
        )
    )
    path = F.concat(F.lit("doc-"), F.col("bucket").cast("string"))
    error = F.when(F.col("bucket") % 20 == 19, F.lit("partly unreadable"))
    response = F.struct(
        path.alias("document_id"), "required_facts_by_scenario", "rules"
    )
    return rules.join(scenarios, "bucket", "left").select(
        path.alias("path"),
        F.to_json(
            F.struct(error.alias("error_message"), response.alias("response")),
            {"ignoreNullFields": "false"},
        ).alias("extracted"),
    )
