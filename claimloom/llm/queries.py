"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import (
    chat_format,
    decontaminate,
    line_dedup,
    mixing,
    periodic_runs,
    sentence_pieces,
    simhash_dedup,
    source_divergence,
    substring_dedup,
    token_files,
    topk_search,
    toxicity,
    url_filter,
)
from claimloom.llm.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(
        F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id")
    )


#: Score from which a document is taken as toxic.
TOXIC = 0.3


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, net)
    predicted = (F.col("score") >= TOXIC).cast("int")
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", predicted.alias("predicted"))


@query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)
    return found.withColumnRenamed("id", "doc_id")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "times")


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    # two fixed rows stand beside the table's: the conversation that the contract adds
    both = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string"
    )
    chats = chat_format.formatted(rows.unionByName(both))
    return chat_format.read_back(chats).withColumnRenamed("id", "conv_id")


@query
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.checksums(token_files.read_tokens(spark, path))


@query
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    found = url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, RULES)
    return found.withColumnRenamed("id", "page_id")


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    ids = F.concat_ws(" ", F.col("tokens").cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by its id's checksum, repeats some of its words from a place on to its end."""
    code = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", code.alias("code"))
    rows = rows.withColumn("words", F.when(F.col("code") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("code") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    mended = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(mended, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", periodic_runs.best(F.col("runs")))
    start, length, period = (F.col("best")[c] for c in ("start", "length", "period"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"), k=200)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op8_lines": f"""
            WITH lines AS (
                SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
                FROM documents
            ), boilerplate AS (
                SELECT trim(line) AS line FROM lines WHERE trim(line) <> ''
                GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
            ), marked AS (
                SELECT doc_id, place, l.line, b.line IS NOT NULL AS gone
                FROM lines l LEFT JOIN boilerplate b ON trim(l.line) = b.line
            )
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op13_divergence": f"""
            WITH docs AS (
                SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
                FROM documents
            ), words AS (
                SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
            ), kept AS (
                SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {source_divergence.MIN_DOCS}
            ), used AS (
                SELECT w.lang, source, term, count(*) AS n FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
            ), langs AS (
                SELECT lang, count(*) + sum(n) AS size FROM kept GROUP BY ALL
            ), sources AS (
                SELECT d.lang, d.source, coalesce(v, 0) + coalesce(n, 0) AS size
                FROM (SELECT DISTINCT lang, source FROM docs) d
                LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) v ON v.lang = d.lang
                LEFT JOIN (SELECT lang, source, sum(n) AS n FROM used GROUP BY ALL) u ON u.lang = d.lang AND u.source = d.source
            ), every AS (
                SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n,
                       1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 1) // s.size AS p,
                       1 + 1000000000::HUGEINT * (k.n + 1) // l.size AS q
                FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
                LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term
            ), parts AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 
                       sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN every x ON x.lang = a.lang AND x.source = a.source
                LEFT JOIN every y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
                WHERE x.term IS NULL OR y.term IS NOT NULL
                GROUP BY ALL
                UNION ALL
                SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM every WHERE n > 0 AND p > q
            )
            SELECT lang, source, part, item, CAST(coalesce(value, 0) AS BIGINT) AS value,
                   CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item) AS INTEGER) AS rank
            FROM parts QUALIFY part = 'pair' OR rank <= 200""",
        "op10_topk": """
            WITH vectors AS (
                SELECT vec_id, [floor(256.0::DOUBLE * x::DOUBLE) for x in embedding] AS vec
                FROM embeddings
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
                FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
            )
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    }
