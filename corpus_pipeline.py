"""A training corpus in five stages, each one operator of claimloom.llm over all rows it is given.

run(spark, sf_dir) applies them to the documents table. A stage's result is written as Parquet
below spark.checkpoint.dir and read again by the next one. Every stage but the last returns the
columns of documents. Nulls, empty texts, repeated rows and empty tables pass as each operator
defines; further columns of documents are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, mixing, simhash_dedup, token_files, toxicity
from claimloom.llm.queries import TOXIC, table, tokenizer_path
from claimloom.llm.storage import new_path, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network accepts; it is fitted to the labelled ones among all documents."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, net, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest doc_id, null last."""
    return simhash_dedup.keep_first(docs, shingle_words=3, max_bits=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark and are no cut copy of an item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), short=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' content, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path, tokenizer_path())
    return token_files.checksums(token_files.read_tokens(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: The network's scores, XXH64 fingerprints and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
