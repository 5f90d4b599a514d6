"""Extraction results kept as they came, in a VARIANT column of a Parquet table.

A text is parsed once, when it is stored; what reads the table opens it by path. A text that is
not JSON is kept beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_extractions(envelopes: DataFrame, folder: str) -> None:
    """(path, extracted JSON) -> a table of (path, extracted VARIANT, unreadable)."""
    opened = F.try_parse_json("extracted")
    envelopes.select(
        "path", opened.alias("extracted"), F.when(opened.isNull(), F.col("extracted")).alias("unreadable")
    ).write.mode("overwrite").parquet(folder)


def read_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table, ready for operators.envelope.decode_envelopes and plans.regulations."""
    return spark.read.schema("path STRING, extracted VARIANT, unreadable STRING").parquet(folder)


def at(path: str, kind: str = "string") -> Column:
    """A value of the stored result by path; null where it is missing or of another kind."""
    return F.try_variant_get("extracted", path, kind)
