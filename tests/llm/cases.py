"""Awkward small tables, and plain versions of what the operators compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(45))


def words(n: int, salt: str) -> str:
    return " ".join(f"{salt}{(k * 7919) % 1013}" for k in range(n))


ROWS = [
    (1, "one two three four", "en", "b", 18),
    (2, "One  TWO\tthree\nfour", "en", "a", 18),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "en", "", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, words(120, "p"), "en", "b", 1),
    (7, words(120, "p"), "en", "b", 1),
    (8, words(120, "p") + " end", "de", "c", 1),
    (9, words(30, "q") + " " + PASSAGE + " " + words(30, "r"), "en", "c", 1),
    (10, PASSAGE.upper() + "\n" + PASSAGE, "en", None, 1),
    (None, words(120, "p"), "en", "b", 1),
    (None, "only here, and a null id", None, "é", 1),
    (11, "naïve café 中文 \U0001f600 '́x can't 3.14 a.b", "fr", "é", 1),
    (12, "x " * 60, "en", "a", 1),
]


def documents(spark: SparkSession, rows=ROWS, parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df: DataFrame) -> DataFrame:
    """More columns, named like those that operators use inside."""
    names = ["id", "doc", "tag", "size", "h", "key", "fingerprint", "component", "score", "target", "s", "root", "node", "u", "v", "places"]
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
