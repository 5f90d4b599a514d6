"""Joins on keys with few values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that every value of a key is spread over.
PIECES = 64


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", pieces: int = PIECES
) -> DataFrame:
    """Join many rows with a small table on keys of few values.

    Where the planner finds the table small enough it is broadcast as in any join. Where it
    does not, a plain join would send all rows of a value to one task; so the rows are dealt
    to pieces by a hash of `by`, and the table is repeated once per piece.
    """
    piece: Column = F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    joined = rows.withColumn("__piece", piece).join(table.withColumn("__piece", copies), [*keys, "__piece"], how)
    return joined.drop("__piece")
