"""Text helpers built from JVM-side functions only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as
# white space (SQL trim removes the space character only).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same set inside a Java character class, with and without the newline.
SPACE_CLASS = (
    r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS_IN_LINE = SPACE_CLASS.replace(r"\n", "")


def strip(text: Column) -> Column:
    """Remove Unicode white space on both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def words(text: Column) -> Column:
    """Split on runs of Unicode white space, without empty words."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters, digits, underscore and dot."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_.]+"), F.lit(0)
    )
    return F.array_distinct(found)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def count_of(text: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty term."""
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (removed / F.length(term)).cast("bigint")


def numbered(items: Column) -> Column:
    """Turn an array of texts into lines '1. ...', each ended by a newline."""
    lines = F.transform(
        items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))
    )
    return F.array_join(lines, "")
