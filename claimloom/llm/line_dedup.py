"""Removal of boilerplate lines by the number of distinct sites that carry them.

Every line hash gets a HyperLogLog sketch of its sites; sketches are built per task and merged
by aggregation, so a line of any frequency costs one small sketch per task. Estimates decide
the lines far from the threshold. Lines within the sketch's error of it get an exact distinct
count, from (line, site) pairs that are combined before the shuffle. Lines on enough sites are
removed from all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.storage import stored

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 5
#: log2 of the sketch's registers; the relative standard error is 1.04 / sqrt(2^LG_K).
LG_K = 12
#: Estimates within this many standard errors of the threshold are counted exactly.
ERRORS = 5


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc, tag, place, h1, h2, site) of every line that is not blank; h1 and h2 hash the trimmed line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("doc"),
        F.hash(text).alias("tag"),
        F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(text, "\n")).alias("place", "line"),
    ).withColumn("line", F.trim("line"))
    return own.where("line <> ''").select(
        "doc", "tag", "place", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "site"
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines on at least min_sites distinct sites. A null site is no site."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1, math.ceil(ERRORS * 1.04 / math.sqrt(1 << LG_K) * min_sites))
    spread = stored(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    sure = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = spread.where(F.col("sites") <= min_sites + margin).select("h1", "h2")
    pairs = lines.where("site is not null").join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").count()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))


def remove_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """(id, n_lines, n_removed, kept): the text without its boilerplate lines, whole lines otherwise unchanged.

    Lines end at `\\n` and are compared without surrounding blanks; blank lines always stay. A
    null text counts as empty: one blank line. Rows that share an id are told apart by their
    text; repeated rows get the same result. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    lines = stored(line_table(docs, id_col, text_col, site_col), "lines")
    gone = lines.join(boilerplate(lines, min_sites), ["h1", "h2"], "left_semi")
    places = gone.groupBy("doc", "tag").agg(F.collect_set("place").alias("places")).withColumnsRenamed({"doc": "d", "tag": "t"})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))
    both = rows.join(places, rows.doc.eqNullSafe(places.d) & (rows.tag == places.t), "left")
    kind = rows.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                own = text.as_py().split("\n")
                drop = set(places.as_py() or ())
                stay = [x for k, x in enumerate(own) if k not in drop] if drop else own
                counts.append(len(own))
                removed.append(len(own) - len(stay))
                kept.append("\n".join(stay))
            cols = [batch.column(0), pa.array(np.array(counts, np.int64)), pa.array(np.array(removed, np.int64)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_lines", "n_removed", "kept"])

    schema = f"id {kind}, n_lines bigint, n_removed bigint, kept string"
    return both.select("doc", "text", "places").mapInArrow(cut, schema)
