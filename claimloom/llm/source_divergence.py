"""How the sources of a language differ in their words, by smoothed integer shares of terms.

Terms of null or other texts are runs of ASCII letters and wider characters, A-Z lower-cased. A
language keeps the terms that at least `MIN_DOCS` of its documents hold. In a group (language and
source, or a language) with N occurrences of kept terms, a kept term with `count` of them has the
share p = 1 + floor(SCALE * (count + 1) / (N + V)), V the number of kept terms; the difference of
a share p from a share q is floor((p - q)^2 / q). All of it is exact integer arithmetic.

Two reports per group: its difference from every other source of the language, summed over all
kept terms, and the terms it uses more than its language does, the first k by difference.

The second is a top-k query over a function that rises with the group's count and falls with the
language's, so it is answered by a dominance skyband: a term that at least k others precede in
group count (as high or higher), language count (as low or lower) and UTF-8 order cannot be
among the first k. Partitions keep their skybands, these are merged sixteen at a time, and only
what is left is ranked.

Terms are dealt to pieces by hash, as many as their entries need, and sources to blocks; the work
of one task is bounded by these and not by a language, a source or a term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import textscan
from claimloom.llm.storage import stored

MIN_DOCS = 3
SCALE = 1_000_000_000
#: Bytes between terms.
_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(b).isalpha() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Entries a task gathers before it sends them, and rows it sends at once.
FLUSH, SENT = 400_000, 1 << 15
#: Counts of terms by source in a piece, about; sources in a block; cells of a dense step.
PIECE, BLOCK, CELLS = 250_000, 256, 1 << 17
#: Skybands merged at once.
FAN = 16


# ---- terms of documents ----------------------------------------------------------------


def _strings(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


class _Counts:
    """Occurrences and documents of terms by group, of some blocks."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.hashes: list[np.ndarray] = []
        self.terms: list[pa.Array] = []
        self.size = 0

    def add(self, data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> None:
        words = textscan.Words(_LOWER[data], offs, _GAPS)
        if not len(words):
            return
        keys, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        n = len(keys)
        per_doc, times = np.unique(words.row_of() * n + of, return_counts=True)
        own, inverse = np.unique(group[per_doc // n] * n + per_doc % n, return_inverse=True)
        occurrences = np.bincount(inverse, times).astype(np.int64)
        self.parts.append((own // n, keys[own % n], occurrences, np.bincount(inverse)))
        raw = words.data.tobytes()
        self.terms.append(pa.array([raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)], pa.binary()))
        self.hashes.append(keys)
        self.size += len(own) + n

    def batches(self, groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        whole = self.batch(groups)
        for k in range(0, whole.num_rows, SENT):  # the other side holds a batch at a time
            yield whole.slice(k, SENT)

    def batch(self, groups: list[tuple[str, str]]) -> pa.RecordBatch:
        group, key, n, docs = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        keys, first = np.unique(np.concatenate(self.hashes), return_index=True)
        code = group * len(keys) + np.searchsorted(keys, key)
        own, inverse = np.unique(code, return_inverse=True)
        terms = pa.concat_arrays(self.terms).take(pa.array(first)).cast(pa.string())
        at = own // len(keys)
        cols = [
            *(pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array([g[k] for g in groups])).dictionary_decode() for k in (0, 1)),
            terms.take(pa.array(own % len(keys))),
            pa.array(np.bincount(inverse, n).astype(np.int64)),
            pa.array(np.bincount(inverse, docs).astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row of null term and zeros for every group."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        counts = _Counts()
        for batch in batches:
            pairs = zip(_strings(batch.column(0)), _strings(batch.column(1)), strict=True)
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            for a, b, data, offs in textscan.blocks(batch.column(2)):
                counts.add(data, offs, group[a:b])
                if counts.size > FLUSH:
                    yield from counts.batches(list(groups))
                    counts = _Counts()
            textscan.release()
        if counts.parts:
            yield from counts.batches(list(groups))
        none = [pa.nulls(len(groups), pa.string()), *[pa.array(np.zeros(len(groups), np.int64))] * 2]
        names = [pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*names, *none], ["lang", "source", "term", "n", "docs"])

    found = rows.mapInArrow(scan, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, counts): the terms a language keeps, with their occurrences by source.

    counts has an entry per source that uses the term, so it is as long as there are sources.
    """
    by_term = counts.where("term is not null").groupBy("lang", "term")
    own = by_term.agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    return own.where(F.col("docs") >= min_docs).drop("docs")


# ---- shares ------------------------------------------------------------------------------


def shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / size), exact for sizes up to 9 * 10^15: three digits at a time."""
    rest, out = np.asarray(count, np.int64) + 1, np.zeros(np.broadcast(count, size).shape, np.int64)
    whole, rest = rest // size, rest % size  # 1 only where a group has a single kept occurrence and term
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // size
        rest = rest % size
    return 1 + whole * SCALE + out


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def skyband(high: np.ndarray, low: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which points fewer than k others dominate: high as high, low as low, order (distinct) earlier.

    Only points that stay need be counted as dominators: the first k dominators of a point, by
    (high, low, order), have fewer than k themselves.
    """
    by = np.lexsort((order, low, -high))
    low, order = low[by], order[by]
    stays = np.zeros(len(by), bool)
    band_low, band_order = low[:0], order[:0]
    for first in range(0, len(by), 512):
        own = slice(first, min(first + 512, len(by)))
        x, y = low[own], order[own]
        before = np.tri(len(x), k=-1, dtype=bool)
        count = (before & (x <= x[:, None]) & (y < y[:, None])).sum(1)
        left = np.flatnonzero(count < k)
        for at in range(0, len(band_low), 2048):
            if not len(left):
                break
            over = (band_low[at : at + 2048] <= x[left, None]) & (band_order[at : at + 2048] < y[left, None])
            count[left] += over.sum(1)
            left = left[count[left] < k]
        stays[by[own][left]] = True
        band_low, band_order = np.append(band_low, x[left]), np.append(band_order, y[left])
    return stays


def _rank(terms: pa.Array) -> np.ndarray:
    """Place of every term in UTF-8 order."""
    by = pc.sort_indices(terms.cast(pa.binary())).to_numpy()
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by))
    return out


_PART = "lang string, source string, piece int, item string, value bigint, high bigint, low bigint"


def _rows(lang: str, source: list, piece: int, item: list | pa.Array, value, high=None, low=None) -> pa.RecordBatch:
    n = len(value)
    item = item if isinstance(item, pa.Array) else pa.array(item, pa.string())
    cols = [pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array(np.full(n, piece, np.int32)), item, pa.array(value, pa.int64())]
    cols += [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (high, low)]
    return pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in _PART.split(", ")])


def _piece(lang: str, piece: int, block: int, terms: pa.Table, groups: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Of a piece of a language's terms: differences of a block of sources from all, and their skybands."""
    groups = groups.sort_by("place")
    names = groups.column("source").to_pylist()
    size, kinds, total = (groups.column(c).to_numpy() for c in ("size", "kinds", "lang_size"))
    mine = range(block * BLOCK, min((block + 1) * BLOCK, len(names)))
    if not len(mine):
        return
    number = {s: j for j, s in enumerate(names)}
    lists = terms.column("counts").combine_chunks()
    entries = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = entries.field("source").dictionary_encode()
    places = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)
    column = places[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    count = entries.field("n").to_numpy()
    p = shares(count, (size + kinds)[column])

    values = np.zeros((len(mine), len(names)), np.int64)
    absent = shares(np.zeros(len(names), np.int64), np.maximum(size + kinds, 1))
    step = max(1, CELLS // len(names))
    for first in range(0, len(lists), step):
        a, b = np.searchsorted(row, [first, first + step])
        dense = np.repeat(absent[None], min(step, len(lists) - first), 0)
        dense[row[a:b] - first, column[a:b]] = p[a:b]
        for k_own, j in enumerate(mine):
            values[k_own] += difference(dense[:, j : j + 1], dense).sum(0)
    for k_own, j in enumerate(mine):
        others = np.flatnonzero(np.arange(len(names)) != j)
        yield _rows(lang, [names[j]] * len(others), -1, [names[o] for o in others], values[k_own][others])

    if not len(lists):
        return
    text = terms.column("term").combine_chunks()
    order, low = _rank(text), terms.column("total").to_numpy()
    q = shares(low, total[0] + kinds[0])
    over = np.flatnonzero(p > q[row])
    over = over[np.argsort(column[over], kind="stable")]
    cut = np.searchsorted(column[over], np.arange(len(names) + 1))
    for j in mine:
        at = over[cut[j] : cut[j + 1]]
        at = at[skyband(count[at], low[row[at]], order[row[at]], k)]
        yield _rows(lang, [names[j]] * len(at), piece, text.take(pa.array(row[at])), difference(p[at], q[row[at]]), count[at], low[row[at]])


def _merged(bands: DataFrame, k: int) -> DataFrame:
    """The skyband of each group's pieces, merged FAN at a time."""

    def merge(table: pa.Table) -> pa.Table:
        high, low = table.column("high").to_numpy(), table.column("low").to_numpy()
        return table.filter(pa.array(skyband(high, low, _rank(table.column("item").combine_chunks()), k)))

    own = bands.withColumn("piece", F.floor(F.col("piece") / FAN).cast("int"))
    return own.groupBy("lang", "source", "piece").applyInArrow(merge, _PART)


def divergence(
    docs: DataFrame,
    k: int = 200,
    min_docs: int = MIN_DOCS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source.

    part 'pair': every other source of the language, value the difference from it over all kept
    terms (0 where the language keeps none), all ranks. part 'term': the first k kept terms that
    the group uses, with a greater share than the language's. Ranks count from 1 by value
    descending and item ascending in UTF-8 order.

    Null text, language and source count as ''. Repeated rows count each. A group without terms
    is a group. A language of one source has no pairs, and no terms above its own share. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = stored(kept_terms(counts, min_docs), "divergence-terms")
    uses = kept.select("lang", F.explode("counts").alias("use")).select("lang", "use.source", "use.n")
    sizes = counts.where("term is null").select("lang", "source", F.lit(0).cast("bigint").alias("n")).unionByName(uses)
    sizes = sizes.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_size"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = sizes.join(langs, "lang", "left").na.fill(0, ["kinds", "lang_size"]).withColumn("place", F.row_number().over(by_source) - 1)
    groups = stored(groups, "divergence-groups")  # a row per source of a language

    entries = kept.agg(F.sum(F.size("counts"))).first()[0] or 0
    pieces = 1 + entries // PIECE
    blocks = 1 + (groups.agg(F.max("place")).first()[0] or 0) // BLOCK

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    left = dealt(kept.withColumn("piece", F.pmod(F.xxhash64("term"), F.lit(pieces)).cast("int")))
    right = dealt(groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))))

    def work(key: tuple, terms: pa.Table, own: pa.Table) -> pa.Table:
        lang, piece, block = (x.as_py() for x in key)
        found = pa.Table.from_batches(list(_piece(lang, piece, block, terms, own, k)) or [_rows(lang, [], 0, [], [])])
        textscan.release()
        return found

    keys = ("lang", "piece", "block")
    found = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, _PART), "divergence-parts")
    bands = found.where("piece >= 0")
    while pieces > 1:
        bands, pieces = _merged(bands, k), -(-pieces // FAN)

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit(part))

    pairs = found.where("piece < 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = ranked(bands.select("lang", "source", "item", "value"), "term").where(F.col("rank") <= k)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return reduce(DataFrame.unionByName, [ranked(pairs, "pair").select(*columns), terms.select(*columns)])
