"""SimHash near duplicates by deletion-variant signatures.

Fingerprints at most `max_bits` apart are linked. 64 bits are cut into so few segments that,
of two linked fingerprints, one segment differs in one bit at most. Each segment is indexed
once per bit with that bit wiped out: two segments that differ in one bit or none share such
a variant, so an equality grouping finds every link. Groups are verified on the whole
fingerprint. Equal fingerprints are one node from the start, so a group of copies of any size
is one row in the index.

Within a group, neighbours in sorted order are compared first; where that does not already
connect the group, blocks of all members are compared inside the task and only a spanning
star leaves it. A group over `SPLIT` members is not compared there: its members are indexed
once more, by the same variants of the bits outside the shared segment. What still is over
the limit then differs in so few bits that the neighbours of a member are listed by flipping
up to `max_bits` of them and looked up. Every path finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.components import connected_components
from claimloom.llm.storage import stored

SPLIT = 4096
_LINK, _HELD = 0, 1


# ---- fingerprints ------------------------------------------------------------------


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The SimHash of a whole text; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(shingle_words, len(words)) - 1 :]
    votes, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, n, step):
        own = map(line.__getitem__, map(slice, starts[k : min(n, k + step)].tolist(), ends[k : k + step].tolist()))
        codes = np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(42)), np.uint64)
        votes += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, code, fingerprint) of every row; code hashes the text, the 64 bits are a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits.view(np.int64))], ["id", "code", "fingerprint"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("code"), text.alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(scan, f"id {kind}, code bigint, fingerprint bigint")


# ---- index -------------------------------------------------------------------------


def segments(width: int, max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which one differs by one bit at most."""
    n = max(2, max_bits // 2 + 1)
    cuts = [round(k * width / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(bits: np.ndarray, width: int, max_bits: int) -> tuple[np.ndarray, int]:
    """One key per value and wiped bit: rows of keys, and the bits a key takes."""
    out = []
    parts = segments(width, max_bits)
    wide = max(w for _, w in parts)
    for offset, w in parts:
        part = (bits >> np.uint64(offset)) & np.uint64((1 << w) - 1)
        for k in range(w):
            tag = np.uint64((offset + k) << wide)
            out.append(tag | (part & ~np.uint64(1 << k)))
    return np.stack(out, axis=1), wide + 6


def _outside(prints: np.ndarray, keys: np.ndarray, max_bits: int) -> tuple[np.ndarray, int]:
    """The bits outside the segment a first-level key was made from, packed together."""
    parts = segments(64, max_bits)
    wide = max(w for _, w in parts)
    tag = (keys >> np.uint64(wide)).astype(np.int64)
    out = np.zeros(len(prints), np.uint64)
    for offset, w in parts:
        own = (tag >= offset) & (tag < offset + w)
        low = prints[own] & np.uint64((1 << offset) - 1)
        high = prints[own] >> np.uint64(offset + w) if offset + w < 64 else np.zeros(own.sum(), np.uint64)
        out[own] = low | (high << np.uint64(offset))
    return out, 64 - min(w for _, w in parts)


# ---- links within a group ----------------------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable by links (a, b) among n members."""
    root = np.arange(n)
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links_of(members: np.ndarray, max_bits: int) -> np.ndarray:
    """The root of each of a group's sorted distinct fingerprints, by comparing blocks."""
    a, b = [], []
    for k in range(0, len(members), 512):
        near = np.bitwise_count(members[k : k + 512, None] ^ members[None, k:]) <= max_bits
        x, y = np.nonzero(near)
        a.append(x + k)
        b.append(y + k)
    return _roots(len(members), np.concatenate(a), np.concatenate(b))


def _links_by_flips(members: np.ndarray, max_bits: int) -> np.ndarray:
    """The same for a large group of members that differ in few bits: look the flips up."""
    spread = int(np.bitwise_or.reduce(members ^ members[0]))
    free = [k for k in range(64) if spread >> k & 1]
    a, b = [], []
    for size in range(1, max_bits + 1):
        for bits in combinations(free, size):
            flipped = members ^ np.uint64(sum(1 << k for k in bits))
            at = np.minimum(np.searchsorted(members, flipped), len(members) - 1)
            hit = np.flatnonzero((members[at] == flipped) & (flipped > members))
            a.append(hit)
            b.append(at[hit])
    return _roots(len(members), np.concatenate(a), np.concatenate(b))


def _stars(keys: np.ndarray, prints: np.ndarray, max_bits: int, last: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """Links (member, root) of whole groups, and the groups that go to the next level."""
    same = keys[1:] == keys[:-1]
    near = same & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= max_bits)
    first = np.flatnonzero(np.concatenate(([True], ~near)))
    chain = np.repeat(first, np.diff(np.append(first, len(keys))))  # the chain's first member
    a, b, held = [prints[chain != np.arange(len(keys))]], [prints[chain[chain != np.arange(len(keys))]]], []
    begin = np.flatnonzero(np.concatenate(([True], ~same)))
    end = np.append(begin[1:], len(keys))
    broken = np.add.reduceat(np.concatenate(([0], (same & ~near).astype(np.int64))), begin) > 0
    for s, e in zip(begin[broken].tolist(), end[broken].tolist(), strict=True):
        own = prints[s:e]
        if e - s > SPLIT and not last:
            held.append((keys[s], own))
            continue
        root = (_links_by_flips if e - s > SPLIT else _links_of)(own, max_bits)
        out = root != np.arange(len(own))
        a.append(own[out])
        b.append(own[root[out]])
    return np.concatenate(a), np.concatenate(b), held


def _linker(max_bits: int, last: bool):
    """Arrow stage over partitions sorted by (key, fingerprint): links, and groups held over.

    A group runs over batch ends. One that exceeds the limit on the first level is passed on
    as it streams by, so the memory needed stays that of one batch and one group under the limit.
    """

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        cols = [np.full(len(a), kind, np.int8), a.view(np.int64), b.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_p = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        passing: np.uint64 | None = None  # key of a group already found too large
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            p = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if passing is not None:
                n = int((k == passing).argmin()) if not (k == passing).all() else len(k)
                yield out(_HELD, k[:n], p[:n])
                k, p = k[n:], p[n:]
                if not len(k):
                    continue
                passing = None
            k, p = np.concatenate((rest_k, k)), np.concatenate((rest_p, p))
            if not len(k):
                continue
            tail = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            if tail:
                a, b, held = _stars(k[:tail], p[:tail], max_bits, last)
                yield out(_LINK, a, b)
                for key, own in held:
                    yield out(_HELD, np.full(len(own), key, np.uint64), own)
            rest_k, rest_p = k[tail:], p[tail:]
            if len(rest_k) > SPLIT and not last:
                passing = rest_k[0]
                yield out(_HELD, rest_k, rest_p)
                rest_k, rest_p = rest_k[:0], rest_p[:0]
        if len(rest_k):
            a, b, held = _stars(rest_k, rest_p, max_bits, last)
            yield out(_LINK, a, b)
            for key, own in held:
                yield out(_HELD, np.full(len(own), key, np.uint64), own)

    return scan


def _index(max_bits: int, second: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            for s in range(0, batch.num_rows, 4096):
                p = cols[-1][s : s + 4096]
                if second:
                    first = cols[0][s : s + 4096]
                    bits, width = _outside(p, first, max_bits)
                    keys, _ = variants(bits, width, max_bits)
                    keys = _join_keys(first[:, None], keys)
                else:
                    keys, _ = variants(p, 64, max_bits)
                flat = keys.reshape(-1)
                own = np.repeat(p, keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(own.view(np.int64))], ["key", "print"])

    return scan


def _join_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two keys as one value of 64 bits; a clash only merges groups, links are verified."""
    return (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that span every set of distinct fingerprints connected by small distances."""
    key = "key bigint, print bigint"
    kinds = "kind tinyint, a bigint, b bigint"
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def level(rows: DataFrame, second: bool) -> DataFrame:
        keyed = rows.mapInArrow(_index(max_bits, second), key)
        dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "print")
        return stored(dealt.mapInArrow(_linker(max_bits, second), kinds), "simhash-links")

    first = level(prints.select("fingerprint"), False)
    held = first.where(F.col("kind") == _HELD).select("a", "b")
    found = first.where(F.col("kind") == _LINK)
    if held.limit(1).count():
        found = found.unionByName(level(held, True))
    return found.where(F.col("kind") == _LINK).select("a", "b").distinct()


def _nodes(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fingerprint, least, root) of every distinct fingerprint; least is the smallest id that has it."""
    prints = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    roots = connected_components(links(prints, max_bits))
    nodes = prints.join(roots, prints.fingerprint == roots.node, "left").select(
        prints.fingerprint, "least", F.coalesce("root", "fingerprint").alias("root")
    )
    return stored(nodes, "simhash-nodes")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3
) -> DataFrame:
    """(id, fingerprint, component) of every row of docs; component is the smallest id reachable.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    stay, each with the same result. A null id gets a row as well; it is never a component's
    id unless all ids of the component are null. An empty table gives an empty result. Other
    columns are not read, whatever their names.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    nodes = _nodes(rows, max_bits)
    heads = nodes.groupBy("root").agg(F.min("least").alias("component"))
    classes = nodes.join(heads, "root").select("fingerprint", "component")
    return rows.join(classes, "fingerprint").select("id", "fingerprint", "component")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row of every component, unchanged: that of the smallest id, null ids last.

    Of several texts with that id the one of the smallest hash stays. Rows equal in id and text
    are one document; if they differ in other columns, any of them stands for it.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    nodes = _nodes(rows, max_bits).select("fingerprint", "root")
    place = F.struct(F.col("id").isNull(), "id", "code")
    heads = rows.join(nodes, "fingerprint").groupBy("root").agg(F.min(place).alias("first"))
    heads = heads.select(F.col("first.id").alias("__head_id"), F.col("first.code").alias("__head_code"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__id": F.col(id_col), "__code": F.xxhash64(text)})
    same = F.col("__id").eqNullSafe(F.col("__head_id")) & (F.col("__code") == F.col("__head_code"))
    kept = keyed.join(heads, same, "left_semi").dropDuplicates(["__id", "__code"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
