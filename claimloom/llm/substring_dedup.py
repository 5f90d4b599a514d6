"""Removal of repeated passages, found by difference-cover anchors.

A window is `WINDOW` consecutive words; it is repeated when the same words also start earlier
(in a document of smaller id, or earlier in the same one). Every word under a repeated window
is removed; windows are judged on the input.

Positions are taken modulo `PERIOD`, and only windows of `ANCHOR` words at the positions of a
difference cover are hashed: for any two positions there is a shift below the period that takes
both into the cover, and PERIOD + ANCHOR - 1 = WINDOW, so any two equal windows hold an equal
anchor at the same shift. Anchors that occur once are dropped. Around the others the match is
extended: the whole windows that hold them are hashed, and of each the earliest place is kept.

Hashes travel packed, a row per map batch and bucket, as plain integer arrays. Before the
shuffle a batch settles what it can by itself (a hash that occurs twice in it is repeated; all
but its earliest window are), and sends one entry per hash, so a passage that fills a third of
the corpus costs a bucket one entry per batch. Texts are shuffled once, by document, and that
exchange serves both joins. A window is identified by 64 bits and its bucket, drawn from a
second hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import textscan

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Entries a map batch gathers before it sends them.
FLUSH = 3_000_000
#: Stands for a null id, which sorts last; the sign of a row's tag tells it from a real id of that value.
NO_ID = 2**63 - 1

_PACKED = "bucket int, kind tinyint, docs binary, tags binary, counts binary, places binary, keys binary, more binary"
_FOUND = "doc bigint, tag int, places binary"
_ENTRIES, _SETTLED = 0, 1


class Entries:
    """Parallel arrays of places: document, tag of its text, position, key, bucket."""

    def __init__(self, doc, tag, place, key, bucket, known):
        self.doc, self.tag, self.place, self.key, self.bucket, self.known = doc, tag, place, key, bucket, known

    def __len__(self) -> int:
        return len(self.doc)

    def __getitem__(self, at) -> Entries:
        return Entries(*(x[at] for x in (self.doc, self.tag, self.place, self.key, self.bucket, self.known)))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _pack(e: Entries, kind: int) -> Iterator[list]:
    """A row per bucket; entries in order of document, tag and place."""
    order = np.lexsort((e.place, e.tag, e.doc, e.bucket))
    e = e[order]
    cut = _runs(e.bucket)
    for s, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = e[slice(s, t)]
        at = _runs(own.doc, own.tag)
        first = at[:-1]
        place = np.diff(own.place, prepend=0).astype(np.int32)
        place[first] = own.place[first]
        key = own.key if kind == _ENTRIES else own.key[:0]
        yield [
            int(own.bucket[0]),
            kind,
            np.diff(own.doc[first], prepend=0).tobytes(),
            own.tag[first].tobytes(),
            np.diff(at).astype(np.int32).tobytes(),
            place.tobytes(),
            key.tobytes(),
            np.packbits(own.known).tobytes() if own.known.any() else b"",
        ]


def _unpack(row: dict) -> Entries:
    count = np.frombuffer(row["counts"], np.int32)
    first = np.cumsum(count) - count
    step = np.frombuffer(row["places"], np.int32).astype(np.int64)
    total = np.cumsum(step)
    base = np.concatenate(([0], total))[first]  # sum of all steps before a document
    place = (total - np.repeat(base, count)).astype(np.int32)
    doc = np.repeat(np.cumsum(np.frombuffer(row["docs"], np.int64)), count)
    tag = np.repeat(np.frombuffer(row["tags"], np.int32), count)
    key = np.frombuffer(row["keys"], np.uint64) if row["keys"] else np.zeros(len(doc), np.uint64)
    known = np.unpackbits(np.frombuffer(row["more"], np.uint8), count=len(doc)).astype(bool) if row["more"] else np.zeros(len(doc), bool)
    return Entries(doc, tag, place, key, np.full(len(doc), row["bucket"], np.int32), known)


def _batch(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int8(), *[pa.binary()] * 6]
    names = [f.split(" ")[0] for f in _PACKED.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)


def _found(e: Entries) -> pa.RecordBatch:
    """A row per document with the places found in it."""
    e = e[np.lexsort((e.place, e.tag, e.doc))]
    at = _runs(e.doc, e.tag)
    offs = (at * 4).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offs), pa.py_buffer(e.place.astype(np.int32).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(e.doc[at[:-1]]), pa.array(e.tag[at[:-1]]), places], ["doc", "tag", "places"])


def _all(parts: list[Entries]) -> Entries:
    return Entries(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("doc", "tag", "place", "key", "bucket", "known")))


def _home(e: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places found, packed by a hash of their document."""
    if len(e):
        code = textscan.mix(e.doc.view(np.uint64) ^ e.tag.astype(np.uint64))
        e.bucket = (code % np.uint64(buckets)).astype(np.int32)
        e.known = np.zeros(len(e), bool)
        for row in _pack(e, _SETTLED):
            yield _batch([row])


# ---- what a batch and a bucket settle ------------------------------------------------


def _repeated_anchors(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch's anchors: which are repeated in it, and which to send (one per hash)."""
    order = np.lexsort((e.key, e.bucket))
    cut = _runs(e.bucket[order], e.key[order])
    size = np.diff(cut)
    twice = np.zeros(len(e), bool)
    twice[order] = np.repeat(size > 1, size)
    send = np.zeros(len(e), bool)
    send[order[cut[:-1]]] = True
    return twice, send


def _later_windows(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of windows: which have an earlier equal one in it, and the others."""
    no_id = e.tag < 0
    order = np.lexsort((e.place, no_id, e.doc, e.key, e.bucket))
    cut = _runs(e.bucket[order], e.key[order])
    first = np.repeat(order[cut[:-1]], np.diff(cut))
    later = np.zeros(len(e), bool)
    other = (e.doc[order] != e.doc[first]) | (no_id[order] != no_id[first])
    later[order] = other | (e.place[order] != e.place[first])
    return later, ~later


def _settle(rows: DataFrame, gather: Callable, judge: Callable, buckets: int) -> DataFrame:
    """Map batches gather entries and settle what they can; buckets settle the rest.

    Returns (doc, tag, places), a row per document with any. What is found goes home packed by
    a hash of the document, so no task sends more rows than there are buckets.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        seen: set = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            e = _all(held)
            settled, out = judge(e)
            e.known = settled  # an entry whose place is settled only speaks for its hash
            for row in _pack(e[out], _ENTRIES):
                yield _batch([row])
            yield from _home(e[settled], buckets)

        for batch in batches:
            for e in gather(batch, seen, buckets):
                held.append(e)
                size += len(e)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
                    seen.clear()
        if size:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Entries] = []
        for batch in batches:
            for row in batch.to_pylist():
                e = _unpack(row)
                if row["kind"] == _SETTLED:
                    yield _batch([list(row.values())])
                else:
                    own.append(e)
        if own:
            e = _all(own)
            yield from _home(e[judge(e)[0] & ~e.known], buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_unpack(row) for batch in batches for row in batch.to_pylist()]
        if own:
            yield _found(_all(own))

    packed = rows.mapInArrow(send, _PACKED).repartitionById(buckets, F.col("bucket"))
    return packed.mapInArrow(settle, _PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(merge, _FOUND)


# ---- anchors and windows of a batch --------------------------------------------------


def _fresh(doc: np.ndarray, tag: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose (doc, tag) this batch has not had: repeated rows are one document."""
    out = np.zeros(len(doc), bool)
    for k, pair in enumerate(zip(doc.tolist(), tag.tolist(), strict=True)):
        if pair not in seen:
            seen.add(pair)
            out[k] = True
    return out


def _anchors(batch: pa.RecordBatch, seen: set, buckets: int) -> Iterator[Entries]:
    doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    fresh = _fresh(doc, tag, seen)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for a, _, data, offs in textscan.blocks(batch.column(2)):
        words = textscan.Words(data, offs)
        key = textscan.windows(words.hashes(), ANCHOR)
        row = words.row_of()[: len(key)]
        place = np.arange(len(key)) - words.rows[row]
        at = np.flatnonzero(textscan.inside(words.rows, ANCHOR) & cover[place % PERIOD] & fresh[a + row])
        key, row = key[at], row[at] + a
        # 40 bits beside the bucket suffice to find candidates: the rest compresses away
        bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        yield Entries(doc[row], tag[row], place[at].astype(np.int32), key & np.uint64((1 << 40) - 1), bucket, np.zeros(len(at), bool))


def _positions(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All int32 values in a column of binaries, with the row of each."""
    size = pc.binary_length(places).fill_null(0).to_numpy() // 4
    data, _ = textscan.buffers(places)
    return np.repeat(np.arange(len(places)), size), np.frombuffer(data.tobytes(), np.int32)


def _covered(words: textscan.Words, first: int, row: np.ndarray, place: np.ndarray, before: int, after: int) -> np.ndarray:
    """Words of a block from `before` ahead of to `after` past any of the given places."""
    at, to = np.searchsorted(row, [first, first + len(words.rows) - 1])
    row, place = row[at:to] - first, place[at:to].astype(np.int64)
    begin = np.maximum(place - before, 0) + words.rows[row]
    end = np.minimum(place + words.rows[row] + after, words.rows[row + 1])
    n = len(words) + 1
    return np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0


def _windows(batch: pa.RecordBatch, seen: set, buckets: int) -> Iterator[Entries]:
    doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    fresh = _fresh(doc, tag, seen)
    hit_row, hit_place = _positions(batch.column(3))
    for a, _, data, offs in textscan.blocks(batch.column(2)):
        words = textscan.Words(data, offs)
        hashes = words.hashes()
        key = textscan.windows(hashes, WINDOW)
        near = _covered(words, a, hit_row, hit_place, WINDOW - ANCHOR, 1)[: len(key)]
        row = words.row_of()[: len(key)]
        at = np.flatnonzero(near & textscan.inside(words.rows, WINDOW) & fresh[a + row])
        second = textscan.windows(hashes, WINDOW, 2)[at]
        place = (at - words.rows[row[at]]).astype(np.int32)
        row = row[at] + a
        bucket = (second % np.uint64(buckets)).astype(np.int32)
        yield Entries(doc[row], tag[row], place, key[at], bucket, np.zeros(len(at), bool))


def _removed(batch: pa.RecordBatch) -> Iterator[tuple[int, textscan.Words, np.ndarray, int]]:
    hit_row, hit_place = _positions(batch.column(3))
    for a, b, data, offs in textscan.blocks(batch.column(2)):
        words = textscan.Words(data, offs)
        yield a, words, _covered(words, a, hit_row, hit_place, 0, WINDOW), b


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): kept is the words that stay, joined by one space.

    Null and empty texts have no words and give an empty kept. Ids are whole numbers; a null id
    comes after all others. Rows that share an id (or have none) are one document for the order:
    a window is not repeated by one at the same place of another row of that id. Repeated rows each get
    the same result. A text shorter than a window keeps all its words. An empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID).cast("bigint")).alias("doc"),
        F.when(F.col(id_col).cast("bigint").isNull(), F.hash(text).bitwiseOR(F.lit(-(2**31))))
        .otherwise(F.hash(text).bitwiseAND(F.lit(2**31 - 1)))
        .cast("int")
        .alias("tag"),
        text.alias("text"),
    )

    def named(found: DataFrame) -> DataFrame:
        return found.withColumnsRenamed({"doc": "d", "tag": "t"})

    anchors = named(_settle(rows.select("doc", "tag", "text"), _anchors, _repeated_anchors, buckets))
    # one exchange of the texts serves both joins, so both take the same columns
    near = rows.join(anchors, (rows.doc == anchors.d) & (rows.tag == anchors.t)).select("doc", "tag", "text", "places")
    repeats = named(_settle(near, _windows, _later_windows, buckets))
    final = rows.join(repeats, (rows.doc == repeats.d) & (rows.tag == repeats.t), "left")
    final = final.select("doc", "tag", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ids = [None if tag < 0 else doc for doc, tag in pairs]
            for a, words, gone, b in _removed(batch):
                raw = words.data.tobytes()
                out = []
                for k in range(b - a):
                    s, e = int(words.rows[k]), int(words.rows[k + 1])
                    if gone[s:e].any():
                        keep = np.flatnonzero(~gone[s:e]) + s
                        kept = b" ".join([raw[i:j] for i, j in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
                        n = len(keep)
                    else:
                        kept, n = b" ".join(raw[words.offs[k] : words.offs[k + 1]].split()), e - s
                    out.append((ids[a + k], e - s, e - s - n, kept.decode()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "kept"])

    return final.mapInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
