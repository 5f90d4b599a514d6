"""Benchmark decontamination by SimHash over item-sized windows.

For an item of n words every window of n words of a document is a candidate. Windows and items
have a SimHash of 128 bits over their words, weighted by count. Items are indexed by the blocks
of their fingerprint, each also with any one bit flipped: with `BLOCKS` blocks and a radius
below twice their number, two fingerprints within the radius agree in some block up to one
bit, so the lookup returns all of them. Those within the radius are verified by the exact
weighted similarity of five-word shingles: the sum of the smaller over the sum of the larger
counts. Windows that hold no shingle of any item have similarity zero to all and get no
fingerprint. On request a document of fewer words than an item is compared with it too, its
whole text being the one window.

Words are runs of letters, digits and wider characters, lower-cased, so punctuation and case
do not hide a passage. The benchmark is the stated query set: it is taken in blocks of a
bounded size, each going over all documents where they lie, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import textscan

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 16
RADIUS = 2 * BLOCKS - 1
#: Bytes of benchmark text held at once; more is taken in several blocks of items.
BENCHMARK_BYTES = 16 << 20
_CUTS = [round(k * 128 / BLOCKS) for k in range(BLOCKS + 1)]
_FILTER_BITS = 22
#: Candidates of a stretch compared at once.
_PAIRS = 1 << 20


def _words(column: pa.Array) -> Iterator[tuple[int, int, textscan.Words, np.ndarray]]:
    for a, b, data, offs in textscan.blocks(pc.utf8_lower(column.fill_null(""))):
        words = textscan.Words(data, offs, textscan.SIGNS)
        yield a, b, words, words.hashes()


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the 128 bits of every word: one row more than words."""
    two = np.column_stack((hashes, textscan.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))))
    bits = np.unpackbits(two.view(np.uint8).reshape(len(hashes), 16), axis=1, bitorder="little")
    out = np.zeros((len(hashes) + 1, 128), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def _prints(votes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of n words."""
    return np.packbits((votes[n:] - votes[:-n]) * 2 > n, axis=1, bitorder="little").view(np.uint64)


def _block_values(prints: np.ndarray) -> np.ndarray:
    """The value of every block of every fingerprint."""
    low, high = prints[:, 0], prints[:, 1]
    out = []
    for s, e in zip(_CUTS, _CUTS[1:], strict=False):
        if e <= 64:
            part = low >> np.uint64(s)
        elif s >= 64:
            part = high >> np.uint64(s - 64)
        else:
            part = (low >> np.uint64(s)) | (high << np.uint64(64 - s))
        out.append(part & np.uint64((1 << (e - s)) - 1))
    return np.stack(out, axis=1).astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingle hashes."""
    keys, of = np.unique(np.concatenate((a, b)), return_inverse=True)
    x = np.bincount(of[: len(a)], minlength=len(keys))
    y = np.bincount(of[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of five words each; fewer words: the whole sequence."""
    return textscan.windows(hashes, min(SHINGLE, len(hashes))) if len(hashes) else hashes


@dataclass
class Items:
    """A block of benchmark items, ready for lookup."""

    ids: list
    sizes: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # per size: sorted block keys and their items
    known: dict[int, np.ndarray]  # per shingle length: sorted shingle hashes of all items
    seen: dict[int, np.ndarray]  # the same as a bit table

    @classmethod
    def build(cls, ids: list, texts: list[str]) -> Items:
        hashes = [next(_words(pa.array([text], pa.string())))[3] for text in texts]
        own = [(k, h) for k, h in zip(ids, hashes, strict=True) if len(h)]
        sizes = np.array([len(h) for _, h in own], np.int64)
        grams = [shingles(h) for _, h in own]
        prints = np.concatenate([_prints(_votes(h), len(h)) for _, h in own]) if own else np.zeros((0, 2), np.uint64)
        keys = {}
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            values = _block_values(prints[at])
            all_keys, items = [], []
            for b, (s, e) in enumerate(zip(_CUTS, _CUTS[1:], strict=False)):
                for flip in [0, *(1 << k for k in range(e - s))]:
                    all_keys.append((b << 16) | (values[:, b] ^ flip))
                    items.append(at)
            flat, items = np.concatenate(all_keys), np.concatenate(items)
            order = np.argsort(flat, kind="stable")
            keys[int(n)] = flat[order], items[order]
        known, seen = {}, {}
        for length in {min(SHINGLE, int(n)) for n in sizes}:
            known[length] = np.unique(np.concatenate([g for g, n in zip(grams, sizes, strict=True) if min(SHINGLE, n) == length]))
            seen[length] = np.zeros(1 << _FILTER_BITS, bool)
            seen[length][(known[length] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls([k for k, _ in own], sizes, grams, prints, keys, known, seen)

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
        """Per shingle length: the words where a shingle of some item starts, within a row."""
        out = {}
        for length, known in self.known.items():
            grams = textscan.windows(hashes, length)
            at = np.flatnonzero(self.seen[length][(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = at[textscan.inside(rows, length)[at]]
            place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
            out[length] = at[known[place] == grams[at]]
        return out

    def matches(self, hashes: np.ndarray, whole: bool = False) -> list[tuple[int, int, float]]:
        """(item, start, similarity) of the best window of every item that the words of one stretch match.

        whole: the stretch is a document, and the one window for items of more words.
        """
        votes = _votes(hashes)
        best: dict[int, tuple[float, int]] = {}
        for n, (keys, items) in self.keys.items():
            length = min(SHINGLE, n)
            size = min(n, len(hashes))
            # a window of fewer words can at best hold its own share of the item's shingles
            if size < n and (not whole or size < length or (size - length + 1) / (n - length + 1) < SIMILARITY):
                continue
            prints = _prints(votes, size)
            own = _block_values(prints) | (np.arange(BLOCKS) << 16)
            left, right = np.searchsorted(keys, own, "left").ravel(), np.searchsorted(keys, own, "right").ravel()
            count = right - left
            if not count.any():
                continue
            # in steps of so many block values that their candidates stay bounded
            cut = np.searchsorted(np.cumsum(count), np.arange(_PAIRS, count.sum() + _PAIRS, _PAIRS), "left") + 1
            close = []
            for s, t in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                part = count[s:t]
                window = np.repeat(np.arange(s, s + len(part)) // BLOCKS, part)
                step = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                item = items[np.repeat(left[s:t], part) + step]
                far = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) > RADIUS
                close.append(np.column_stack((window[~far], item[~far])))
            pairs = np.unique(np.concatenate(close), axis=0)
            grams = textscan.windows(hashes, length)
            for w, k in pairs.tolist():
                found = similarity(grams[w : w + size - length + 1], self.shingles[k])
                if found >= SIMILARITY and (k not in best or (-found, w) < (-best[k][0], best[k][1])):
                    best[k] = (found, w)
        return [(k, w, s) for k, (s, w) in best.items()]

    def scan(self, column: pa.Array, short: bool = False) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, first word, similarity): the best match of every item in every row.

        short: rows of fewer words than an item count as its one window.
        """
        if not self.ids:
            return
        reach = int(self.sizes.max())
        for a, _, words, hashes in _words(column):
            hits = self.hits(hashes, words.rows)
            marks = np.unique(np.concatenate([np.zeros(0, np.int64), *hits.values()]))
            if not len(marks):
                continue
            row = np.searchsorted(words.rows, marks, "right") - 1
            begin = np.maximum(marks - reach, words.rows[row])
            end = np.minimum(marks + reach + SHINGLE, words.rows[row + 1])
            new = np.concatenate(([True], (begin[1:] > end[:-1]) | (row[1:] != row[:-1])))
            cut = np.append(np.flatnonzero(new), len(marks))
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for s, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                r, base = int(row[s]), int(words.rows[row[s]])
                # a stretch of any length, in steps that overlap by the longest window
                for at in range(int(begin[s]), int(end[t - 1]), 8192):
                    stop = min(at + 8192 + reach, int(end[t - 1]))
                    whole = short and at == base and stop == words.rows[r + 1]
                    for k, w, found in self.matches(hashes[at:stop], whole):
                        place = at + w - base
                        if (r, k) not in best or (-found, place) < (-best[r, k][0], best[r, k][1]):
                            best[r, k] = (found, place)
            for (r, k), (found, place) in sorted(best.items()):
                yield a + r, k, place, found


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    own = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    own = own.where("text is not null").withColumn("size", F.octet_length("text"))
    total = own.agg(F.sum("size")).first()[0] or 0
    blocks = math.ceil(total / BENCHMARK_BYTES)
    for k in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else own
        rows = part.select("item", "text").distinct().collect()  # bounded: one block of the benchmark
        yield Items.build([r.item for r in rows], [r.text for r in rows])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    short: bool = False,
) -> DataFrame:
    """(id, item_id, start, similarity): the best window of every document and item that match.

    Windows have the item's number of words. short: a document of fewer words than an item is
    its one window; otherwise it matches no longer item.
    start counts words from 0. Null and empty texts and items match nothing; an item of fewer
    than five words is one shingle, its whole sequence. Equal windows: the first. Repeated rows
    and items each get their rows; null ids stay null. Empty tables give no rows. Other columns
    are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, start bigint, similarity double"
    out = None
    for items in _item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                found = list(items.scan(batch.column(1), short))
                if found:
                    row, item, start, share = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([items.ids[k] for k in item]), pa.array(start, pa.int64()), pa.array(share)],
                        ["id", "item_id", "start", "similarity"],
                    )

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    short: bool = False,
) -> DataFrame:
    """The rows of docs, unchanged, that match no item; short as in contaminated."""
    at = docs.columns.index(text_col)
    for items in _item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.zeros(batch.num_rows, bool)
                found[[row for row, *_ in shared.value.scan(batch.column(at), short)]] = True
                yield batch.filter(pa.array(~found))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
