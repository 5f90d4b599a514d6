"""Runs of words that repeat with a period, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words of smallest period q (words q apart are the same) and
length at least max(min_length, min_repeats * q) that no neighbouring word extends.

Every word of a run occurs min_repeats times in it, so a word that occurs less often within a
segment lies in no run of it: such words split the segment, pieces too short for a run go, and
the counts are taken again within each piece until nothing changes. One sort of a block's words
serves all rounds, since a word's places stay in order.

What survives is scanned lag by lag. A run of period q holds more than twice max(q, least)
places that equal the word q later, so it holds a whole aligned block of that many; for a lag
only these blocks are compared, by hash, which makes the scan n log n and not n squared. Blocks
that agree are extended to both sides by binary search over prefix hashes. Windows are hashed
modulo two primes (no periodic or self-similar sequence makes them collide by its form); equal
hashes are taken as equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import textscan


@dataclass(frozen=True)
class RunSettings:
    min_length: int = 24
    min_repeats: int = 3

    def __post_init__(self) -> None:
        if self.min_repeats < 3 or self.min_length < 2 * self.min_repeats:
            raise ValueError("a run has at least three repeats, and a length of twice as many words")

    @property
    def least(self) -> int:
        """Length of the smallest block compared: any run of a smaller period holds a whole aligned one."""
        return max(1, self.min_length // self.min_repeats)


_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525 * 641)
#: Blocks compared at once.
STEP = 1 << 19


class _Hashes:
    """Prefix hashes of a sequence of 64-bit values, modulo two primes."""

    def __init__(self, values: np.ndarray):
        self.parts = []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            power = np.ones(1, np.int64)
            step = base % prime
            while len(power) <= len(values):
                power = np.concatenate((power, power * step % prime))
                step = step * step % prime
            own = (textscan.mix(values ^ np.uint64(prime)) % np.uint64(prime)).astype(np.int64)
            prefix = np.zeros(len(values) + 1, np.int64)
            np.cumsum(own * power[: len(own)] % prime, out=prefix[1:])
            self.parts.append((prime, power, prefix % prime))

    def equal(self, a: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the windows of some size at a and at a + lag agree."""
        out = np.ones(len(a), bool)
        for prime, power, prefix in self.parts:
            at = np.flatnonzero(out)
            x, q, n = a[at], lag[at], size[at]
            left = (prefix[x + n] - prefix[x]) * power[q]
            out[at] = (left - (prefix[x + q + n] - prefix[x + q])) % prime == 0
        return out

    def longest(self, a: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many places from a on (back: before a) agree with those a lag later, at most so many."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.equal(a - middle if back else a, lag, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def split(codes: np.ndarray, rows: np.ndarray, s: RunSettings) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that survive the splitting at rare words."""
    segment = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.argsort(codes, kind="stable")
    alive = np.repeat(np.diff(rows) >= s.min_length, np.diff(rows))
    while True:
        order = order[alive[order]]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, own = codes[order], segment[order]
        new = np.concatenate(([True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])))
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        rare = order[np.repeat(size < s.min_repeats, size)]
        alive[rare] = False
        place = np.flatnonzero(alive)
        if not len(place):
            return place, place
        new = np.concatenate(([True], (np.diff(place) > 1) | (np.diff(segment[place]) != 0)))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(place)))
        if not len(rare):
            return place[first], place[first] + size
        segment[place] = np.cumsum(new)
        alive[place[np.repeat(size < s.min_length, size)]] = False


def _agreeing(hashes: _Hashes, begin: np.ndarray, end: np.ndarray, s: RunSettings) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, lag, block length, segment) of the first of every row of aligned blocks that agree with those a lag later."""
    lags = (end - begin) // s.min_repeats
    upto = np.concatenate(([0], np.cumsum(lags)))
    total = int(upto[-1])
    done = 0
    while done < total:
        # some lags of some segments: as many as make a step of blocks
        pair = np.arange(done, min(total, done + STEP))
        of = np.searchsorted(upto, pair, "right") - 1
        lag = pair - upto[of] + 1
        block = np.maximum(lag, s.least)
        count = (end[of] - begin[of] - lag) // block
        fit = max(1, int(np.searchsorted(np.cumsum(count), STEP, "right")))
        of, lag, block, count = of[:fit], lag[:fit], block[:fit], count[:fit]
        done += fit
        each = np.repeat(np.arange(fit), count)
        k = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[of][each] + k * block[each]
        hit = hashes.equal(at, lag[each], block[each])
        first = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & (k > 0)))
        own = each[first]
        yield at[first], lag[own], block[own], of[own]


def find(codes: np.ndarray, rows: np.ndarray, s: RunSettings = RunSettings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of the rows of a block, by start and period."""
    begin, end = split(codes, rows, s)
    kept = np.concatenate(([0], np.cumsum(end - begin)))
    where = np.arange(kept[-1]) + np.repeat(begin - kept[:-1], end - begin)
    hashes = _Hashes(codes[where])  # of the segments alone, one after the other
    base, stop = kept[:-1], kept[1:]
    parts = []
    for at, lag, block, of in _agreeing(hashes, base, stop, s):
        right = hashes.longest(at + block, lag, stop[of] - at - block - lag, back=False)
        left = hashes.longest(at, lag, at - base[of], back=True)
        length = left + block + right + lag
        long = length >= np.maximum(s.min_length, s.min_repeats * lag)
        parts.append(np.stack((at - left + (begin - base)[of], length, lag))[:, long])
    start, length, lag = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)
    # a stretch found at several lags has the smallest as its period: the others are multiples of it
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.concatenate(([True], (np.diff(start) != 0) | (np.diff(length) != 0)))[: len(start)]
    start, length, lag = start[new], length[new], lag[new]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run contains after its first period."""
    edge = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: RunSettings = RunSettings()) -> DataFrame:
    """(id, n_words, runs, kept) of every row's whole text.

    runs: array of (start, length, period) in words, by start and period; runs may overlap.
    kept: the words outside of repeats (every run keeps its first period), joined by one space.
    Null and empty texts have no words, no runs and an empty kept. Ids are passed on as they
    are, null too; repeated rows each get the same result; an empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textscan.blocks(batch.column(1)):
                words = textscan.Words(data, offs)
                start, length, period = find(words.hashes(), words.rows, s)
                gone = dropped(len(words), start, length, period)
                raw, kept = data.tobytes(), []
                for k in range(b - a):
                    i, j = int(words.rows[k]), int(words.rows[k + 1])
                    if not gone[i:j].any():
                        kept.append(b" ".join(raw[offs[k] : offs[k + 1]].split()).decode())
                        continue
                    own = np.flatnonzero(~gone[i:j]) + i
                    pieces = zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True)
                    kept.append(b" ".join([raw[x:y] for x, y in pieces]).decode())
                at = np.searchsorted(start, words.rows)
                row = np.repeat(np.arange(b - a), np.diff(at))
                fields = [pa.array(x) for x in (start - words.rows[row], length, period)]
                runs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(struct)))
                cols = [batch.column(0).slice(a, b - a), pa.array(words.counts), runs, pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "runs", "kept"])

    schema = f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string"
    return rows.mapInArrow(scan, schema)


def best(runs: F.Column) -> F.Column:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""

    def better(a: F.Column, b: F.Column) -> F.Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        ahead = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when((x > y) | ((x == y) & ahead), a).otherwise(b)

    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), better))
