"""Token ids of text pieces, kept by the pieces' 64-bit hashes in arrays of bounded size."""

from __future__ import annotations

import numpy as np


class Table:
    """A fixed open-addressing table from distinct 64-bit keys to places; whole arrays at a time."""

    def __init__(self, capacity: int):
        size = 1 << max(4, (2 * capacity - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.shift = np.uint64(65 - size.bit_length())  # the top bits depend on all of a key
        self.keys = np.zeros(size, np.uint64)
        self.places = np.full(size, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key; -1 where there is none."""
        slot = self._slots(keys)
        out = np.where(self.keys[slot] == keys, self.places[slot], np.int32(-1))
        left = np.flatnonzero((out < 0) & (self.places[slot] >= 0))
        while len(left):
            at = slot[left] = (slot[left] + np.uint64(1)) & self.mask
            place = self.places[at]
            same = self.keys[at] == keys[left]
            out[left[same]] = place[same]
            left = left[~same & (place >= 0)]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Keys that are distinct and not in the table yet; the caller keeps within the capacity."""
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.places[at] < 0
            mine = left[free]
            self.keys[at[free]], self.places[at[free]] = keys[mine], places[mine]
            lost = self.places[at] != places[left]  # taken before, or by another of these keys
            left = left[lost]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class PieceCache:
    """Ids of at most `pieces` pieces and `ids` ids; when full it starts again, and no result depends on that."""

    def __init__(self, pieces: int = 1 << 19, ids: int = 1 << 21):
        self.pieces, self.limit = pieces, ids
        self.clear()

    def clear(self) -> None:
        self.table = Table(self.pieces)
        self.count = self.used = 0
        self.place = np.zeros(self.pieces, np.int32)
        self.length = np.zeros(self.pieces, np.int32)
        self.ids = np.zeros(self.limit, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.table.find(keys)

    def add(self, keys: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        if self.count + len(keys) > self.pieces or self.used + len(ids) > self.limit:
            self.clear()
            upto = np.cumsum(length)
            fit = min(self.pieces, int(np.searchsorted(upto, self.limit, "right")))
            keys, length, ids = keys[:fit], length[:fit], ids[: int(upto[fit - 1]) if fit else 0]
        k, own = len(keys), slice(self.count, self.count + len(keys))
        self.place[own] = np.cumsum(length) - length + self.used
        self.length[own] = length
        self.ids[self.used : self.used + len(ids)] = ids
        self.table.add(keys, np.arange(self.count, self.count + k, dtype=np.int32))
        self.count, self.used = self.count + k, self.used + len(ids)

    def gather(self, at: np.ndarray, new_length: np.ndarray, new_ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other, and their number per piece, of a sequence of pieces.

        of: for every piece of the sequence its place among the distinct ones. at: their places
        here, or -1 for the pieces whose lengths and ids are given beside, in the same order.
        """
        known = at >= 0
        length = np.empty(len(at), np.int64)
        place = np.empty(len(at), np.int64)
        length[known], place[known] = self.length[at[known]], self.place[at[known]]
        length[~known], place[~known] = new_length, np.cumsum(new_length) - new_length + self.used
        ids = np.concatenate((self.ids[: self.used], new_ids))
        own = length[of]
        total = np.cumsum(own)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(place[of] - (total - own), own)
        return ids[where], own
