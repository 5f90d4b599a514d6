"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda.

A text, normalised as its model says, is a row of characters. The agenda holds the adjacent
pairs of symbols that together are a piece of the vocabulary, the best score first and the
leftmost first among equals; the top one is merged, its neighbours make new pairs, and so on
until none is left. A character outside the vocabulary becomes its UTF-8 bytes' pieces, or the
unknown id where the model has none.

No piece of such a vocabulary holds the space sign behind another character, so no merge
crosses the place before a word's space sign, and words have agendas of their own: each distinct
word is encoded once and kept in a cache of bounded bytes. Many short words are worked off side
by side, each round taking the top of every word's agenda; a long one has a heap. For a
vocabulary with other pieces the whole text is one word.

Every batch is checked against the sentencepiece library (`check`): all words that are new to
the cache, in one text that holds them, or every text whole. The library also normalises and
decodes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import textscan
from claimloom.llm.piece_cache import PieceCache, Table

SPACE_SIGN = "▁"
_SIGN = SPACE_SIGN.encode()
#: Words of more characters than this get a heap of their own.
SHORT = 48
_NEVER = np.int64(2**62)
_NO_GAPS = np.zeros(256, bool)


class Mismatch(ValueError):
    """The library encodes a text otherwise: the model is not of a kind that this module encodes."""


class Coder:
    """A model, its merges and the ids of the words it has seen."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.vocab_size()
        if any(sp.is_unused(k) for k in range(n)):
            raise ValueError(f"{path}: vocabularies with unused pieces are not supported")
        plain = {sp.id_to_piece(k): k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}
        self.cuts_words = sp.normalize("a").startswith(SPACE_SIGN) and not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in plain)
        # symbols: the pieces by id, then characters that occur inside pieces only
        symbols = dict(plain)
        for char in sorted({c for p in plain for c in p} - set(plain)):
            symbols[char] = n + len(symbols) - len(plain)
        self.known = n + len(symbols) - len(plain)  # greater numbers: this and an unknown code point
        chars = sorted(c for c in symbols if len(c) == 1)
        self.code_points = np.array([ord(c) for c in chars], np.uint32)
        self.char_symbol = np.array([symbols[c] for c in chars], np.int32)
        ranks = {s: k for k, s in enumerate(sorted({sp.get_score(k) for k in plain.values()}, reverse=True))}
        left, right, merged = [], [], []
        for piece, k in plain.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(k)
        self.merged = np.array(merged, np.int32)
        self.rank = np.array([ranks[sp.get_score(k)] for k in merged], np.int64)
        self.pairs = Table(len(merged))
        self.pairs.add(self._pair(np.array(left, np.int64), np.array(right, np.int64)), np.arange(len(merged), dtype=np.int32))
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = byte_ids if all(sp.is_byte(k) for k in byte_ids) else None
        self.cache = PieceCache()

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    # ---- agendas

    @cache
    def _merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and result of every pair, for the heap."""
        pair = self.pairs.keys[self.pairs.places >= 0]
        at = self.pairs.places[self.pairs.places >= 0]
        left, right = (pair >> np.uint64(32)).tolist(), (pair & np.uint64(2**32 - 1)).tolist()
        result = zip(self.rank[at].tolist(), self.merged[at].tolist(), strict=True)
        return dict(zip(zip(left, right, strict=True), result, strict=True))

    def _symbols(self, code_points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code_points, code_points), len(self.code_points) - 1)
        own = self.code_points[at] == code_points
        return np.where(own, self.char_symbol[at], code_points.astype(np.int64) + self.known)

    def _heap(self, symbols: list[int]) -> list[int]:
        """The symbols of one word once its agenda is empty."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple] = []
        merges = self._merges()

        def push(a: int, b: int) -> None:
            found = merges.get((symbols[a], symbols[b]))
            if found:
                heapq.heappush(agenda, (found[0], a, b, symbols[a], symbols[b], found[1]))

        for k in range(n - 1):
            push(k, k + 1)
        while agenda:
            _, a, b, x, y, new = heapq.heappop(agenda)
            if symbols[a] != x or b >= n or symbols[b] != y or after[a] != b:
                continue  # one of the two has been merged meanwhile
            symbols[a], symbols[b] = new, -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                push(a, after[a])
            if before[a] >= 0:
                push(before[a], a)
        return [s for s in symbols if s >= 0]

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short words at once; symbols with the word of each, words together."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def look(left: np.ndarray) -> np.ndarray:
            """Place in the table of the pair that starts at each of these; -1 for none."""
            right = np.minimum(left + 1, len(symbols) - 1)
            at = self.pairs.find(self._pair(symbols[left], symbols[right]))
            return np.where((right > left) & (word[left] == word[right]), at, -1)

        at = look(np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            entry = np.where(at >= 0, (self.rank[at] << 32) | np.arange(len(at)), _NEVER)
            top = np.minimum.reduceat(entry, first)
            place = top[top != _NEVER] & 0xFFFFFFFF
            symbols[place] = self.merged[at[place]]
            stays = np.ones(len(symbols), bool)
            stays[place + 1] = False
            moved = np.cumsum(stays) - 1
            size = np.diff(np.append(first, len(word)))
            over = np.repeat(top == _NEVER, size)
            if over.any():
                done.append((symbols[over], word[over]))
                stays &= ~over
                moved = np.cumsum(stays) - 1
            symbols, word, at = symbols[stays], word[stays], at[stays]
            changed = moved[place]
            near = np.zeros(len(symbols), bool)
            near[changed] = near[np.maximum(changed - 1, 0)] = True
            near = np.flatnonzero(near)
            at[near] = look(near)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the word of each, from symbols: characters without a piece become bytes or unknown."""
        odd = np.flatnonzero(symbols >= self.library.vocab_size())
        if not len(odd):
            return symbols.astype(np.int32), word
        chars = {s: self._bytes(s) for s in np.unique(symbols[odd]).tolist()}
        size = np.ones(len(symbols), np.int64)
        size[odd] = [len(chars[s]) for s in symbols[odd].tolist()]
        out = np.repeat(symbols, size)
        begin = (np.cumsum(size) - size)[odd]
        for s, k in zip(symbols[odd].tolist(), begin.tolist(), strict=True):
            out[k : k + len(chars[s])] = chars[s]
        out, word = out.astype(np.int32), np.repeat(word, size)
        if self.byte_ids is None and len(out) > 1:  # characters without ids in a row are one unknown
            unknown = out == self.library.unk_id()
            again = np.concatenate(([False], unknown[1:] & unknown[:-1] & (word[1:] == word[:-1])))
            out, word = out[~again], word[~again]
        return out, word

    def _bytes(self, symbol: int) -> list[int]:
        if symbol >= self.known:
            char = chr(symbol - self.known)
        else:
            char = chr(int(self.code_points[np.flatnonzero(self.char_symbol == symbol)[0]]))
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.library.unk_id()]

    def words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised words, one after the other, and their number per word."""
        texts = [p.decode() for p in pieces]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self._symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        word = np.repeat(np.arange(len(texts)), size)
        short = np.repeat(size <= SHORT, size)
        parts = [self._rounds(symbols[short], word[short])]
        begin = np.cumsum(size) - size
        for k in np.flatnonzero(size > SHORT).tolist():
            own = np.array(self._heap(symbols[begin[k] : begin[k] + size[k]].tolist()), np.int64)
            parts.append((own, np.full(len(own), k)))
        symbols, word = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        ids, word = self._ids(symbols[order], word[order])
        return ids, np.bincount(word, minlength=len(texts))

    # ---- texts

    def checked(self, pieces: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        """Raise unless the library gives words the same ids, in one text that holds them all.

        Words of space signs alone stand at a text's end and would join the next word: one call each.
        """
        lists = np.split(ids, np.cumsum(length)[:-1])
        blank = [k for k, p in enumerate(pieces) if p.endswith(_SIGN)]
        texts = [("a" + pieces[k].decode().replace(SPACE_SIGN, " "), [*self.library.encode("a"), *lists[k].tolist()]) for k in blank]
        own = sorted(set(range(len(pieces))) - set(blank))
        if own:
            normal = b"".join([pieces[k] for k in own]).decode()
            texts.append((normal.replace(SPACE_SIGN, " ")[1:], np.concatenate([lists[k] for k in own]).tolist()))
            if self.library.normalize(texts[-1][0]) != normal:  # the model's rules change such a text
                raise Mismatch("words of this model cannot be checked in one text: check whole texts")
        for text, mine in texts:
            other = self.library.encode(text, num_threads=1)
            if other != mine:
                at = next((k for k, (x, y) in enumerate(zip(other, mine, strict=False)) if x != y), -1)
                raise Mismatch(f"the library's ids {other[at : at + 10]}, here {mine[at : at + 10]}, among {text[:200]!r}")

    def block(self, texts: list[str], check: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and their number per text; check: new words against the library."""
        normal = [self.library.normalize(t).encode() for t in texts]
        offs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)))))
        raw = b"".join(normal)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        first = np.zeros(len(data) + 1, bool)
        if self.cuts_words:
            sign = np.zeros(len(data) + 3, bool)
            sign[3:-2] = (data[:-2] == _SIGN[0]) & (data[1:-1] == _SIGN[1]) & (data[2:] == _SIGN[2])
            first[:-1] = sign[3:] & ~sign[:-3]
        first[offs] = True
        edges = np.flatnonzero(first)
        words = textscan.Words(np.zeros(0, np.uint8), offs, _NO_GAPS)
        words.data, words.starts, words.ends = data, edges[:-1], edges[1:]
        keys, at_first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = self.cache.find(keys)
        new = np.flatnonzero(at < 0)
        begin, end = words.starts[at_first[new]].tolist(), words.ends[at_first[new]].tolist()
        pieces = [raw[a:b] for a, b in zip(begin, end, strict=True)]
        ids, length = self.words(pieces)
        if check and pieces:
            self.checked(pieces, ids, length)
        out, own = self.cache.gather(at, length, ids, of)
        self.cache.add(keys[new], length, ids)
        total = np.concatenate(([0], np.cumsum(own)))
        return out, np.diff(total[np.searchsorted(words.starts, offs)])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for a, b, data, offs in textscan.blocks(column, 1 << 19):
        raw = data.tobytes()
        yield a, b, [raw[s:e].decode() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: bool = True,
    decoded: bool = False,
    check: str = "words",
) -> DataFrame:
    """(id, tokens) of every row's whole text, with decoded: also the text that the library makes of them.

    path names the model on every machine. Null text: empty, which is the end id alone (nothing
    without end_id). Ids are passed on as they are, null too, and repeated rows each get the
    same result; an empty table gives no rows. Other columns are not read, whatever their
    names. check: the library encodes each distinct word of the cache too ("words", for models
    that cut at words; others are checked by texts), or each text whole ("texts"), or nothing
    (""); a difference raises Mismatch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["id", "tokens", *(["decoded"] if decoded else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        tail = [own.library.eos_id()] if end_id else []
        for batch in batches:
            for a, b, texts in _texts(batch.column(1)):
                ids, count = own.block(texts, check == "words" and own.cuts_words)
                upto = np.cumsum(count)
                lists = [x.tolist() for x in np.split(ids, upto[:-1])]
                if check == "texts" or check and not own.cuts_words:
                    for text, mine, other in zip(texts, lists, own.library.encode(texts, num_threads=1), strict=True):
                        if mine != other:
                            raise Mismatch(f"{mine[:20]} and {other[:20]} for {text[:200]!r}")
                ids = np.insert(ids, np.repeat(upto, len(tail)), tail * len(texts)) if tail else ids
                offs = np.concatenate(([0], upto + len(tail) * np.arange(1, len(texts) + 1))).astype(np.int32)
                cols = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids.astype(np.int32)))]
                if decoded:
                    cols.append(pa.array([own.library.decode(x + tail) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(scan, f"id {kind}, tokens array<int>" + (", decoded string" if decoded else ""))


def decode(tokens: DataFrame, path: str, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(id, text) of stored ids, by the library's decoder. Null ids of a row: null text; control ids say nothing."""
    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("array<int>").alias("tokens"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(path).library
        for batch in batches:
            texts = [None if x is None else library.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(scan, f"id {kind}, text string")
