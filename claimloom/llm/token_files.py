"""Token ids in ORC files, in ascending document order.

Documents are range-partitioned by id and sorted, encoded where they lie, and written as ORC:
ids as integers (run-length encoded by the writer), a row index per stride, a Bloom filter on
doc_id per stripe. Every row says which part it is in and how many ids come before it in that
part, so the place of a document in the whole sequence is its part's base plus its offset; the
bases are sums over the parts, and no window runs over documents. Readers take stripes in
parallel and skip stripes and strides by their statistics and Bloom filters.

Encoding goes through the tokenizers library. Pre-tokens never cross white space, nor an edge
between an ASCII letter, a digit and other ASCII signs (the apostrophe apart), so a text is cut
there, and each distinct piece is encoded once and kept by its 64-bit hash in a cache of
bounded bytes. This holds for tokenizers whose normaliser and pre-tokeniser keep these edges
(`word_pieces=True`); any other is run over whole texts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm import textscan
from claimloom.llm.piece_cache import PieceCache

END_ID = 1
#: Pieces and ids a worker keeps, some 25 MB.
CACHE = (1 << 19, 1 << 21)
#: Bytes of text handled at once, and new pieces that the library gets at once: it takes some
#: hundred bytes for each of their ids.
BLOCK, NEW = 1 << 19, 1 << 13
ROW_STRIDE = 1_000
STRIPE_BYTES = 16 << 20

_LETTER, _DIGIT, _OTHER, _QUOTE, _WIDE, _BLANK = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("'")] = _QUOTE
_KIND[128:] = _WIDE
_KIND[textscan.SPACE] = _BLANK


def _cuts() -> np.ndarray:
    """Whether a piece ends between two neighbouring bytes, by their kinds."""
    cut = np.zeros((6, 6), bool)
    cut[_BLANK, :] = cut[:, _BLANK] = True
    for other in (_LETTER, _OTHER, _QUOTE, _DIGIT):
        cut[_DIGIT, other] = cut[other, _DIGIT] = True
    cut[_LETTER, _OTHER] = cut[_LETTER, _QUOTE] = cut[_OTHER, _LETTER] = True
    cut[_QUOTE, _DIGIT] = False  # an apostrophe run keeps what follows it
    return cut


_CUT = _cuts()


class Encoder:
    """A tokenizer and the ids of the pieces it has seen."""

    def __init__(self, path: str):
        # a task has one core, and every thread of the library keeps memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ends_word[k] = token.endswith("</w>")
        # then no pre-token is without a word's end, and equal numbers of both mean one each
        self.every_byte_ends = sum(len(t) == 5 and t.endswith("</w>") for t in vocabulary) >= 256
        self.cache = PieceCache(*CACHE)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of distinct pieces, and the ids one after the other.

        Pieces of plain ASCII or of letters alone are one pre-token each and go as one text. Where
        the library finds more words than pieces in it (letters that it takes apart), they go singly.
        """
        plain, letters, rest = [], [], []
        for k, p in enumerate(pieces):
            if p.isascii() and "'" not in p and "\x00" not in p:
                plain.append(k)
            elif self.every_byte_ends and p.isalpha():
                letters.append(k)
            else:
                rest.append(k)
        length, place = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat, used = [np.zeros(0, np.int32)], 0
        for group in (plain, letters, rest):
            if not group:
                continue
            ends = None
            if group is not rest:
                ids = np.array(self.whole([" ".join([pieces[k] for k in group])])[0], np.int32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(group) or ends[-1] != len(ids):
                    ends = None
            if ends is None:
                lists = self.whole([pieces[k] for k in group])
                ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids = np.fromiter((x for own in lists for x in own), np.int32, int(ends[-1]))
            length[group] = np.diff(ends, prepend=0)
            place[group] = ends - length[group] + used
            flat.append(ids)
            used += len(ids)
        upto = np.cumsum(length)
        where = np.arange(used) + np.repeat(place - (upto - length), length)
        return length, np.concatenate(flat)[where]

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts and the number of ids of each text."""
        kinds = _KIND[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = _CUT[kinds[:-1], kinds[1:]]
        edge[offs] = True
        solid = kinds != _BLANK
        starts = np.flatnonzero(edge[:-1] & solid)
        ends = np.flatnonzero(edge[1:] & solid) + 1
        words = textscan.Words(np.zeros(0, np.uint8), offs)
        words.data, words.starts, words.ends = data, starts, ends
        hashes = words.hashes(lower=True)
        keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        at = self.cache.find(keys)
        new = np.flatnonzero(at < 0)
        raw = data.tobytes() if len(new) else b""
        lengths, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in range(0, len(new), NEW):
            j = first[new[k : k + NEW]]
            pieces = [raw[s:e].lower().decode() for s, e in zip(starts[j].tolist(), ends[j].tolist(), strict=True)]
            length, ids = self._encode_new(pieces)
            lengths.append(length)
            lists.append(ids)
        length, ids = np.concatenate(lengths), np.concatenate(lists)
        out, own = self.cache.gather(at, length, ids, of)
        self.cache.add(keys[new], length, ids)
        total = np.concatenate(([0], np.cumsum(own)))
        return out, np.diff(total[np.searchsorted(starts, offs)])

    def texts(self, column: pa.Array, word_pieces: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, data, offs in textscan.blocks(column, BLOCK):
            if word_pieces and b"<|" not in data.tobytes():
                yield self.block(data, offs)
                continue
            raw = data.tobytes()
            ids = self.whole([raw[s:e].decode() for s, e in zip(offs[:-1], offs[1:], strict=True)])
            flat = np.fromiter((x for own in ids for x in own), np.int32)
            yield flat, np.fromiter(map(len, ids), np.int64, len(ids))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    upto = np.cumsum(counts)
    return np.insert(ids, upto, end_id), counts + 1


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    word_pieces: bool = True,
) -> None:
    """Encode every whole text and write it, in ascending id order, to ORC files at path.

    Null text: empty, which is the end id alone. Null ids come last; rows that share an id come
    by text. Repeated rows are all written. An empty table writes files without rows. Columns:
    part, before (ids before the row in its part), doc_id, n_tokens, tokens.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    schema = "part int, before bigint, doc_id bigint, n_tokens int, tokens array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        own = Encoder(tokenizer_path)  # of this task: a worker lives on after it, and keeps nothing
        for batch in batches:
            first = 0
            for ids, counts in own.texts(batch.column(1), word_pieces):
                ids, counts = with_end(ids, counts, end_id)
                upto = np.concatenate(([0], np.cumsum(counts)))
                k = len(counts)
                cols = [
                    pa.array(np.full(k, part, np.int32)),
                    pa.array(before + upto[:-1]),
                    batch.column(0).slice(first, k),
                    pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ]
                before, first = before + int(upto[-1]), first + k
                yield pa.RecordBatch.from_arrays(cols, ["part", "before", "doc_id", "n_tokens", "tokens"])
            textscan.release()
        del own
        textscan.release()

    writer = rows.mapInArrow(encode, schema).write.option("compression", "zstd")
    writer = writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", ROW_STRIDE).option("orc.stripe.size", STRIPE_BYTES).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every written document; start counts all ids before it.

    The sums per part are read from the count column alone and are as many as there are parts.
    """
    files = spark.read.schema("part int, before bigint, doc_id bigint, n_tokens int, tokens array<int>").orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    own = files.join(F.broadcast(bases), files.part == bases.base_part)  # a row per written part
    return own.select("doc_id", (F.col("base") + F.col("before")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "tokens")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes without them are skipped by statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offs = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sums = [zlib.crc32(flat[s:e].astype("<u4").data) for s, e in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )
            textscan.release()

    return tokens.mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
