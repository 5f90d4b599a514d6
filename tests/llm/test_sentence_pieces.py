import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, rows, with_clashes

from claimloom.llm import sentence_pieces as S
from claimloom.llm.piece_cache import PieceCache, Table
from claimloom.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def texts(n=3000):
    rng = random.Random(8)
    alphabet = [*"abcXYZ019eettiinn", *"   \n\t.,;:'\"!?-_()<>|#@", "é", "É", "ß", "́", "中", "\U0001f600", "½", "'s", "the", "ing"]
    alphabet += ["<s>", "</s>", "<unk>", "  ", " ", "İ", "▁", "▁▁", "\x00", "ﬁ", "<0x0A>", "梦", "​"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(n)]
    return out + ["", " ", "  ", "▁", "word" * 3000, "x y" * 100, " " * 500, "中" * 300, "aaaaaaa" * 50, "ab" * 400 + " " + "ba" * 400]


def coded(own, some, check):
    got = []
    for k in range(0, len(some), 400):
        ids, count = own.block(some[k : k + 400], check)
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    return got


@pytest.mark.parametrize("short", [48, 4])
def test_agrees_with_the_library(library, monkeypatch, short):
    """All words side by side, and all by heaps."""
    monkeypatch.setattr(S, "SHORT", short)
    some = texts()
    for got, want, text in zip(coded(S.Coder(MODEL), some, True), library.encode(some), some, strict=True):
        assert got == want, text


def test_small_cache_changes_nothing(library):
    own = S.Coder(MODEL)
    own.cache = PieceCache(40, 90)
    some = texts(800)
    assert coded(own, some, False) == library.encode(some)


def test_whole_texts_as_one_word(library):
    own = S.Coder(MODEL)
    own.cuts_words = False
    some = texts(500)
    assert coded(own, some, False) == library.encode(some)


def test_differences_are_reported():
    own = S.Coder(MODEL)
    own.rank = own.rank[::-1].copy()
    with pytest.raises(S.Mismatch, match="the library's ids"):
        own.block(["several words that merge"], True)


@pytest.mark.parametrize("check", ["words", "texts", ""])
def test_awkward_rows(spark, library, check):
    table = documents(spark)
    got = S.encode(with_clashes(table), MODEL, decoded=True, check=check).collect()
    want = []
    for r in table.collect():
        ids = [*library.encode(r.text or ""), library.eos_id()]
        want.append((r.doc_id, ids, library.decode(ids)))
    assert sorted(((r.id, list(r.tokens), r.decoded) for r in got), key=repr) == sorted(want, key=repr)


def test_without_end_and_decoding_of_stored_ids(spark, library):
    table = spark.createDataFrame([("a", "some text"), ("b", None), (None, "naïve 中")], "k string, text string")
    got = S.encode(table, MODEL, id_col="k", end_id=False)
    assert {r.id: list(r.tokens) for r in got.collect()} == {"a": library.encode("some text"), "b": [], None: library.encode("naïve 中")}
    back = S.decode(got.unionByName(spark.createDataFrame([("none", None)], got.schema)), MODEL)
    assert {r.id: r.text for r in back.collect()} == {"a": "some text", "b": "", None: "naïve 中", "none": None}


def test_empty_table(spark):
    assert rows(S.encode(empty(spark), MODEL)) == []


def test_table_finds_what_was_added():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) << np.uint64(1))
    table = Table(len(keys))
    table.add(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all()
    assert (table.find(keys[1::2]) == -1).all()
    assert table.find(np.zeros(1, np.uint64))[0] == -1 or keys[0] == 0


def test_ids_are_arrow_lists(spark):
    batch = pa.table({"id": [1], "text": ["a b"]}).to_batches()[0]
    assert [t for *_, t in S._texts(batch.column(1))] == [["a b"]]
