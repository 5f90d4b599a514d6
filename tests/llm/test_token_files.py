import random
import zlib

import numpy as np
import pytest
from cases import documents, empty, rows, with_clashes
from tokenizers import Tokenizer

from claimloom.llm import token_files as T
from claimloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def written(spark, df, tmp_path, **more):
    path = f"file://{tmp_path}/tokens"
    T.write_tokens(df, path, tokenizer_path(), **more)
    return path


def plain(table, tokenizer):
    """In id order, null last; rows of one id in the order read back is checked elsewhere."""
    out = []
    for doc, text in table:
        out.append((doc, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]))
    return out


@pytest.mark.parametrize("word_pieces", [True, False])
def test_awkward_rows(spark, tmp_path, tokenizer, word_pieces):
    table = documents(spark)
    path = written(spark, with_clashes(table), tmp_path, word_pieces=word_pieces)
    back = T.read_tokens(spark, path).collect()
    want = plain([(r.doc_id, r.text) for r in table.collect()], tokenizer)
    assert sorted(((r.doc_id, list(r.tokens)) for r in back), key=repr) == sorted(want, key=repr)
    back.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in back]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    assert all(r.n_tokens == len(r.tokens) for r in back)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in T.checksums(T.read_tokens(spark, path)).collect()}
    for r in back:
        assert sums[r.doc_id, r.start] == zlib.crc32(np.array(r.tokens, "<u4").tobytes())


def test_empty_table(spark, tmp_path):
    assert rows(T.read_tokens(spark, written(spark, empty(spark), tmp_path))) == []


def test_some_documents(spark, tmp_path):
    path = written(spark, documents(spark), tmp_path)
    assert sorted(r.doc_id for r in T.read_documents(spark, path, [2, 7, 99]).collect()) == [2, 7, 7]
    plan = T.read_documents(spark, path, [2, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [2,7])" in plan


def test_files_carry_bloom_filters_and_integers(spark, tmp_path):
    from pathlib import Path

    import pyarrow.orc as orc

    written(spark, documents(spark), tmp_path)
    files = [p for p in Path(tmp_path, "tokens").glob("*.orc")]
    assert files
    for p in files:
        own = orc.ORCFile(str(p))
        assert str(own.schema.field("tokens").type) == "list<item: int32>" or "int32" in str(own.schema.field("tokens").type)
        assert own.row_index_stride == T.ROW_STRIDE


def test_pieces_agree_with_whole_texts(tokenizer):
    """Random mixtures of letters, digits, signs, wide characters, white space and special strings."""
    rng = random.Random(8)
    alphabet = [*"abcXYZ019", *" \n\t.,;:'\"!?-_()<>|#@", "é", "É", "ß", "ñ", "́", "中", "\U0001f600", "½", "’", "'s", "'re", "<|endoftext|>", "  ", " ", "İ", "Σ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["", " ", "don't", "x'sy", "12'34", "a'1", "('s", ".'s", "word" * 3000]
    own = T.Encoder(tokenizer_path())
    import pyarrow as pa

    got = []
    for k in range(0, len(texts), 500):
        for ids, counts in own.texts(pa.array(texts[k : k + 500]), True):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not bad, bad[:3]


def test_cache_starts_again_when_full(monkeypatch, tokenizer):
    import pyarrow as pa

    monkeypatch.setattr(T, "CACHE", (5, 9))
    own = T.Encoder(tokenizer_path())
    texts = [f"some words number {k} here" for k in range(40)]
    got = [ids.tolist() for t in texts for ids, _ in own.texts(pa.array([t]), True)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


ODD_LETTERS = "İstanbul Σίσυφος ﬁn יִא 한 ñandú naïve'S ｘㅤy ǅ ªº 漢字かな éte ͅa ŉ \U0001d400\U0001e900 हिन्दी"


@pytest.mark.parametrize("text", [ODD_LETTERS, "été İ été", "ㅤ", "漢 字 漢"])
def test_letters_that_the_library_takes_apart(text):
    import pyarrow as pa

    own = T.Encoder(tokenizer_path())
    [(ids, counts)] = own.texts(pa.array([text]), True)
    assert ids.tolist() == own.whole([text])[0] and counts.tolist() == [len(ids)]


def test_new_words_of_letters_go_to_the_library_together():
    import pyarrow as pa

    own, given = T.Encoder(tokenizer_path()), []
    whole = own.whole
    own.whole = lambda texts: given.append(len(texts)) or whole(texts)
    text = " ".join(f"é{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    [(ids, _)] = own.texts(pa.array([text]), True)
    assert ids.tolist() == whole([text])[0]
    assert sum(given) <= 2
