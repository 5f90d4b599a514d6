import random
import re

import numpy as np
from cases import documents, empty, rows, with_clashes

from claimloom.llm import substring_dedup as S


def plain(table):
    """By a dictionary of all windows; rows of one id are one document for the order."""
    first = {}
    split = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in table]
    for doc, words in split:
        for k in range(len(words) - 19):
            place = (doc is None, doc or 0, k)
            window = tuple(words[k : k + 20])
            first[window] = min(first.get(window, place), place)
    out = []
    for doc, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] < (doc is None, doc or 0, k):
                gone[k : k + 20] = [True] * 20
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), sum(gone), " ".join(kept)))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    table = documents(spark)
    assert rows(S.remove_repeats(with_clashes(table))) == plain([tuple(r) for r in table.collect()])


def test_shifted_and_nested_repeats(spark):
    """Passages of 15 to 60 words at every offset, in and across documents, over several map tasks."""
    rng = random.Random(11)
    pool = [[f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    table = []
    for doc in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 30))]
            words += rng.choice(pool)[rng.randrange(0, 6) :]
        table.append((doc, " ".join(words), "en", "a", 1))
    got = rows(S.remove_repeats(documents(spark, table, 7)))
    assert got == plain(table)
    assert sum(r[2] for r in got) > 500


def test_largest_id_is_not_null(spark):
    from cases import words

    top, text = 2**63 - 1, words(60, "z")
    table = [(top, text, "en", "a", 1), (None, text, "en", "a", 1), (None, "only " + words(30, "n"), "en", "a", 1), (top, words(25, "y"), "en", "a", 1)]
    got = rows(S.remove_repeats(documents(spark, table, 2)))
    assert got == plain(table)
    assert {(r[0], r[2]) for r in got} == {(top, 0), (None, 60), (None, 0)}


def test_empty_table(spark):
    assert rows(S.remove_repeats(empty(spark))) == []


def test_cover_aligns_any_two_positions():
    assert S.PERIOD + S.ANCHOR - 1 == S.WINDOW
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any((a + k) % S.PERIOD in S.COVER and (b + k) % S.PERIOD in S.COVER for k in range(S.PERIOD))


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    n = 500
    e = S.Entries(
        rng.integers(-5, 40, n),
        rng.integers(-3, 3, n).astype(np.int32),
        rng.integers(0, 1000, n).astype(np.int32),
        rng.integers(0, 2**63, n).astype(np.uint64),
        rng.integers(0, 4, n).astype(np.int32),
        rng.random(n) < 0.3,
    )
    fields = ["bucket", "kind", "docs", "tags", "counts", "places", "keys", "more"]
    back = [S._unpack(dict(zip(fields, row, strict=True))) for row in S._pack(e, S._ENTRIES)]
    names = ("doc", "tag", "place", "key", "bucket", "known")
    assert sorted(zip(*(np.concatenate([getattr(b, c) for b in back]).tolist() for c in names), strict=True)) == sorted(
        zip(*(getattr(e, c).tolist() for c in names), strict=True)
    )
