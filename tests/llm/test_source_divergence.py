import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, rows, with_clashes

from claimloom.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(table, k=200):
    """table: (text, lang, source) with nulls."""
    used, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in table:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        used[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: used[lang, s][t] for t in kept})

        def share(counts, kept=kept):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // size for t in kept}

        shares, q = {s: share(used[lang, s]) for s in sources}, share(whole)
        for s in sources:
            p = shares[s]
            pairs = [(sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other) for other, o in shares.items() if other != s]
            terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if used[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                found = found if part == "pair" else found[:k]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(seed, n=300, letters=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", "é", None, "c"])
        words = [rng.choice(["W", "w", "é", "É", "_"]) + "x" * int(rng.expovariate(1 / letters)) for _ in range(rng.randrange(0, 40))]
        out.append((rng.choice([" ", "-", "1", "\n"]).join(words) or rng.choice([None, ""]), lang, source))
    return out + [(None, "alone", "s"), ("word " * 9, "single", "s"), ("word", "single", "s"), ("WORD", "single", "s"), ("few terms", "none", "x"), ("", "none", "y")]


def frame(spark, table):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(table)], "doc_id bigint, text string, lang string, source string").repartition(5)


@pytest.mark.parametrize("k", [200, 3])
def test_against_plain(spark, k):
    table = corpus(k)
    assert rows(D.divergence(frame(spark, table), k=k)) == sorted(plain(table, k), key=repr)


def test_many_pieces_and_blocks(spark, monkeypatch):
    """Terms in many pieces merged in several levels, sources in blocks, dense steps of a few rows."""
    for name, value in (("PIECE", 40), ("BLOCK", 2), ("CELLS", 16), ("FAN", 2), ("FLUSH", 50), ("SENT", 3)):
        monkeypatch.setattr(D, name, value)
    table = corpus(9, 200, 60)
    assert rows(D.divergence(frame(spark, table), k=5)) == sorted(plain(table, 5), key=repr)


def test_awkward_rows(spark):
    table = documents(spark)
    want = plain([(r.text, r.lang, r.source) for r in table.collect()])
    assert rows(D.divergence(with_clashes(table))) == sorted(want, key=repr)


def test_empty_table(spark):
    assert rows(D.divergence(empty(spark))) == []


def test_skyband_is_exact():
    rng = np.random.default_rng(3)
    for n, k, top in ((1, 1, 3), (40, 3, 6), (1500, 20, 30), (3000, 200, 4000)):
        high, low, order = rng.integers(0, top, n), rng.integers(0, top, n), rng.permutation(n)
        over = (high[None] >= high[:, None]) & (low[None] <= low[:, None]) & (order[None] < order[:, None])
        assert (D.skyband(high, low, order, k) == (over.sum(1) < k)).all()


def test_shares_are_exact():
    sizes = [1, 7, 10**9, 123_456_789_012, 9 * 10**15]
    for size in sizes:
        counts = [c for c in (0, 1, 5, size // 3, size - 1) if c < size]
        got = D.shares(np.array(counts), np.array(size)).tolist()
        assert got == [1 + 10**9 * (c + 1) // size for c in counts]


def test_terms_of_a_block():
    counts = D._Counts()
    column = pa.array(["Ab ab-éÉ", "x1ab", ""])
    from claimloom.llm import textscan

    for a, b, data, offs in textscan.blocks(column):
        counts.add(data, offs, np.array([0, 1, 1])[a:b])
    got = sorted(map(tuple, (r.values() for r in counts.batch([("l", "s"), ("l", "t")]).to_pylist())))
    assert got == [("l", "s", "ab", 2, 1), ("l", "s", "éÉ", 1, 1), ("l", "t", "ab", 1, 1), ("l", "t", "x", 1, 1)]
