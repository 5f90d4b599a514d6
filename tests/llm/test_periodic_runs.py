import random

import numpy as np
import pytest
from cases import documents, empty, rows, with_clashes

from claimloom.llm import periodic_runs as P
from claimloom.llm import textscan


def plain(words, min_length=24, min_repeats=3):
    """All runs by trying every period on every place."""
    n, found = len(words), {}
    codes = np.unique(np.array(words), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // min_repeats + 1):
        if (codes[q:] == codes[:-q]).sum() < max(min_length, min_repeats * q) - q:
            continue
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_kept(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sequences(rng):
    out = [["x"] * 100, ["a", "b"] * 40, [], ["a"] * 23, ["a"] * 24, ["a"] * 25, list("abcabcabc"), list("abcdefgh") * 3]
    thue = [0]
    while len(thue) < 1 << 12:
        thue += [1 - b for b in thue]
    out.append([str(b) for b in thue])
    for _ in range(150):
        n, letters = rng.randrange(20, 260), rng.choice([1, 2, 3, 8, 60])
        words = [str(rng.randrange(letters)) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(n)
            p = rng.randrange(1, 30)
            for k in range(a, min(n, a + rng.randrange(10, 120))):
                words[k] = words[a + (k - a) % p]
        out.append(words)
    return out


@pytest.mark.parametrize("setting", [(24, 3), (24, 4), (6, 3), (30, 3)])
def test_against_every_period(setting):
    texts = sequences(random.Random(4))
    if setting[0] == 6:
        texts = [t for t in texts if len(t) < 4000]
    column = [" ".join(t) for t in texts]
    import pyarrow as pa

    got = []
    for _, _, data, offs in textscan.blocks(pa.array(column), 5_000):
        words = textscan.Words(data, offs)
        s, n, q = P.find(words.hashes(), words.rows, P.RunSettings(*setting))
        for k in range(len(offs) - 1):
            own = (s >= words.rows[k]) & (s < words.rows[k + 1])
            got.append(list(zip((s[own] - words.rows[k]).tolist(), n[own].tolist(), q[own].tolist(), strict=True)))
    for words, own in zip(texts, got, strict=True):
        assert own == plain(words, *setting), words[:60]
    assert sum(map(len, got)) > 50


def test_small_steps(monkeypatch):
    monkeypatch.setattr(P, "STEP", 7)
    rng = random.Random(5)
    for words in sequences(rng)[9:40]:
        codes = np.array([int(w) for w in words], np.uint64)
        got = P.find(codes, np.array([0, len(words)]))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == plain(words)


def test_splitting_leaves_only_what_can_hold_runs():
    codes = np.array([1, 2, 3] * 10 + [9] + [4, 5] * 20 + list(range(100, 140)), np.uint64)
    begin, end = P.split(codes, np.array([0, len(codes)]), P.RunSettings())
    assert list(zip(begin, end, strict=True)) == [(0, 30), (31, 71)]


def test_awkward_rows(spark):
    table = documents(spark)
    got = P.periodic_runs(with_clashes(table))
    want = []
    for r in table.collect():
        words = (r.text or "").encode().split()
        runs = plain(words)
        want.append((r.doc_id, len(words), runs, plain_kept([w.decode() for w in words], runs)))
    found = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert any(r[2] for r in found)


def test_empty_table(spark):
    assert rows(P.periodic_runs(empty(spark))) == []


def test_best_run(spark):
    table = spark.createDataFrame(
        [(1, [(0, 30, 10), (40, 24, 8), (90, 31, 10)]), (2, []), (3, [(5, 24, 8), (5, 30, 10), (2, 60, 20)])],
        "k int, runs array<struct<start: bigint, length: bigint, period: bigint>>",
    )
    got = {r.k: r.b and tuple(r.b) for r in table.select("k", P.best(table.runs).alias("b")).collect()}
    assert got == {1: (90, 31, 10), 2: None, 3: (2, 60, 20)}


def test_settings_are_checked():
    with pytest.raises(ValueError, match="three repeats"):
        P.RunSettings(24, 2)
