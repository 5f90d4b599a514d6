import random
import re

import numpy as np
import pytest
import xxhash
from cases import documents, empty, rows, with_clashes

from claimloom.llm import simhash_dedup as S


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(c >> b & 1 for c in codes) * 2 > len(codes))


def plain_components(prints, max_bits=3):
    """The smallest index reachable over links of at most max_bits."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(prints))]


def expected(table):
    prints = [plain_print(r[1]) for r in table]
    groups = plain_components(prints)
    out = []
    for r, p, g in zip(table, prints, groups, strict=True):
        ids = [x[0] for x, k in zip(table, groups, strict=True) if k == g and x[0] is not None]
        out.append((r[0], p - (1 << 64) if p >> 63 else p, min(ids, default=None)))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    table = documents(spark)
    assert rows(S.near_duplicates(with_clashes(table))) == expected([tuple(r) for r in table.collect()])


def test_empty_table(spark):
    assert rows(S.near_duplicates(empty(spark))) == []


def test_first_of_each_group_stays(spark):
    table = documents(spark)
    kept = S.keep_first(with_clashes(table))
    assert kept.columns == with_clashes(table).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = {}
    listed = [tuple(r) for r in table.collect()]
    for (doc, text, *_), group in zip(listed, plain_components([plain_print(r[1]) for r in listed]), strict=True):
        want.setdefault(group, []).append((doc is None, doc or 0))
    assert len(got) == len(want)
    assert sorted((d is None, d or 0) for d, _ in got) == sorted(min(v) for v in want.values())


def _cluster(rng, n, bits):
    base = rng.getrandbits(64)
    return [base ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("limit", [S.SPLIT, 8])
def test_links_find_every_component(spark, monkeypatch, limit):
    """Random fingerprints, chains and dense clusters; with a small limit groups go to the second level."""
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += _cluster(rng, 80, list(range(64))) + _cluster(rng, 80, [1, 2, 3, 33, 34, 35, 36, 60])
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    prints = sorted({*prints, *chain})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    if limit != S.SPLIT:  # functions are pickled by name: run the stages in this process
        monkeypatch.setattr(S, "SPLIT", limit)
        links = _links_here(np.array(prints, np.uint64))
    else:
        links = [(r.a, r.b) for r in S.links(df).collect()]
    index = {p: k for k, p in enumerate(signed)}
    root = S._roots(len(prints), np.array([index[a] for a, _ in links]), np.array([index[b] for _, b in links]))
    assert root.tolist() == plain_components(prints)


def _links_here(prints):
    import pyarrow as pa

    found = []
    level = pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], ["fingerprint"])
    for second in (False, True):
        keyed = list(S._index(3, second)([level]))
        key = np.concatenate([b.column(0).to_numpy() for b in keyed])
        own = np.concatenate([b.column(1).to_numpy() for b in keyed])
        order = np.lexsort((own, key))
        pieces = np.array_split(order, 7)  # groups run over batch ends
        batches = [pa.RecordBatch.from_arrays([pa.array(key[o]), pa.array(own[o])], ["key", "print"]) for o in pieces]
        held = []
        for out in S._linker(3, second)(batches):
            kind, a, b = (c.to_numpy() for c in out.columns)
            found += zip(a[kind == 0].tolist(), b[kind == 0].tolist(), strict=True)
            held.append((a[kind == 1], b[kind == 1]))
        level = pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held])) for k in (0, 1)], ["a", "b"])
        if not second:
            assert level.num_rows, "the limit must send groups to the second level"
    return found


def test_segments_cover_the_bits():
    for bits in range(8):
        parts = S.segments(64, bits)
        assert sum(w for _, w in parts) == 64 and len(parts) * 2 > bits
