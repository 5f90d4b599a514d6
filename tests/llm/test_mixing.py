import random
import re
from collections import defaultdict

import pytest
from cases import documents, empty, with_clashes

from claimloom.llm import mixing as M


def plain_targets(sizes):
    """Shares are dealt again and again until no target is above three times its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3 * sizes[s] for s in over}


def sizes_of(table):
    out = defaultdict(int)
    for r in table:
        out[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    return dict(out)


def check(spark, table, df):
    found = [r.asDict() for r in M.mix(df).collect()]
    sizes = sizes_of(table)
    want = plain_targets(sizes)
    assert len(found) == len(table)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        # ids are distinct in these tables, so the boundary is one document
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return found


def test_many_sources(spark):
    rng = random.Random(9)
    table = []
    for doc in range(900):
        source = rng.choice(["big"] * 12 + [None, "", "a", "z", "é", "\U0001f600", "ﬀ", "small"])
        table.append((doc, "w " * rng.randrange(0, 4 if source == "small" else 40), "en", source, 1))
    found = check(spark, table, with_clashes(documents(spark, table)))
    again = [r.asDict() for r in M.mix(documents(spark, table, 11)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_one_hot_source_and_excess(spark):
    table = [(k, "w " * 10, "en", "hot" if k % 9 else f"s{k}", 1) for k in range(400)]
    check(spark, table, documents(spark, table))


def test_awkward_rows(spark):
    table = documents(spark)
    found = [r.asDict() for r in M.mix(with_clashes(table)).collect()]
    assert len(found) == table.count()
    assert {r["size"] for r in found if r["id"] in (3, 4, 5)} == {0}
    assert len({r["taken"] for r in found if r["id"] == 7}) == 1  # repeated rows are taken alike


def test_empty_table(spark):
    assert M.mix(empty(spark)).count() == 0
    assert M.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    table = [(k, "w " * (k % 7), "en", "s" if k % 3 else "t", 1) for k in range(200)]
    df = with_clashes(documents(spark, table))
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    times = {r.id: r.times for r in M.mix(df).collect()}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in times.items() if v}


def test_words_are_byte_runs(spark):
    text = "a b \x0bc\x1cd e\te"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(M.words_of(df.t)).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text))
