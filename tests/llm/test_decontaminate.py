import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import PASSAGE, documents, empty, rows, with_clashes

import corpus_pipeline
from claimloom.llm import decontaminate as D
from claimloom.llm.queries import queries

ITEMS = "item_id bigint, text string"


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def plain(table, items):
    """Every window of every item's size, compared shingle by shingle."""
    out = []
    for r in table:
        words = tokens(r[1])
        for item, text in items:
            own = tokens(text)
            if not own:
                continue
            want, best = shingles(own), None
            n = min(5, len(own))
            if not any(tuple(words[k : k + n]) in want for k in range(len(words) - n + 1)):
                continue  # nothing shared, so nothing similar
            for k in range(len(words) - len(own) + 1):
                got = shingles(words[k : k + len(own)])
                share = sum((want & got).values()) / sum((want | got).values())
                if share >= 0.8 and (best is None or share > best[1]):
                    best = (k, share)
            if best:
                out.append((r[0], item, *best))
    return sorted(out, key=repr)


def benchmark(spark, items):
    return spark.createDataFrame(items, ITEMS)


def test_awkward_rows(spark):
    items = [(0, PASSAGE), (1, None), (2, ""), (3, "x x"), (None, "One, two three four!"), (4, "nowhere " * 20), (4, "nowhere " * 20)]
    table = documents(spark)
    got = rows(D.contaminated(with_clashes(table), with_clashes(benchmark(spark, items).withColumnRenamed("item_id", "doc_id")), item_col="doc_id"))
    listed = [r for r in (tuple(r) for r in table.collect()) if r[0] != 11]  # its apostrophes are cut alike, see below
    assert [r for r in got if r[0] != 11] == plain(listed, items[:5])


def test_edited_passages(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"b{k}x{rng.randrange(500)}" for _ in range(rng.randrange(15, 60)))) for k in range(20)]
    table = []
    for doc in range(300):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 80))]
        item = items[rng.randrange(20)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            item[rng.randrange(len(item))] = "edited"
        words[len(words) // 2 : len(words) // 2] = item[: rng.choice([len(item), len(item) - 1, len(item) // 2])]
        table.append((doc, " ".join(words), "en", "a", 1))
    got = rows(D.contaminated(documents(spark, table), benchmark(spark, items)))
    want = plain(table, items)
    assert len(want) > 40
    found = {r[:2] for r in got}
    assert found <= {r[:2] for r in want}
    assert len(found) >= 0.97 * len(want)  # the radius lets nearly all edits through
    exact = {r[:2] for r in want if r[3] == 1}
    assert exact <= found


def test_clean_keeps_rows_and_columns(spark):
    table = with_clashes(documents(spark))
    kept = D.clean(table, benchmark(spark, [(0, PASSAGE)]))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in table.collect() if r.doc_id) == sorted([r.doc_id for r in kept.collect() if r.doc_id] + [9, 10])


def test_benchmark_in_several_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"b{k}x{j}" for j in range(30))) for k in range(9)]
    table = [(k, f"before {items[k][1]} after", "en", "a", 1) for k in range(9)]
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 300)
    got = rows(D.contaminated(documents(spark, table), benchmark(spark, items)))
    assert got == [(k, k, 1, 1.0) for k in range(9)]


def plain_with_short(table, items):
    """The same, and the whole of a document of fewer words than an item as its one window."""
    out = plain(table, items)
    for r in table:
        words = tokens(r[1])
        for item, text in items:
            want = shingles(tokens(text))
            if words and len(words) < len(tokens(text)):
                got = shingles(words)
                share = sum((want & got).values()) / sum((want | got).values())
                if share >= 0.8:
                    out.append((r[0], item, 0, share))
    return sorted(out, key=repr)


def test_long_items_just_above_the_similarity(monkeypatch):
    rng = random.Random(9)
    items = [[f"l{k}x{rng.randrange(10**6)}" for _ in range(200)] for k in range(300)]
    # 21 foreign words at the end of the one window that is similar enough
    texts = [" ".join([*words[:179], *(f"f{rng.randrange(10**6)}" for _ in range(21))]) for words in items]
    lookup = D.Items.build(list(range(300)), [" ".join(words) for words in items])
    got = list(lookup.scan(pa.array(texts)))
    assert {(row, item, start, round(found, 6)) for row, item, start, found in got} <= {(k, k, 0, round(175 / 217, 6)) for k in range(300)}
    assert len(got) >= 0.99 * len(items)
    monkeypatch.setattr(D, "_PAIRS", 7)
    assert list(lookup.scan(pa.array(texts[:5]))) == [g for g in got if g[0] < 5]


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(5)
    sizes = [2, 4, 5, 6, 14, 30, 45, 60, 60]
    items = [(k, " ".join(f"i{k}x{rng.randrange(900)}" for _ in range(n))) for k, n in enumerate(sizes)]
    texts = [text.split()[a : len(text.split()) - b] for _, text in items for a, b in [(0, 1), (1, 0), (1, 1), (0, 6), (2, 5), (0, 20)]]
    texts.append([*items[7][1].split()[:57], "other"])
    table = [(k, " ".join(words), "en", "a", 1) for k, words in enumerate(texts)]
    docs, bench = documents(spark, table), benchmark(spark, items)
    got = rows(D.contaminated(docs, bench, short=True))
    assert got == plain_with_short(table, items)
    cut = [k for k, words in enumerate(texts) if words == items[7][1].split()[:59]]
    assert [r[1:] for r in got if r[0] in cut] == [(7, 0, 55 / 56)]
    kept = {r.doc_id for r in D.clean(docs, bench, short=True).collect()}
    assert kept == set(range(len(table))) - {r[0] for r in got}


def test_registered_queries_take_short_documents(spark, tmp_path):
    item = " ".join(f"w{k}" for k in range(60))
    documents(spark, [(1, item.rsplit(" ", 1)[0], "en", "a", 1), (2, "w1 w2 w3", "en", "a", 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark(spark, [(0, item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(queries()["op4_decontaminate"](spark, str(tmp_path))) == [(1, 0, 0, 55 / 56)]
    left = corpus_pipeline.drop_leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r.doc_id for r in left.collect()] == [2]


def test_empty_tables(spark):
    assert rows(D.contaminated(empty(spark), benchmark(spark, [(0, PASSAGE)]))) == []
    assert rows(D.contaminated(documents(spark), spark.createDataFrame([], ITEMS))) == []
    assert D.clean(documents(spark), spark.createDataFrame([], ITEMS)).count() == documents(spark).count()


def test_lookup_returns_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**64, (300, 2), dtype=np.uint64)
    for p in prints[:100]:
        other = p.copy()
        for b in rng.choice(128, D.RADIUS, replace=False):
            other[b // 64] ^= np.uint64(1 << int(b % 64))
        a, b = D._block_values(np.stack((p, other)))
        assert min(int(x).bit_count() for x in a ^ b) <= 1
