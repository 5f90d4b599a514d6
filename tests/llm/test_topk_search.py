import math
import random

import numpy as np
import pytest

from claimloom.llm import topk_search as T

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(table, k, every):
    best = {}
    for i, v in table:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(256 * x) for x in v]
            best[i] = max(best.get(i, own), own)
    out = []
    for q, a in best.items():
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in best.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, table, k=5, every=50):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(table, SCHEMA).withColumns({"id": F.lit("x"), "vec": F.lit("y"), "shard": F.lit(1)}).repartition(3)
    got = sorted(tuple(r) for r in T.top_k(df, k=k, every=every).collect())
    assert got == plain(table, k, every)
    return got


def test_clusters_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    table = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    hot = table[50][1]
    table += [(i, hot) for i in range(1200, 1900)]
    random.Random(1).shuffle(table)
    check(spark, table)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, []), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0])]
    table += [(None, [1.0, 1.0]), (-50, [-3.0, 0.001]), (7, [5.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [0.5, 2.0])]
    check(spark, table)
    check(spark, table[:2])
    check(spark, table[:1])


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    check(spark, [(i, [rng.uniform(-3e5, 3e5) for _ in range(3)]) for i in range(200)], every=10)


def test_empty_table(spark):
    assert check(spark, []) == []
    assert check(spark, [(50, None)]) == []


@pytest.mark.parametrize("dim", [2, 16])
def test_no_pruned_vector_is_within_reach(dim):
    rng = np.random.default_rng(dim)
    vecs = rng.integers(-300, 300, (400, dim))
    space = T.Space(dim, float((vecs * vecs).sum(1).max()), np.zeros((1, dim + 1)), np.arange(0), vecs[:0], True)
    space.pivots = T._farthest(space.lift(vecs), 8)
    away = space.distances(space.lift(vecs))
    query = space.distances(np.column_stack((vecs.astype(float), np.zeros(len(vecs)))))
    scores = space.scores(vecs, vecs)
    for q in range(0, 400, 37):
        fifth = np.sort(scores[q])[-5]
        reach = space.reach(vecs[q : q + 1], np.array([fifth]))[0]
        for x in np.flatnonzero(scores[q] >= fifth):
            assert (np.abs(query[q] - away[x]) <= reach).all()
