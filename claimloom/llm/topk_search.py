"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted by one coordinate to equal length, which turns the largest inner product
into the smallest Euclidean distance. Each is keyed by its nearest pivot (its cell) and its
distance to it; sorted by that key the table falls into shards, and a shard into annuli with a
known range of distances. For a query at distance d from a pivot, every vector of an annulus
[lo, hi] is at least lo - d and d - hi away (triangle inequality), so an annulus whose gap is
larger than the distance of the k-th best so far holds no answer. Annuli are expanded in order
of their gap and the k-th best shrinks on the way; the first bound comes from the query's own
annulus and from the sample the pivots were chosen from.

Queries travel in blocks, once to each shard that any of the block still needs. Nothing
depends on the pivots but speed: results are exact, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import stored

#: Vectors the pivots are chosen from, and the number of pivots: bounds of what the driver holds.
SAMPLE = 2048
PIVOTS = 64
#: Vectors of an annulus, of a shard, and queries of a block.
ANNULUS = 1024
SHARD = 64 * ANNULUS
BLOCK = 256


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, vec) with floor(scale * x) of every component; vectors with a null or non-finite one are left out."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("bigint"))
    own = table.where(F.col(id_col).isNotNull() & x.isNotNull()).where(sound)
    return own.select(F.col(id_col).cast("bigint").alias("id"), ints.alias("vec"))


_NONE = np.iinfo(np.int64).min


@dataclass
class Space:
    """What every task knows: the dimension, the lift's radius, the pivots and the sample."""

    dim: int
    radius2: float
    pivots: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    exact: bool

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Integer vectors of a list column; shorter ones are filled up with zeros."""
        size = column.value_lengths().to_numpy()
        flat = column.flatten().to_numpy()
        if (size == self.dim).all():
            return flat.reshape(-1, self.dim)
        out = np.zeros((len(size), self.dim), np.int64)
        out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size])] = flat
        return out

    def lift(self, vecs: np.ndarray) -> np.ndarray:
        own = vecs.astype(np.float64)
        rest = np.sqrt(np.maximum(self.radius2 - (own * own).sum(1), 0))
        return np.column_stack((own, rest))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From lifted points to all pivots."""
        square = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def scores(self, queries: np.ndarray, vecs: np.ndarray) -> np.ndarray:
        """Integer inner products; by float products where those are exact."""
        if self.exact:
            return (queries.astype(np.float64) @ vecs.astype(np.float64).T).astype(np.int64)
        return queries @ vecs.T

    def reach(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Distance within which scores of at least `least` lie, with room for rounding."""
        own = queries.astype(np.float64)
        score = np.where(least == _NONE, -np.inf, least.astype(np.float64))
        square = (own * own).sum(1) + self.radius2 - 2 * score
        return np.sqrt(np.maximum(square, 0)) + 1e-6 * np.sqrt(self.radius2 + (own * own).sum(1)) + 1e-9


def _farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each the point farthest from those before."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def fit(vectors: DataFrame) -> Space | None:
    """The space of a table of integer vectors; None when it is empty."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    most = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    dim, radius2, top = vectors.agg(F.max(F.size("vec")), F.max(square), F.max(most)).first()
    if not dim:
        return None
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = np.zeros((len(rows), dim), np.int64)
    for k, r in enumerate(rows):
        sample[k, : len(r.vec)] = r.vec
    space = Space(dim, float(radius2), np.zeros((1, dim + 1)), np.array([r.id for r in rows]), sample, float(top) ** 2 * dim < 2**53)
    space.pivots = _farthest(space.lift(sample), PIVOTS)
    return space


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row: highest score, then smallest id."""
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]  # ~ reverses the order without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _offer(space: Space, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, top: tuple, k: int) -> tuple:
    """Merge some vectors into the best so far of some queries."""
    score = space.scores(q, vecs)
    score[qid[:, None] == ids[None]] = _NONE
    if score.shape[1] > 4 * k:  # most cannot enter; find each row's k-th best without sorting
        kth = np.maximum(np.partition(score, -k, axis=1)[:, -k], top[0][:, -1])
        keep = np.flatnonzero((score >= kth[:, None]).any(0))
        score, ids = score[:, keep], ids[keep]
    both = np.concatenate((top[0], score), 1), np.concatenate((top[1], np.broadcast_to(ids, score.shape)), 1)
    return _best(*both, k)


def build_index(vectors: DataFrame, space: Space) -> DataFrame:
    """The table of annuli: cell, shard, annulus, lo, hi, ids, dists, vecs; sorted by distance within a cell."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                if not part.num_rows:
                    continue
                vecs = space.matrix(part.column(1))
                away = space.distances(space.lift(vecs))
                cell = away.argmin(1)
                data = pa.array([v.tobytes() for v in vecs], pa.binary())
                cols = [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), part.column(0), data]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "dist", "id", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, []
        names = ["cell", "shard", "annulus", "lo", "hi", "ids", "vecs"]

        def flush() -> pa.RecordBatch:
            nonlocal count
            n = len(held)
            shard = (part << 32) + count // SHARD
            row = [held[0][0], shard, (part << 32) + count, held[0][1], held[-1][1]]
            row += [np.array([h[2] for h in held], np.int64).tobytes(), b"".join(h[3] for h in held)]
            count += n
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or len(held) == ANNULUS):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = vectors.mapInArrow(assign, "cell int, dist double, id bigint, vec binary")
    dealt = keyed.repartitionByRange(n, "cell", "dist", "id").sortWithinPartitions("cell", "dist", "id")
    schema = "cell int, shard bigint, annulus bigint, lo double, hi double, ids binary, vecs binary"
    return stored(dealt.mapInArrow(pack, schema), "pivot-index")


def _arrays(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vecs, np.int64).reshape(len(own), dim)


def _query_blocks(index: DataFrame, space: Space, every: int, k: int) -> DataFrame:
    """Blocks of queries with a first bound each: block, ids, vecs, least, and per cell the range they reach."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal count
            qid, q, least = (np.concatenate([h[c] for h in held]) for c in range(3))
            away = space.distances(np.column_stack((q.astype(np.float64), np.zeros(len(q)))))
            reach = space.reach(q, least)[:, None]
            block, count = (part << 32) + count, count + 1
            row = [block, qid.tobytes(), q.tobytes(), least.tobytes(), (away - reach).min(0).tolist(), (away + reach).max(0).tolist()]
            types = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2]
            names = ["block", "ids", "vecs", "least", "low", "high"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        size = 0
        for batch in batches:
            for row in batch.select(["ids", "vecs"]).to_pylist():
                ids, vecs = _arrays(row["ids"], row["vecs"], space.dim)
                own = np.flatnonzero(ids % every == 0)
                for s in range(0, len(own), BLOCK):
                    at = own[s : s + BLOCK]
                    top = (np.full((len(at), k), _NONE), np.full((len(at), k), -1))
                    fresh = ~np.isin(space.sample_ids, ids)  # a vector must not count twice
                    for some in ((ids, vecs), (space.sample_ids[fresh], space.sample[fresh])):
                        if len(some[0]):
                            top = _offer(space, ids[at], vecs[at], *some, top, k)
                    held.append((ids[at], vecs[at], top[0][:, -1]))
                    size += len(at)
                    if size >= BLOCK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    schema = "block bigint, ids binary, vecs binary, least binary, low array<double>, high array<double>"
    return stored(index.select("ids", "vecs").mapInArrow(make, schema), "query-blocks")


def _search(space: Space, k: int):
    """Over rows sorted by shard: a shard's annuli, then the blocks that need it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, annuli = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, annuli = row["shard"], []
                ids, vecs = _arrays(row["ids"], row["vecs"], space.dim)
                if row["kind"] == 0:
                    annuli.append((row["cell"], row["lo"], row["hi"], ids, vecs))
                    continue
                least = np.frombuffer(row["least"], np.int64)
                away = space.distances(np.column_stack((vecs.astype(np.float64), np.zeros(len(vecs)))))
                cell, lo, hi = (np.array([a[c] for a in annuli]) for c in range(3))
                gap = np.maximum(np.maximum(lo - away[:, cell], away[:, cell] - hi), 0)
                score, best = np.full((len(ids), k), _NONE), np.full((len(ids), k), -1)
                for n in np.argsort(gap.min(0), kind="stable"):
                    on = np.flatnonzero(gap[:, n] <= space.reach(vecs, np.maximum(least, score[:, -1])))
                    if len(on):
                        score[on], best[on] = _offer(space, ids[on], vecs[on], *annuli[n][3:], (score[on], best[on]), k)
                a, b = np.nonzero((score > _NONE) & (score >= least[:, None]))
                cols = [pa.array(ids[a]), pa.array(best[a, b]), pa.array(score[a, b])]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])

    return scan


def top_k(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    Queries are the rows whose id is divisible by `every`; candidates all rows but the query's
    own; ties go to the smaller id; fewer candidates than k give fewer rows. Null ids, null
    vectors and vectors with a null or non-finite component take no part. Of rows that share
    an id the largest vector stays. Vectors of different length are compared as if filled up
    with zeros. Scores are exact while they fit a long. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    spark = table.sparkSession
    own = integer_vectors(table, id_col, vector_col, scale)
    vectors = stored(own.groupBy("id").agg(F.max("vec").alias("vec")), "vectors")
    space = fit(vectors)
    if space is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    index = build_index(vectors, space)
    blocks = _query_blocks(index, space, every, k)
    ranges = blocks.select("block", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "range"))
    shards = index.groupBy("shard", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    meet = (F.col("range.low") <= F.col("hi")) & (F.col("range.high") >= F.col("lo"))
    needed = ranges.join(shards, "cell").where(meet).select("shard", "block").distinct()
    asked = blocks.join(needed, "block").select(
        "shard", F.lit(1).alias("kind"), F.lit(0).alias("cell"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "ids", "vecs", "least"
    )
    held = index.select("shard", F.lit(0).alias("kind"), "cell", "lo", "hi", "ids", "vecs", F.lit(None).cast("binary").alias("least"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(space, k), "query_id bigint, vec_id bigint, score bigint")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
