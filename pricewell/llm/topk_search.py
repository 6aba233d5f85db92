"""Exact top-k search by integer inner product with a pivot-distance index.

Vectors get one more coordinate that makes all their lengths equal, so that the nearest vectors of a query
are those of the greatest inner product. Each vector is keyed by its nearest pivot and its distance from
it; equal shares of a pivot's vectors in order of distance form its annuli, and large annuli are cut into
chunks. A query starts with the annuli around its own distance, which gives it a k-th score to beat, and
then goes to those annuli only that the triangle inequality does not exclude.

How much that excludes depends on the vectors. In tight clusters it is nearly all of them; where all have about one
length and no near neighbours, as random directions in many dimensions have, distances to any pivot are nearly
equal, the triangle inequality says little, and all annuli are visited: the answer stays exact, the work is that of
comparing all. visited_share() tells which it is.

Vectors and queries of a chunk meet by one shuffle on (annulus, chunk), sorted so that a task reads a chunk's
vectors first and then its queries in batches: neither is collected into a row, and nothing that grows with
the table is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, whole_ids, shuffle_partitions

#: At least and at most so many pivots, and annuli of one pivot. Between these they grow with the table; at most
#: PIVOTS[1] * ANNULI[1] annuli are known to the driver and to each task.
PIVOTS, ANNULI = (16, 256), (2, 64)
#: Numbers in a chunk of vectors, at least and at most; between these a partition gets about two chunks.
CHUNK_NUMBERS = (1 << 17, 1 << 20)
#: Cells of a matrix of scores or distances that a task makes at once.
CELLS = 1 << 22
#: Inner products of integers up to this size are exact in 64-bit floats.
EXACT = 2.0**53
LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component as a double. Vectors that are null or have a component that
    is null or not finite take no part, nor do rows with a null id."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: _floor(F.lit(float(scale)) * e.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _floor(x):
    # floor() gives a long, which doubles over 2**53 don't need: they are whole
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, so their missing components count as 0."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; those beyond the type's range become its ends."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in v.tolist()]
    return np.array([[max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(map(int, r), w, strict=True)))) for w in whole] for r in q.tolist()], np.int64).reshape(len(q), len(v))


class Index:
    """The pivots, in the space with the added coordinate."""

    def __init__(self, pivots: np.ndarray, width: int, longest: float):
        self.pivots, self.width, self.longest = pivots, width, longest

    def raised(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))[:, None]])

    def distances(self, v: np.ndarray) -> np.ndarray:
        d = (v * v).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (v @ self.pivots.T)
        return np.sqrt(np.maximum(d, 0))


def _between(x: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], x))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", pivots: tuple[int, int] = PIVOTS, annuli: tuple[int, int] = ANNULI, chunk_numbers: tuple[int, int] = CHUNK_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest scores among the vectors of other ids, ties to
    the smaller id; all, if there are fewer.

    The score is the inner product of floor(scale * x). Rows whose vector or id is null, or with a component
    that is null or not finite, take no part. Vectors of different lengths are compared as if filled with
    zeros. Ids must be whole numbers, else TypeError; they are taken to be unique: rows of one id count as
    that many vectors, and a query with a repeated id is answered once, by its smallest vector. No vectors or
    no queries: no rows. Other columns are not read.
    """
    return _searched(vectors, queries, k, scale, id_col, vec_col, pivots, annuli, chunk_numbers)[0]


def visited_share(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", pivots: tuple[int, int] = PIVOTS, annuli: tuple[int, int] = ANNULI, chunk_numbers: tuple[int, int] = CHUNK_NUMBERS) -> float | None:
    """The share of the vectors that stand in annuli which the bounds don't exclude, on average over the queries: what
    the index saves is the rest. Null without vectors or queries."""
    return _searched(vectors, queries, k, scale, id_col, vec_col, pivots, annuli, chunk_numbers)[1]()


def _searched(vectors, queries, k, scale, id_col, vec_col, pivots, annuli, chunk_numbers):
    spark = vectors.sparkSession
    whole_ids(vectors, id_col)
    whole_ids(queries, id_col)
    table = checkpointed(quantized(vectors, scale, id_col, vec_col))
    asked = checkpointed(quantized(queries, scale, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = table.unionByName(asked).agg(F.max(F.size("v")), F.max(length)).first()
    n = table.count()
    if not n or stats[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), lambda: None
    width, longest = max(1, stats[0]), stats[1] * (1 + 1e-9) + 1
    parts = shuffle_partitions(spark)
    per_chunk = max(1, _between(n * width // (2 * parts), chunk_numbers) // width)
    n_pivots = _between(int((n / per_chunk) ** 0.5) * 4, pivots)
    n_annuli = _between(-(-n // (n_pivots * per_chunk)), annuli)
    chosen = table.orderBy(F.xxhash64("id", "v"), "id").limit(n_pivots).toArrow()  # at most pivots[1] vectors
    index = Index(np.zeros((1, width + 1)), width, longest)
    index.pivots = index.raised(_matrix(chosen["v"].combine_chunks(), width))

    def place(batches):
        for batch in batches:
            for b in _slices(batch, n_pivots + width):
                d = index.distances(index.raised(_matrix(b.column(1), width)))
                near = d.argmin(1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near], pa.float64())], names=["id", "v", "pivot", "dist"])

    placed = checkpointed(table.mapInArrow(place, "id long, v array<double>, pivot int, dist double"))
    cuts = placed.groupBy("pivot").agg(F.percentile_approx("dist", [i / n_annuli for i in range(1, n_annuli)] or [0.5], 1000).alias("cuts"))
    # one row for each pivot
    number = F.col("pivot").cast("long") * (n_annuli + 1) + F.size(F.filter("cuts", lambda c: c < F.col("dist")))
    ringed = placed.join(F.broadcast(cuts), "pivot").select(number.alias("ring"), "id", "v", "dist")
    rings = ringed.groupBy("ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("m")).toArrow()  # at most pivots[1] * (annuli[1] + 1) rows
    ring_id, lo, hi, size = (rings[c].to_numpy() for c in ("ring", "lo", "hi", "m"))
    ring_pivot = ring_id // (n_annuli + 1)
    # a large annulus, such as one of equal vectors, is split by a hash of the id
    cut = np.maximum(1, -(-size // per_chunk))
    chunks = F.broadcast(spark.createDataFrame(pa.table({"ring": ring_id, "chunks": cut})))
    celled = ringed.join(chunks, "ring").select("ring", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.lit(0).alias("side"), "id", "v", F.lit(None).cast("long").alias("floor"))

    def bounds(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and annulus: the least distance there can be, and the greatest score that goes with it."""
        raised = np.hstack([q, np.zeros((len(q), 1))])
        d = index.distances(raised)[:, ring_pivot]
        gap = np.maximum(0, np.maximum(lo - d, d - hi))
        gap = np.maximum(0, gap - 1e-6 * (1 + d + hi))  # more than rounding can add
        return gap, ((q * q).sum(1)[:, None] + longest - gap * gap) / 2 * (1 + 1e-9) + 1

    def first(batches):
        for batch in batches:
            for b in _slices(batch, len(ring_id) + n_pivots):
                gap, _ = bounds(_matrix(b.column(1), width))
                order = np.argsort(gap, 1, kind="stable")
                # the nearest annuli that hold more than k vectors in all
                filled = np.cumsum(size[order], 1)
                take = (filled <= k).sum(1) + 1
                yield from sent(b, [o[:t] for o, t in zip(order, take, strict=True)])

    def rest(batches):
        for batch in batches:
            for b in _slices(batch, len(ring_id) + n_pivots):
                _, most = bounds(_matrix(b.column(1), width))
                yield from sent(b, [np.flatnonzero(m >= f) for m, f in zip(most, _floors(b.column(2)).astype(np.float64), strict=True)])

    def sent(b, to):
        """Each query once for every chunk of the annuli it goes to."""
        for i in range(b.num_rows):
            ring, times = ring_id[to[i]], cut[to[i]]
            at = np.repeat(ring, times)
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            row = pa.array(np.full(len(at), i))
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(chunk, pa.int64()), pa.array(np.ones(len(at), np.int32)), *[b.column(c).take(row) for c in range(3)]], names=["ring", "chunk", "side", "id", "v", "floor"])

    def scores(batches):
        key, ids, rows, waiting = None, None, None, []
        for batch in batches:
            ring, chunk, side = (batch.column(c).to_numpy() for c in range(3))
            edge = np.flatnonzero((np.diff(ring) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
            for i, j in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if key != (ring[i], chunk[i]):
                    key, waiting, ids = (ring[i], chunk[i]), [], None
                if side[i] == 0:
                    waiting.append((part.column(3).to_numpy(), _matrix(part.column(4), width)))
                    continue
                if waiting:
                    ids, rows, waiting = np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), []
                if ids is not None:
                    for b in _slices(part, len(ids)):
                        yield _best_of(b, ids, rows, k, width)

    def scored(asks: DataFrame) -> DataFrame:
        met = celled.unionByName(asks).repartition(parts, "ring", "chunk").sortWithinPartitions("ring", "chunk", "side", "id")
        return met.mapInArrow(scores, "query_id long, vec_id long, score long")

    asking = "ring long, chunk long, side int, id long, v array<double>, floor long"
    start = scored(asked.withColumn("floor", F.lit(None).cast("long")).repartition(parts, "id").mapInArrow(first, asking))
    kth = _best(start, k).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    floors = checkpointed(asked.join(kth, "id", "left").select("id", "v", "floor"))

    def counted(batches):
        for batch in batches:
            for b in _slices(batch, len(ring_id) + n_pivots):
                _, most = bounds(_matrix(b.column(1), width))
                seen = (most >= _floors(b.column(2)).astype(np.float64)[:, None]) @ size
                yield pa.record_batch([pa.array(seen / n, pa.float64())], names=["share"])

    found = _best(scored(floors.repartition(parts, "id").mapInArrow(rest, asking)), k).select("query_id", "rank", "vec_id", "score")
    return found, lambda: floors.mapInArrow(counted, "share double").agg(F.avg("share")).first()[0]


def _slices(b: pa.RecordBatch, cells: int) -> list[pa.RecordBatch]:
    """Parts of a batch, so that a matrix with so many cells for a row stays small."""
    step = max(1, CELLS // max(1, cells))
    return [b.slice(i, step) for i in range(0, b.num_rows, step)]


def _floors(column: pa.Array) -> np.ndarray:
    return np.array([-LONG - 1 if x is None else x for x in column.to_pylist()], np.int64)


def _best_of(asks: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray, k: int, width: int) -> pa.RecordBatch:
    """The k best of one chunk for each query that reach its floor; ids ascend, so equal scores stay in their order."""
    qid, s, floor = asks.column(3).to_numpy(), products(_matrix(asks.column(4), width), rows), _floors(asks.column(5))
    out = []
    for i in range(len(qid)):
        at = np.flatnonzero((s[i] >= floor[i]) & (ids != qid[i]))
        if len(at) > k:
            at = at[np.argsort(~s[i][at], kind="stable")[:k]]
        out.append((np.full(len(at), qid[i]), ids[at], s[i][at]))
    return pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
