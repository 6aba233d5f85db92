"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: a bounded sample teaches several rotations (principal axes, then alternating between signs and the
rotation that fits them best); the signs of a rotated vector are its bits. One more coordinate makes all lengths
equal first, so that near codes are great inner products. Codes are split into substrings, and every chunk of the
table indexes each substring: its values, and under each value the vectors that have it. If two codes differ in at
most r bits, some substring differs in at most its share of r (pigeonhole), so the values within that share
give every code within r; those that are so by the whole code are ranked by their floats.

The radius is the one that holds the wanted share of the true neighbours of a few queries, which are compared
with all vectors. A query that finds fewer than k within it goes on to a radius of all bits, so that none comes
back short.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, shuffle_partitions, whole_ids

#: Rotations, each of which gives a bit for every coordinate, at most BITS of them; bits of a substring (8, 16, 32 or 64).
ROTATIONS, BITS, SUBSTRING = 3, 64, 64
#: Vectors the rotations are learned from, and rounds of learning.
SAMPLE, ROUNDS = 8192, 12
#: Queries that are compared with all vectors to choose the radius, and the share of their neighbours it must hold.
CALIBRATION, RECALL = 128, 0.975
#: Numbers in a chunk of vectors, at least and at most: a partition gets about two chunks in between.
CHUNK_NUMBERS = (1 << 18, 1 << 21)
#: Numbers that a task works on at once.
CELLS = 1 << 22
FOUND = "query_id long, vec_id long, score double, probed long, visited long"
_FOUND = ["query_id", "vec_id", "score", "probed", "visited"]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: neither null nor zero, and no component null or not finite."""
    x = F.col(f"`{vec_col}`")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    some = F.exists(x, lambda e: e != 0)
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & ~bad & some).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<double>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, added in order of the components, so that equal vectors score equally."""
    return np.cumsum(v * q, axis=1)[:, -1] if v.shape[1] else np.zeros(len(v))


@cache
def flips(bits: int, share: int) -> np.ndarray:
    """All words of so many bits with at most `share` ones."""
    return np.array([sum(1 << b for b in at) for n in range(share + 1) for at in combinations(range(bits), n)], np.uint64).astype(f"<u{bits // 8}")


class Codes:
    """Rotations learned from a sample, and the codes they give."""

    def __init__(self, sample: np.ndarray, longest: float, rotations: int = ROTATIONS, bits: int = BITS, substring: int = SUBSTRING, rounds: int = ROUNDS, seed: int = 11):
        self.longest, self.substring = longest, substring
        x = self.raised(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        _, _, axes = np.linalg.svd(x.T @ x)
        self.axes = axes[: min(bits, sample.shape[1], x.shape[1])].T
        y, rng = x @ self.axes, np.random.default_rng(seed)
        self.rotations = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((y.shape[1], y.shape[1])))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ w).T
            self.rotations.append(r)
        self.turn = self.axes @ np.hstack(self.rotations)
        self.bits = self.turn.shape[1]
        self.substrings = -(-self.bits // substring)

    def raised(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """One more coordinate: it makes vectors equally long; a query has none there."""
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))
        return np.hstack([v, more[:, None]])

    def __call__(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """A row of substrings for each vector; the last may have fewer."""
        if query:  # at the length of the vectors, or the mean would weigh differently
            v = v * np.sqrt(self.longest / np.maximum((v * v).sum(1), 1e-300))[:, None]
        signs = (self.raised(v, query) - self.mean) @ self.turn >= 0
        wide = np.zeros((len(v), self.substrings * self.substring), bool)
        wide[:, : self.bits] = signs
        return np.packbits(wide, axis=1, bitorder="little").view(f"<u{self.substring // 8}")

    def shares(self, radius: int) -> np.ndarray:
        """The radius of each substring: one of them keeps to its share when the whole keeps to `radius`."""
        m = self.substrings
        return np.full(m, radius // m) - (np.arange(m) > radius % m)


class Chunk:
    """Vectors with an inverted index of each substring of their codes."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, codes: Codes):
        self.ids, self.v, self.code = ids, v, codes(v)
        self.index = []
        for j in range(codes.substrings):
            order = np.argsort(self.code[:, j], kind="stable")
            values, starts = np.unique(self.code[order, j], return_index=True)
            self.index.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int, shares: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(rows within the radius of a code, values of substrings in their shares, rows that stand under them)."""
        hit, probed = np.zeros(len(self.ids), bool), 0
        for j, (values, starts, order) in enumerate(self.index):
            if shares[j] < 0:
                continue
            near = _near(values, code[j], int(shares[j]))
            probed += len(near)
            if len(near) == len(values):
                hit[:] = True
                continue
            sizes = starts[near + 1] - starts[near]
            at = np.repeat(starts[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            hit[order[at]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(1, dtype=np.int32) <= radius], probed, len(rows)

    def best(self, query_id: int, q: np.ndarray, code: np.ndarray, k: int, radius: int, shares: np.ndarray) -> tuple:
        rows, probed, visited = self.within(code, radius, shares)
        rows = rows[self.ids[rows] != query_id]
        score = inner(q, self.v[rows])
        if len(rows) > k:
            top = np.lexsort((self.ids[rows], -score))[:k]
            rows, score = rows[top], score[top]
        return self.ids[rows], score, probed, visited


def _near(values: np.ndarray, value, share: int) -> np.ndarray:
    """Places of the values (ascending) that differ from one in at most `share` bits: each such word is looked up, or
    each value compared, whichever is less."""
    bits = 8 * values.itemsize
    if sum(comb(bits, n) for n in range(share + 1)) < len(values):
        words = value ^ flips(bits, share)
        at = np.minimum(np.searchsorted(values, words), len(values) - 1)
        return at[values[at] == words]
    return np.flatnonzero(np.bitwise_count(values ^ value) <= share)


def _slices(b: pa.RecordBatch, width: int):
    step = max(1, CELLS // max(1, width))
    return [b.slice(i, step) for i in range(0, b.num_rows, step)]


def _met(table: DataFrame, queries: DataFrame, chunks: int) -> DataFrame:
    """Chunks of vectors, each followed by all queries: (chunk, side, id, v) sorted, side 0 the vectors."""
    mine = table.select(F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("side"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), "id", "v")
    parts = min(chunks, shuffle_partitions(table.sparkSession))
    return mine.unionByName(asked).repartition(parts, "chunk").sortWithinPartitions("chunk", "side", "id")


def _search(table: DataFrame, queries: DataFrame, codes: Codes, k: int, radius: int, width: int, chunks: int) -> DataFrame:
    """Each query's k best within the radius in each chunk, and how many values and vectors it met there; a query
    that found nothing in a chunk has a row without vec_id."""
    shares = codes.shares(radius)

    @lean
    def run(batches):
        key, waiting, chunk = None, [], None
        for batch in batches:
            for b in _slices(batch, width):
                numbers, side = b.column(0).to_numpy(), b.column(1).to_numpy()
                edge = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(side) != 0)) + 1
                for i, j in zip([0, *edge], [*edge, b.num_rows], strict=True):
                    if i == j:
                        continue
                    if key != numbers[i]:
                        key, waiting, chunk = numbers[i], [], None
                    part = b.slice(i, j - i)
                    ids, v = part.column(2).to_numpy(), matrix(part.column(3), width)
                    if side[i] == 0:
                        waiting.append((ids, v))
                        continue
                    if waiting:
                        chunk, waiting = Chunk(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), codes), []
                    if chunk is not None:
                        yield _answers(chunk, ids, v, codes(v, True))

    def _answers(chunk, ids, v, code):
        out = []
        for n, query in enumerate(ids.tolist()):
            found, score, probed, visited = chunk.best(query, v[n], code[n], k, radius, shares)
            m = max(1, len(found))
            first = np.arange(m) == 0
            some = np.full(m, bool(len(found)))
            out.append((np.full(m, query), np.resize(found, m) if len(found) else np.zeros(m, np.int64), np.resize(score, m) if len(found) else np.zeros(m), probed * first, visited * first, some))
        q, ids_, score, probed, visited, some = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.record_batch([pa.array(q, pa.int64()), pa.array(ids_, pa.int64(), mask=~some), pa.array(score, pa.float64(), mask=~some), pa.array(probed, pa.int64()), pa.array(visited, pa.int64())], names=_FOUND)

    return _met(table, queries, chunks).mapInArrow(run, FOUND)


def _compared(table: DataFrame, ids: np.ndarray, q: np.ndarray, codes: Codes, k: int, width: int) -> np.ndarray:
    """Code distances from some queries to their k true neighbours, by brute force over all vectors."""
    mine = codes(q, True)

    def run(batches):
        kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(ids)
        for batch in batches:
            for b in _slices(batch, width + len(ids)):
                found, v = b.column(0).to_numpy(), matrix(b.column(1), width)
                score, code = q @ v.T, codes(v)
                for i in range(len(ids)):
                    top = np.flatnonzero(found != ids[i])
                    if len(top) > k:
                        top = top[np.argpartition(-score[i][top], k - 1)[:k]]
                    s, n, d = (np.concatenate([x, y]) for x, y in zip(kept[i], (score[i][top], found[top], np.bitwise_count(code[top] ^ mine[i]).sum(1, dtype=np.int32)), strict=True))
                    best = np.lexsort((n, -s))[:k]
                    kept[i] = s[best], n[best], d[best]
        for i, (s, n, d) in enumerate(kept):
            yield pa.record_batch([pa.array(np.full(len(s), i)), pa.array(s), pa.array(n), pa.array(d, pa.int32())], names=["q", "score", "vec_id", "bits"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = table.mapInArrow(run, "q long, score double, vec_id long, bits int").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    return np.array([r.bits for r in near.select("bits").collect()], np.int64)  # at most k for each of these queries


def _sample(df: DataFrame, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    t = df.orderBy(F.xxhash64("id", "v"), "id").limit(rows).toArrow()
    return t["id"].to_numpy(), matrix(t["v"].combine_chunks(), width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, rotations: int = ROTATIONS, bits: int = BITS, substring: int = SUBSTRING, sample: int = SAMPLE, calibration: int = CALIBRATION, radius: int | None = None, chunk_numbers: tuple[int, int] = CHUNK_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors of other ids that the index finds, by inner
    product in double precision, ties to the smaller id; all, if there are no more than k.

    The rotations are learned from at most `sample` vectors and the radius is chosen on at most `calibration`
    queries (or given); every vector is indexed and every query answered. Vectors or ids that are null, zero
    vectors, and vectors with a null or not finite component take no part. Vectors of different lengths are
    compared as if filled with zeros. Ids must be whole numbers, else TypeError, and are taken to be unique: rows
    of one id count as that many vectors, and a query with a repeated id is answered once, by its least vector.
    No vectors or no queries: no rows. Other columns are not read.
    """
    found = _nearest(vectors, queries, k, id_col, vec_col, recall, rotations, bits, substring, sample, calibration, radius, chunk_numbers)
    return found[0]


def _nearest(vectors, queries, k, id_col, vec_col, recall, rotations, bits, substring, sample, calibration, radius, chunk_numbers) -> tuple[DataFrame, dict]:
    spark = vectors.sparkSession
    whole_ids(vectors, id_col)
    whole_ids(queries, id_col)
    table = checkpointed(usable(vectors, id_col, vec_col))
    asked = checkpointed(usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width, longest = table.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    wider = asked.agg(F.max(F.size("v"))).first()[0]
    if not n or not wider:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), {}
    width = max(width, wider)
    codes = Codes(_sample(table, sample, width)[1], longest, rotations, bits, substring)
    if radius is None:
        bits_off = np.sort(_compared(table, *_sample(asked, calibration, width), codes, k, width))
        radius = int(bits_off[min(len(bits_off) - 1, int(recall * len(bits_off)))]) if len(bits_off) else codes.bits
    parts = shuffle_partitions(spark)
    per_chunk = max(1, min(max(n * width // (2 * parts), chunk_numbers[0]), chunk_numbers[1]) // width)
    chunks = -(-n // per_chunk)
    first = checkpointed(_search(table, asked, codes, k, radius, width, chunks))
    met = first.groupBy("query_id").agg(F.count("vec_id").alias("found"), F.sum("probed").alias("probed"), F.sum("visited").alias("visited"))
    met = checkpointed(met)
    short = met.where(F.col("found") < k).select(F.col("query_id").alias("id"))
    told = met.agg(F.avg("probed"), F.avg("visited"), F.count_if(F.col("found") < k)).first()
    if told[2] and radius < codes.bits:
        again = asked.join(short, "id", "left_semi")
        rest = _search(table, again, codes, k, codes.bits, width, chunks)
        first = first.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return found, {"radius": radius, "bits": codes.bits, "values": told[0], "visited": told[1] / n, "short": told[2], "chunks": chunks}


def visited_share(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, rotations: int = ROTATIONS, bits: int = BITS, substring: int = SUBSTRING, sample: int = SAMPLE, calibration: int = CALIBRATION, radius: int | None = None, chunk_numbers: tuple[int, int] = CHUNK_NUMBERS) -> dict:
    """What the index does on a table: radius, bits, values of substrings that a query meets on average, share of
    the vectors that stand under them, and the queries that had to go on to all bits."""
    return _nearest(vectors, queries, k, id_col, vec_col, recall, rotations, bits, substring, sample, calibration, radius, chunk_numbers)[1]
