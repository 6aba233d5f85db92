"""Importance resampling towards a target distribution, by hashed word runs with a head-tail vocabulary.

Each feature, a run of 1 to max_n consecutive words, falls into the bucket of its CRC-32. The frequent words are
the head: they are counted over all texts with Spark, and the CRC state after each of them, with the CRCs of
the frequent pairs of them, is broadcast. A run of head words then needs no bytes at all, or continues from a
state that is known; words and pairs outside the head, the tail, take their CRC from their bytes. Both give
the same number, so the bucket totals are exact, and the size of the head only decides how fast they come.

A document's weight is the sum of its features' gains, log ratios of the smoothed bucket shares of target and
documents; Gumbel noise from a hash of its id makes the greatest scores a sample without replacement. Ranks
come from one sort by ranges and the sizes of the ranges, so that no task sees all scores.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean, shuffle_partitions, text_slices

#: Most words and pairs in the head, and most bytes of one: what is broadcast is at most so large.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 32_768, 32_768, 48
#: What separates words becomes a space, A-Z become a-z, other bytes stay: all of UTF-8 beyond ASCII is in words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ROW_BITS = 33


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Words of each text: how many, and all of them in one array and one list."""
    each = [words_of(t) for t in texts.to_pylist()]
    flat = [w for ws in each for w in ws]
    return np.fromiter(map(len, each), np.int64, len(each)), pa.array(flat, pa.large_binary()), flat


class Head:
    """The frequent words with their CRC states, and the CRCs of frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: np.ndarray | None = None):
        self.words = pa.array(words, pa.large_binary())
        self.states = np.array([zlib.crc32(w) for w in words], np.int64)
        self.pairs = np.sort(np.zeros(0, np.int64) if pairs is None else pairs)
        self.pair_states = np.array([zlib.crc32(b" " + words[p % len(words)], int(self.states[p // len(words)])) for p in self.pairs.tolist()], np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the head, -1 for the tail."""
        if not len(self.words):
            return np.full(len(words), -1)
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def pair_keys(self, numbers: np.ndarray) -> np.ndarray:
        """A key for each word and the next if both are in the head, else -1."""
        a, b = numbers[:-1], numbers[1:]
        return np.where((a >= 0) & (b >= 0), a * len(self.words) + b, -1)

    def crcs(self, counts: np.ndarray, words: pa.Array, flat: list[bytes], max_n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, CRC) of every run of up to max_n words."""
        numbers, text = self.numbers(words), np.repeat(np.arange(len(counts)), counts)
        state = self.states[numbers] if len(self.words) else np.zeros(len(flat), np.int64)
        for i in np.flatnonzero(numbers < 0).tolist():
            state[i] = zlib.crc32(flat[i])
        texts, found, start = [text], [state], text
        for n in range(2, max_n + 1):  # state: of the runs of n - 1 words, by their first word
            if len(flat) < n:
                break
            state, known = state[:-1].copy(), np.zeros(len(state) - 1, bool)
            inside = start[:-1] == text[n - 1 :]
            if n == 2 and len(self.pairs):
                keys = self.pair_keys(numbers)
                at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                known = self.pairs[at] == keys
                state[known] = self.pair_states[at[known]]
            for i in np.flatnonzero(inside & ~known).tolist():
                state[i] = zlib.crc32(b" " + flat[i + n - 1], int(state[i]))
            start = start[:-1]
            texts.append(start[inside])
            found.append(state[inside])
        return np.concatenate(texts), np.concatenate(found)


def _most_frequent(parts: DataFrame, name: str, most: int) -> list:
    """Values of a table (value, n) with the greatest sums over 1, at most so many: all those over the least bar that
    leaves no more. The bars are 64 to a doubling, so their histogram is small, and no task sends more than it keeps."""
    bar = F.floor(F.log2("n") * 64)
    counts = checkpointed(parts.groupBy(name).agg(F.sum("n").alias("n")).where("n > 1").withColumn("bar", bar))
    least, room = None, most
    for r in counts.groupBy("bar").count().orderBy(F.desc("bar")).collect():  # at most 64 * 64 rows
        room -= r["count"]
        if room < 0:
            break
        least = r.bar
    return [] if least is None else [r[0] for r in counts.where(F.col("bar") >= least).select(name).collect()]


def head_of(texts: DataFrame, max_n: int, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words of a table (text), and pairs of them; all texts are counted."""

    @lean
    def counted(batches):
        for b in text_slices(batches, 0):
            _, words, _ = _words(b.column(0))
            short = words.filter(pc.less_equal(pc.binary_length(words), HEAD_BYTES))
            n = short.value_counts()
            yield pa.record_batch([n.field(0).cast(pa.binary()), n.field(1).cast(pa.int64())], names=["word", "n"])

    words = sorted(bytes(x) for x in _most_frequent(texts.mapInArrow(counted, "word binary, n long"), "word", n_words))
    if max_n < 2 or not words or not n_pairs:
        return Head(words)
    head = Head(words)

    @lean
    def paired(batches):
        for b in text_slices(batches, 0):
            counts, found, _ = _words(b.column(0))
            text, keys = np.repeat(np.arange(len(counts)), counts), head.pair_keys(head.numbers(found))
            pair, n = np.unique(keys[(keys >= 0) & (text[:-1] == text[1:])], return_counts=True)
            yield pa.record_batch([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return Head(words, np.array(_most_frequent(texts.mapInArrow(paired, "pair long, n long"), "pair", n_pairs), np.int64))


def featured(table: DataFrame, head: Head, max_n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, buckets) of each row: the bucket of every feature, repeats included."""
    kind = table.schema[id_col].dataType.simpleString()

    @lean
    def run(batches):
        for b in text_slices(batches, 1):
            counts, words, flat = _words(b.column(1))
            text, crc = head.crcs(counts, words, flat, max_n)
            order = np.argsort(text, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b.num_rows))])
            yield pa.record_batch([b.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((crc % buckets)[order], pa.int32()))], names=["id", "n_words", "buckets"])

    return table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words long, buckets array<int>")


def totals(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket. A task adds up its own first, so that it sends one row a bucket."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    b = len(s)
    all_s, all_t = float(s.sum() + b), float(t.sum() + b)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def resampled(docs: DataFrame, target: DataFrame, max_n: int = 2, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per document: its id, n_words, n_features, weight, score, and rank if it is drawn (else null).

    Of the documents with min_words words or more, percent of 100 are drawn, rounded down, by greatest score,
    ties to the smaller id; 1 is the first. Null and empty texts have no features: weight 0, not drawn (unless
    min_words is 0, when they take part). A null id is hashed as an empty text and comes first among equal
    scores. Rows of one id are documents of their own, with the same noise. No documents: no rows. An empty
    target: its shares are all equal. Other columns are not read.
    """
    if max_n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("max_n and buckets must be 1 at least, percent 0 to 100")
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    head = head_of(texts, max_n, head_words, head_pairs)
    features = checkpointed(featured(docs, head, max_n, buckets, id_col, text_col))
    wanted = featured(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), head, max_n, buckets, "id", "text")
    gain = gains(totals(features, buckets), totals(wanted, buckets))

    def weighed(batches):
        for b in batches:
            c = b.column(2)
            ends = c.offsets.to_numpy().astype(np.int64)
            added = np.concatenate([[0], np.cumsum(gain[c.flatten().to_numpy()])])
            at = ends - ends[0]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(at)), pa.array(added[at[1:]] - added[at[:-1]])], names=["id", "n_words", "n_features", "weight"])

    kind = features.schema["id"].dataType.simpleString()
    weights = features.mapInArrow(weighed, f"id {kind}, n_words long, n_features long, weight long")
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0))).cast("long")
    scored = checkpointed(weights.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") < min_words).alias("out")))
    order = ["out", F.desc("score"), F.asc_nulls_first("id")]
    spark = docs.sparkSession
    ranged = scored.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", ROW_BITS)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~F.col("out")).alias("able"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("able").over(Window.partitionBy()).alias("able"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1) + 1
    drawn = ~F.col("out") & (rank <= F.floor(F.col("able") * percent / 100))
    return placed.join(F.broadcast(sizes), "part").select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that resampled() draws, all columns kept. Ids should be unique: all rows of a drawn id
    come, and rows with a null id never do."""
    ids = resampled(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col(f"`{id_col}`").alias("drawn_id")).distinct()
    mine = docs[f"`{id_col}`"] == ids["drawn_id"]
    return docs.join(ids, mine, "left_semi")
