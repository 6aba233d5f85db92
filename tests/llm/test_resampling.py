import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pricewell.llm.queries import op13_importance_resampling
from pricewell.llm.resampling import Head, drawn_documents, gains, head_of, resampled, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *features(t, max_n)) for i, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, fs in each:
        for f in fs:
            s[bucket(f)] += 1
    for x in target:
        for f in features(x, max_n)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, words, fs in each:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return {r[0]: tuple(r[1:5]) for r in rows}


def by_id(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert by_id(op13_importance_resampling(spark, sf_dir)) == brute(docs, target)


@pytest.mark.parametrize(("max_n", "head_words", "head_pairs"), [(1, 5, 0), (2, 40, 30), (2, 0, 0), (3, 40, 30)])
def test_any_head_gives_the_same_totals(spark, sf_dir, max_n, head_words, head_pairs):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.where("length(text) < 3000")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], max_n, 500, 25)
    got = resampled(docs, target, max_n, 500, 25, head_words=head_words, head_pairs=head_pairs)
    assert by_id(got) == want


def test_head_holds_states_and_pairs():
    head = Head([b"a", b"bc"], np.array([1]))  # the pair (a, bc)
    assert head.states.tolist() == [zlib.crc32(b"a"), zlib.crc32(b"bc")] and head.pair_states.tolist() == [zlib.crc32(b"a bc")]
    words = [b"a", b"bc", b"tail", b"a"]
    text, crc = head.crcs(np.array([3, 0, 1]), pa.array(words, pa.large_binary()), words, 3)
    assert text.tolist() == [0, 0, 0, 2, 0, 0, 0]
    assert crc.tolist() == [zlib.crc32(w) for w in (*words, b"a bc", b"bc tail", b"a bc tail")]


def test_head_is_of_the_most_frequent(spark):
    table = spark.createDataFrame([("b b b a a once",), ("a b " + "x" * 100 + " " + "x" * 100,), (None,), ("",)], "text string")
    head = head_of(table, 2, 2, 1)
    assert head.words.to_pylist() == [b"a", b"b"] and head.pairs.tolist() == [3]  # a b, b a and a a stand once, b b twice
    assert head_of(table.limit(0), 2).words.to_pylist() == []


def test_words():
    assert words_of("Ab-cD_9\x7fé Ünï\x00x") == ["ab".encode(), b"cd", b"9", "é".encode(), "Ünï".encode(), b"x"]
    assert words_of(None) == words_of("") == words_of(" .,") == []


def test_gains_of_nothing():
    assert gains(np.zeros(4, np.int64), np.zeros(4, np.int64)).tolist() == [0, 0, 0, 0]


def test_edge_tables(spark):
    long = " ".join(f"w{i % 7}" for i in range(40_000))
    rows = [(1, long, 0), (1, long, 1), (2, None, 2), (3, "", 3), (None, "a b", 4), (4, "a b", 5), (5, "a b", 6), (6, "one", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `weight.id` int").withColumnRenamed("weight.id", "id")
    target = spark.createDataFrame([("a b a",), (None,)], "text string")
    got = resampled(docs, target, 2, 100, 50, min_words=2).collect()
    assert len(got) == 8 and sum(r["rank"] is not None for r in got) == 2  # of five documents of two words and more
    assert {(r.n_features, r.weight, r["rank"]) for r in got if r.doc_id in (2, 3)} == {(0, 0, None)}
    assert {r.n_features for r in got if r.doc_id == 1} == {79_999}
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert resampled(docs.limit(0), target).count() == 0
    flat = resampled(docs, target.limit(0), 1, 100, 0).collect()
    assert all(r["rank"] is None for r in flat)
    named = docs.withColumnRenamed("doc_id", "doc.id").withColumn("rank", docs["id"])
    kept = drawn_documents(named, target, "doc.id", max_n=2, buckets=100, percent=100, min_words=2)
    assert kept.columns == named.columns and sorted(r["doc.id"] for r in kept.collect()) == [1, 1, 4, 5]
    with pytest.raises(ValueError, match="max_n"):
        resampled(docs, target, 0)
