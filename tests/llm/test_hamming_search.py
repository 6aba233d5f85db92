import numpy as np
import pytest

from pricewell.llm import hamming_search as h
from pricewell.llm.queries import op11_hamming_search


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def truth(ids, v, queries, k=20):
    out = {}
    for q in queries:
        s = h.inner(v[ids == q][0], v)
        top = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in top]
    return out


def test_query_finds_nine_in_ten(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = rows_of(op11_hamming_search(spark, sf_dir))
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    want = truth(ids, v, [i for i in ids if i % 20 == 0])
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, s in found:
            assert s == h.inner(v[ids == q][0], v[ids == i])[0]


@pytest.mark.parametrize("substring", [8, 16, 32, 64])
def test_every_code_within_the_radius_is_retrieved(substring):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 24))
    v[300:600] = v[:300] + 0.05 * rng.standard_normal((300, 24))
    codes = h.Codes(v, float((v * v).sum(1).max()), 2, 64, substring)
    chunk, asked = h.Chunk(np.arange(900), v, codes), codes(v[:40])
    assert codes.bits == 48 and codes.shares(48).max() >= 48 // codes.substrings
    for radius in (0, 1, 3, 7, 20, 48):
        for code in asked:
            rows, probed, visited = chunk.within(code, radius, codes.shares(radius))
            assert rows.tolist() == np.flatnonzero(np.bitwise_count(chunk.code ^ code).sum(1) <= radius).tolist()
            assert len(rows) <= visited <= 900 and probed >= 1


def test_words_within_a_share():
    assert h.flips(8, 0).tolist() == [0] and len(h.flips(16, 2)) == 1 + 16 + 120 and h.flips(64, 1).max() == 1 << 63
    values = np.unique(np.random.default_rng(4).integers(0, 1 << 16, 5000).astype("<u2"))
    for share in range(5):  # looked up, then compared
        assert sorted(h._near(values, values[9], share).tolist()) == np.flatnonzero(np.bitwise_count(values ^ values[9]) <= share).tolist()


def clustered(n=3000, d=32):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((n // 30, d))
    v = np.repeat(centres, 30, 0) + 0.04 * rng.standard_normal((n, d))
    return np.round(v / np.linalg.norm(v, axis=1)[:, None], 6)


def test_clusters_are_visited_only(spark):
    v = clustered()
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    told = h.visited_share(frame, frame.where("vec_id % 20 = 0"), chunk_numbers=(1 << 15, 1 << 16))
    assert told["visited"] < 0.1 and told["radius"] < told["bits"] / 4 and told["short"] == 0 and told["chunks"] == 3
    got = rows_of(h.nearest(frame, frame.where("vec_id % 20 = 0"), chunk_numbers=(1 << 15, 1 << 16)))
    want = truth(np.arange(len(v)), v, range(0, len(v), 20))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_short_queries_go_on_to_all_bits(spark):
    v = clustered(300)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = rows_of(h.nearest(frame, frame.where("vec_id < 5"), k=40, radius=0))
    assert got == truth(np.arange(300), v, range(5), 40)


def test_edge_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (None, [1.0, 1.0]), (20, [-1.0]), (9, [])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id int, embedding array<float>, rank int, score double")
    queries = frame.where("vec_id % 20 = 0")
    assert rows_of(h.nearest(frame, queries)) == {0: [(1, 1.0), (2, 1.0), (3, 0.0), (20, -1.0)], 20: [(3, 0.0), (0, -1.0), (1, -1.0), (2, -1.0)]}
    assert rows_of(h.nearest(frame, queries, k=1)) == {0: [(1, 1.0)], 20: [(3, 0.0)]}
    assert h.nearest(frame.limit(0), queries).count() == 0 == h.nearest(frame, queries.limit(0)).count()
    assert h.nearest(frame.where("vec_id = 0"), queries.where("vec_id = 0")).count() == 0
    twice = frame.where("vec_id < 3").unionByName(frame.where("vec_id < 1"))
    assert rows_of(h.nearest(twice, twice.where("vec_id = 0"))) == {0: [(1, 1.0), (2, 1.0)]}
    with pytest.raises(TypeError, match="whole numbers"):
        h.nearest(frame.withColumn("vec_id", frame.vec_id.cast("string")), queries)


def test_copies_are_dealt_to_all_chunks(spark):
    frame = spark.createDataFrame([(i, [1.0, 1.0] if i % 3 else [float(i), -1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    got = rows_of(h.nearest(frame, frame.where("vec_id % 20 = 0"), chunk_numbers=(64, 64)))
    assert set(got) == set(range(0, 400, 20)) and all(len(x) == 20 for x in got.values())
    far = rows_of(h.nearest(frame, frame.where("vec_id = 1"), recall=1.0, chunk_numbers=(64, 64)))
    assert far[1] == truth(np.arange(400), np.array([[1.0, 1.0] if i % 3 else [float(i), -1.0] for i in range(400)]), [1])[1]
