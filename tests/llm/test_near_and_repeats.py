"""Jaccard join and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricewell.llm import exchange, ngram_join
from pricewell.llm.ngram_join import components, first_of_each, near_duplicates
from pricewell.llm.queries import op4_ngram_join, op10_suffix_dedup
from pricewell.llm.suffix_dedup import deduplicated, without_repeats


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    holders, up = defaultdict(list), {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sorted(sets.items()):
        for e, k in Counter(e for x in s for e in holders[x]).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_texts(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    boiler = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += boiler
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return texts


EDGES = ["", None, "   \n", "one two", "One  two", "two one", "x " * 300, "x " * 300, "a b c d e", "a b c d E", "nul\0 in it a b c"]


def as_table(spark, texts, extra="n_shingles string, set string"):
    rows = [(i * 3 + 1, t, "x", "y") for i, t in enumerate(texts)]
    return [(r[0], r[1]) for r in rows], spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows, docs = as_table(spark, EDGES + near_texts())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_hot_shingles_and_chains_equal_brute_force(spark, monkeypatch):
    N = ngram_join
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(3)
    boiler = [f"b{i}" for i in range(30)]
    # over 256 sets share all of the boilerplate; some pairs of them are similar
    hot = [" ".join(boiler + [f"u{i}x{k}" for k in range(rng.randrange(1, 9))]) for i in range(320)]
    words = [f"c{i}" for i in range(9 * 150 + 60)]
    chain = [" ".join(words[9 * i : 9 * i + 60]) for i in range(150)]  # neighbours share 47 of 65 shingles: under the threshold
    rows, docs = as_table(spark, hot + chain)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == want
    ids = [3 * i + 1 for i in range(len(hot), len(rows))]
    assert all(want[i][1] == i for i in ids)
    found = N.named_sets(docs, 5, "doc_id", "text").groupBy("set").agg({"id": "min", "n": "max"}).toDF("set", "rep", "n")
    sets = N.prefixes(N.shared_shingles(docs, 5, "text").join(found, "set")).cache()
    assert {r.rep for r in sets.where("size(hot) > 0").select("rep").collect()} <= {3 * i + 1 for i in range(len(hot))} and sets.where("size(hot) > 0").count()
    known = sets.where(f"rep >= {ids[0]}").selectExpr("explode(p0) AS token", "rep")
    known = known.join(known.groupBy("token").agg({"rep": "min"}).toDF("token", "hub"), "token")
    sizes = [r[1] for r in N.remaining_groups(known).groupBy("group_id").count().collect()]
    assert max(sizes) <= 8  # the chain, one family, is not compared as a whole


def test_block_filters_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60).astype(np.int64)
    lists = [np.unique(np.concatenate([rng.choice(base, rng.integers(38, 60), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 6))])) for _ in range(40)]
    n = np.array([len(x) for x in lists])
    shorter = [len(x) - -(-75 * len(x) // 100) + 1 for x in lists]
    by_hash = lambda x, k: x[np.argsort(ngram_join.mixed(x.view(np.uint64) * ngram_join.PLACES[k]), kind="stable")]
    flat = lambda parts: (np.concatenate(parts), np.array([len(p) for p in parts]))
    prefixes = [flat([by_hash(x, k)[:m] for x, m in zip(lists, shorter, strict=True)]) for k in (20, 21)]
    links = ngram_join._links(np.arange(40), np.arange(40), n, flat(lists), prefixes, 75)
    up = list(range(40))
    for i in range(40):
        for j in range(i):
            k = len(set(lists[i]) & set(lists[j]))
            if 100 * k >= 75 * (n[i] + n[j] - k):
                up = [up[j] if x == up[i] else x for x in up]
    got = list(range(40))
    for i, j in links:
        got = [got[j] if x == got[i] else x for x in got]
    same = lambda g: {(i, j) for i in range(40) for j in range(i) if g[i] == g[j]}
    assert same(got) == same(up) and len(same(up)) > 20


@pytest.mark.parametrize("turns", [0, 1, 3])
def test_any_number_of_pivot_rounds_finds_the_same_classes(spark, turns, monkeypatch):
    N = ngram_join
    monkeypatch.setattr(N, "BLOCK", 10)

    rows, docs = as_table(spark, near_texts(9))
    found = N.named_sets(docs, 5, "doc_id", "text").where("set IS NOT NULL").groupBy("set").agg({"id": "min", "n": "max"}).toDF("set", "rep", "n")
    sets = N.prefixes(N.shared_shingles(docs, 5, "text").join(found, "set"))
    labels = {r.rep: r.label for r in N.set_classes(sets, turns=turns).collect()}
    want = brute_components(rows)
    reps = [r.rep for r in found.collect()]
    assert {r: labels.get(r, r) for r in reps} == {r: want[r][1] for r in reps}


def test_join_edge_tables(spark):
    _, docs = as_table(spark, ["a b c d e f"] * 3)
    assert near_duplicates(docs.limit(0)).count() == 0
    odd = docs.union(spark.createDataFrame([(None, "a b c d e f", "x", "y"), (1, "a b c d e f", "x", "y")], docs.schema))
    got = near_duplicates(odd).collect()
    assert len(got) == 5 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (4, 1), (7, 1), (None, None)}
    kept = first_of_each(odd)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    clash = docs.toDF("doc_id", "text", "text_name", "_id")
    assert first_of_each(clash).count() == 1 and first_of_each(clash).columns == clash.columns
    twice = docs.limit(1).union(spark.createDataFrame([(5, "a b c d e f", "x", "y"), (5, "all of its own words here", "x", "y"), (5, None, "x", "y")], docs.schema))
    assert sorted((r.doc_id, r.text or "") for r in first_of_each(twice).collect()) == [(1, "a b c d e f"), (5, ""), (5, "all of its own words here")]
    with pytest.raises(TypeError, match="whole numbers"):
        near_duplicates(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {(r.rep, r.label) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def brute_repeats(rows, n=50):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - n + 1):
            first.setdefault(t[i : i + n], d)
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        out[d] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest())
    return out


def repeat_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            i = rng.randrange(len(p) // 2)
            parts += [p[i : i + rng.randrange(20, 200)], " ".join(word() for _ in range(5))]
        texts.append("".join(parts))
    texts += ["a" * 300, "a" * 60 + "b" * 60, "ab" * 80 + "xyz", "x" + "ab" * 30, "", "short", "é" * 26 + "!", "é" * 100, "a" * 300, "abc" * 30 + "\0" * 80, "\0" * 90, texts[3], texts[3], "q" * 49, "q" * 49, "q" * 50, "q" * 50]
    rng.shuffle(texts)
    return texts


def digests(rows):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows, docs = as_table(spark, repeat_texts(), "spans string, kept string")
    want = brute_repeats([(d, t.encode()) for d, t in rows])
    assert digests(deduplicated(docs.repartition(3)).collect()) == want
    monkeypatch.setattr(exchange, "HOT", 3)
    monkeypatch.setattr(exchange, "FLUSH", 500)
    assert digests(deduplicated(docs.repartition(2)).collect()) == want
    short = brute_repeats([(d, t.encode()) for d, t in rows], 20)
    assert digests(deduplicated(docs, length=20).collect()) == short


def test_repeats_edge_tables(spark):
    text = "the quick brown fox jumps over the lazy dog again and again and again"
    docs = spark.createDataFrame([(2, text, 1), (None, text, 1), (1, text, 1), (1, text, 1), (1, "y" + text, 1), (5, None, 1), (None, "z" * 80, 1), (None, "z" * 80, 1)], "doc_id long, text string, owner int")
    assert deduplicated(docs.limit(0)).count() == 0
    kept = sorted((str(r.doc_id), len(r.kept)) for r in deduplicated(docs).collect())
    assert kept == [("1", len(text)), ("1", len(text)), ("1", len(text) + 1), ("2", 0), ("5", 0), ("None", 0), ("None", 80), ("None", 80)]
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 5").first().text is None and cut.where("doc_id = 2").first().text == ""


def test_queries_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op4_ngram_join(spark, sf_dir).collect()} == brute_components(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, sf_dir).collect()} == brute_repeats([(d, t.encode()) for d, t in rows])


def test_links_at_the_threshold_of_long_texts():
    # 100 * common is no float32 here: it would be rounded under the exact threshold
    k = next(k for k in range(671_100, 700_000, 3) if int(np.float32(100 * k)) < 100 * k)
    total = 7 * k // 3
    size = np.array([total // 2, total - total // 2])
    assert 100 * k == 75 * (total - k)
    tokens = np.concatenate([np.arange(size[0]), np.arange(size[0] - k, total - k)])
    args = np.array([4, 9]), np.array([4, 9])
    sets = (tokens, size)
    assert ngram_join._links(*args, size, sets, [sets, sets], 75) == [(4, 9)]
    assert ngram_join._links(*args, size + 1, sets, [sets, sets], 75) == []
    # no link without a token in common under each order, whatever the sets hold
    assert ngram_join._links(*args, size, sets, [sets, (np.array([1, 2]), np.array([1, 1]))], 75) == []


def _told(rank, packed, buckets):
    """(owner, open) -> sorted replies of a bucket's rank()."""
    out = {}
    for r in exchange.gathered(rank(iter(packed), 7, buckets)):
        for x in r.to_pylist():
            for flag in ("taken", "open"):
                out[x["owner"], flag] = x[flag]
    return out


def test_names_of_few_owners_in_each_of_many_flushes_stay_bounded(monkeypatch):
    """A name with 100 owners in each of 60 flushes is hot in none of them; a bucket must not hold all 6,000."""
    rng, flushes = np.random.default_rng(3), []
    for with_b in (False, True):
        packed = []
        for k in range(60):
            out = exchange.Flushed(1, 7, with_b)
            a = np.concatenate([np.full(100, 5), rng.integers(10, 1 << 40, 20)]).astype(np.uint64)
            b = np.concatenate([np.arange(100) % 3, rng.integers(0, 9, 20)]).astype(np.uint64)
            owner = np.concatenate([np.arange(100) + 100 * k, rng.integers(0, 6000, 20)])
            packed += [*out.add(a, b, owner.astype(np.int64)), *out.flush()]
        flushes.append(packed)
    for packed, ranks in zip(flushes, ((exchange.count_owners,), (exchange.rank_first, exchange.rank_taken)), strict=True):
        for rank in ranks:
            monkeypatch.setattr(exchange, "HELD", 1 << 40)
            want = _told(rank, packed, 1)
            sizes = []
            read = exchange._joined
            monkeypatch.setattr(exchange, "HELD", 1500)
            monkeypatch.setattr(exchange, "_joined", lambda arrays: sizes.append(sum(map(len, arrays))) or read(arrays))
            got = _told(rank, packed, 1)
            monkeypatch.setattr(exchange, "_joined", read)
            size = exchange.COUNTED.itemsize if rank is exchange.count_owners else 8
            split = lambda x, size=size: sorted(x[i : i + size] for i in range(0, len(x), size))
            assert {k: split(v) for k, v in got.items() if v} == {k: split(v) for k, v in want.items() if v}
            assert max(sizes) <= 2 * 1200 + 120  # twice the other names, and the flush that passed the bound


@pytest.mark.parametrize("held", [1, 500])
def test_settling_on_the_way_finds_the_same(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(exchange, "HELD", held)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == brute_components(rows)
    got = {r.doc_id: bytes(r.kept) for r in deduplicated(docs).collect()}
    monkeypatch.undo()
    assert got == {r.doc_id: bytes(r.kept) for r in deduplicated(docs).collect()}
