"""Token counts, byte-level BPE and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewell.llm import byte_bpe as B
from pricewell.llm import packing as K
from pricewell.llm import token_counts as C
from pricewell.llm.common import tokenizer_path
from pricewell.llm.prefix_bpe import PrefixBpe
from pricewell.llm.queries import op2_token_counts, op5_byte_bpe, op8_packing

TEXTS = ["", " ", "  two  spaces ", "a\nb\n\n c", "Hello, world! 12,345.6", "é ñ ß ﬁ", "日本語 テキスト", "a\tb  \r\n c", "▁x ▁▁y", "don't we'll 'tis", "x" * 300, "word " * 200, "<|endoftext|> <s> <unk>", "hello <|endoftext|> world", "<|startoftext|>x", "hello<|endoftext|>", "a<|endoftext|>,<|startoftext|>!", "<|EndOfText|> <|endoftext|", "<|endof\ntext|>", "\x00\x01 z", "🙂🙃 ok", "ΣΑΣ Σ. ΟΔΟΣ", "w*** x&&& y$$$", "  　 y", "end. \n \n"]
ROWS = [(i, t, f"s{i}", "clash") for i, t in enumerate(TEXTS)] + [(90, None, "s", "clash"), (91, "same", "s", "c"), (91, "same", "s", "c"), (None, "null id", "s", "c")]


@pytest.fixture(scope="module")
def spm():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(C.MODEL))


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=B.default_pattern(), mergeable_ranks=B.read_ranks(tokenizer_path(B.RANKS)), special_tokens={})


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(K.VOCABULARY))


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like the outputs must not disturb them
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string, start string")


def test_prefix_counts_equal_library_at_every_prefix(spm):
    table = C.shared_table(tokenizer_path(C.MODEL))
    for t in TEXTS:
        counts = table.prefix_counts(t)
        assert counts == [len(spm.encode(t[:k])) for k in range(len(t) + 1)]
        for budget in (0, 1, 5, 50):
            assert table.longest_prefix(t, budget) == max(k for k, n in enumerate(counts) if n <= budget)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(spm, text):
    assert C.shared_table(tokenizer_path(C.MODEL)).count(text) == len(spm.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(tik, text):
    coder = B.shared_coder(tokenizer_path(B.RANKS), B.default_pattern())
    ids = coder.encode(text)
    assert ids == tik.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word,", " ", "'s", "café", "e\u0301", "ΑΣ", "12", "straße", "ñandú", "ǅ", "ß,", "éa", "a\u0308b"]))).map("".join))
def test_word_ids_of_any_text(hf, text):
    words = K.shared_words(tokenizer_path(K.VOCABULARY))
    assert np.frombuffer(words.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids


def test_word_ids_with_and_without_room(hf):
    for cap in (0, 5, 10_000):
        words = K.WordIds(tokenizer_path(K.VOCABULARY), cap)
        for _ in range(2):
            got = [words.encode(t) for t in [*TEXTS, None]]
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [hf.encode(t, add_special_tokens=False).ids for t in [*TEXTS, ""]]
        assert len(words) <= max(cap, 1)


def test_appends_and_edits_keep_the_table():
    bpe = PrefixBpe({b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"abab": 4, b"aa": 5, b"bb": 6, b"abb": 7})
    rng = random.Random(3)
    word = B.Editable(bpe, b"abba")
    for _ in range(300):
        n = len(word.data)
        i = rng.randrange(n + 1)
        j = min(n, i + rng.randrange(4))
        word.replace(i, j, bytes(rng.choice(b"ab") for _ in range(rng.randrange(5))))
        word.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(3))))
        assert word.last == bpe.last_lengths(word.data)
        assert word.tokens() == bpe.merged(word.data)


def test_token_counts_of_a_table(spark, docs, spm):
    got = C.token_counts(docs, budget=20).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()), n := len(spm.encode(t or "")), n > 20) for i, t, *_ in ROWS)
    assert C.token_counts(docs.limit(0)).count() == 0
    cut = {r.doc_id: r.text for r in C.truncated(docs.where("doc_id < 91"), 5).collect()}
    assert cut[90] is None and all(len(spm.encode(t)) <= 5 for t in cut.values() if t)


def test_byte_bpe_of_a_table(spark, docs, tik):
    for r in B.byte_bpe(docs.where("doc_id < 91")).collect():
        t = dict((i, t) for i, t, *_ in ROWS)[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == tik.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    assert B.byte_bpe(docs).count() == len(ROWS)
    assert B.byte_bpe(docs.limit(0)).count() == 0


def _check_packing(rows, want):
    """rows: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); want: doc_id -> ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for k, ids in want.items():
        pieces = sorted(by_doc[k])
        assert b"".join(p[2] for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
        assert all(p[3] == len(ids) and 4 * p[1] == len(p[2]) for p in pieces)
    sizes = []
    for pieces in by_sequence.values():
        pieces.sort()
        assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
        sizes.append(sum(p[1] for p in pieces))
        assert sizes[-1] == K.CAPACITY or sizes[-1] & (sizes[-1] - 1) == 0
    return sizes


def test_packing_of_a_table(spark, docs, hf):
    rows = docs.where("doc_id < 91").union(spark.createDataFrame([(200, "long text " * 9000, "", "")], docs.schema))
    want = {r.doc_id: hf.encode(r.text or "", add_special_tokens=False).ids + [K.END_ID] for r in rows.collect()}
    _check_packing(K.packed(rows).collect(), want)
    assert K.packed(docs.limit(0)).count() == 0
    assert sum(r.length for r in K.packed(docs).collect()) == sum(len(hf.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)


def test_packer_chooses_the_least_sum_of_squares():
    rng, capacity = random.Random(1), 16
    p = K.Packer(capacity, most_open=10**9)
    for _ in range(400):
        size = rng.randrange(1, capacity)
        n = p.count.copy()

        def after(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < capacity:
                m[h + size] += 1
            return int((m[1:capacity] ** 2).sum())

        open_levels = [0] + [h for h in range(1, capacity - size + 1) if n[h]]
        best = min(open_levels, key=lambda h: (after(h), -h))
        assert p.level(size) == best
        p.add((0, 0, b"\0" * 4 * size, size), size)


def test_packer_cuts_what_stays_open():
    p = K.Packer(64, most_open=5)
    windows = []
    for k in range(60):
        windows += p.add((k, 0, bytes(4 * 40), 40), 40)
    windows += p.joined(True)
    sizes = [sum(len(x[2]) // 4 for x in w) for w in windows]
    assert sum(sizes) == 2400 and all(s == 64 or s & (s - 1) == 0 for s in sizes)


def test_queries_against_the_libraries(spark, sf_dir, spm, tik, hf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op2_token_counts(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), n := len(spm.encode(texts[r.doc_id]))) and r.over_limit == (n > 4096)
    for r in op5_byte_bpe(spark, sf_dir).collect():
        ids = np.array(tik.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    rows = op8_packing(spark, sf_dir).collect()
    ids = {k: np.array(hf.encode(t, add_special_tokens=False).ids + [2], "<u4") for k, t in texts.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
