"""Toxicity: a convolutional text classifier in numpy, with thresholds by language.

A word's embedding is the sum of two hashed rows, one of the word and one of its first bytes. Filters of
several widths run over the words of the whole text, each is max-pooled, and a logistic unit makes the
score. It is trained on a bounded sample of labelled documents and applied to every document by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, place_names, text_slices, trim
from .word_hash import hashes, joined, words_of

#: Bounds of the sample that training may see: documents of either label, and characters in all.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 3000, 6000, 30_000_000
DECISION = 0.3
#: A cut may reject a share of the clean documents only to find that many times the share of the toxic ones.
ALARM = 3
WIDTHS, FILTERS, DIM, WORD_BITS, HEAD_BITS, HEAD_BYTES = (1, 2, 3), 16, 16, 16, 14, 5
#: Empty rows after each text: windows that begin in it, or just after it, meet no word of the next text.
PAD = max(WIDTHS)
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, head rows, where each text starts): hashed rows of the words of the lower-cased texts.

    Row 0 is padding: each text is followed by as many as its last windows need.
    """
    data, bounds = joined([(x or "").lower().replace("\0", " ").encode("utf-8", "surrogatepass") for x in texts])
    start, end = words_of(data, INSIDE)
    word = (hashes(data, start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    head = (hashes(data, start, end, HEAD_BYTES) >> np.uint64(64 - HEAD_BITS)).astype(np.int64)
    text = np.searchsorted(bounds, start, "right") - 1
    count = np.bincount(text, minlength=len(texts)) + PAD
    heads = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(len(word)) + PAD * text
    rows = np.zeros((2, heads[-1]), np.int32)
    rows[0, at], rows[1, at] = np.maximum(word, 1), np.maximum(head, 1)
    return rows[0], rows[1], heads


@dataclass
class Model:
    word: np.ndarray
    head: np.ndarray
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, word: np.ndarray, head: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Of each text and filter the largest response, over the windows that begin with a word and one of no word."""
        x = self.word[word] + self.head[head]
        x[word == 0] = 0
        n, out = len(x) - PAD, []
        for w in self.filters:
            y = sum(x[j : j + n] @ w[j] for j in range(len(w)))
            out.append(np.maximum.reduceat(y, np.stack([heads[:-1], heads[1:] - PAD + 1], 1).ravel())[::2])
        return np.maximum(np.hstack(out) + self.bias, 0)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return self.logits_of(*features(texts))

    def logits_of(self, word: np.ndarray, head: np.ndarray, heads: np.ndarray, most: int = 150_000) -> np.ndarray:
        """The same from the features of the texts, or of some that lie together among those of others."""
        out, i, n = [], 0, len(heads) - 1
        while i < n:  # some texts at a time, so that memory stays small
            j = max(i + 1, int(np.searchsorted(heads, heads[i] + most, "right")) - 1)
            a, b = heads[i], heads[j]
            out.append(self.pooled(np.append(word[a:b], [0] * PAD), np.append(head[a:b], [0] * PAD), heads[i : j + 1] - a) @ self.out[:-1] + self.out[-1])
            i = j
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.scale * (self.logits(texts) - self.shift) + np.log(DECISION / (1 - DECISION)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(word: np.ndarray, head: np.ndarray, heads: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Model:
    """Adam on the logistic loss, both labels weighing the same; the gradient of a max goes to its window."""
    rng = np.random.default_rng(seed)
    f = FILTERS * len(WIDTHS)
    m = Model(rng.normal(0, 0.1, (1 << WORD_BITS, DIM)).astype(np.float32), rng.normal(0, 0.1, (1 << HEAD_BITS, DIM)).astype(np.float32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(f, np.float32), np.append(rng.normal(0.3, 0.1, f), -1).astype(np.float32))
    params = [m.bias, m.out, *m.filters]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rows_state = [(np.zeros_like(p), np.zeros_like(p)) for p in (m.word, m.head)]
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    step = 0
    for _ in range(epochs):
        for ids in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
            step += 1
            parts = [np.arange(heads[i], heads[i + 1]) for i in ids]
            local = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            at = np.concatenate([*parts, []]).astype(np.int64)
            wi, hi = np.append(word[at], [0] * PAD), np.append(head[at], [0] * PAD)
            x = m.word[wi] + m.head[hi]
            x[wi == 0] = 0
            n = len(at)
            responses, where = [], []
            for w in m.filters:
                y = sum(x[j : j + n] @ w[j] for j in range(len(w)))
                k = np.array([a + y[a : b - PAD + 1].argmax(0) for a, b in zip(local[:-1], local[1:], strict=True)])
                where.append(k)
                responses.append(np.take_along_axis(y, k, 0))
            pre = np.hstack(responses) + m.bias
            h = np.maximum(pre, 0)
            p = sigmoid(h @ m.out[:-1] + m.out[-1])
            g = ((p - label[ids]) * weight[ids] / len(ids)).astype(np.float32)
            gh = np.outer(g, m.out[:-1]) * (pre > 0)
            grads = [gh.sum(0), np.append(h.T @ g, g.sum())]
            gx, touched = [], []
            for v, w in enumerate(m.filters):
                gw = np.zeros_like(w)
                part = gh[:, v * FILTERS : (v + 1) * FILTERS]
                for j in range(len(w)):
                    rows = where[v] + j
                    gw[j] = np.einsum("bfd,bf->df", x[rows], part)
                    gx.append((part[:, :, None] * w[j].T[None]).reshape(-1, DIM))
                    touched.append(rows.ravel())
                grads.append(gw)
            for p_, g_, (a, b) in zip(params, grads, state, strict=True):
                _adam(p_, g_, a, b, rate, step)
            touched, gx = np.concatenate(touched), np.concatenate(gx)
            for table, ids_, (a, b) in zip((m.word, m.head), (wi, hi), rows_state, strict=True):
                rows, inverse = np.unique(ids_[touched], return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, inverse, gx)
                a_, b_, t_ = a[rows], b[rows], table[rows]
                _adam(t_, total, a_, b_, rate, step)
                a[rows], b[rows], table[rows] = a_, b_, t_
    return m


def _adam(p: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, rate: float, step: int) -> None:
    a *= 0.9
    a += 0.1 * g
    b *= 0.99
    b += 0.01 * g * g
    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)


def best_cut(z: np.ndarray, label: np.ndarray) -> float:
    """The cut between two values of z with the least share of toxic documents missed plus ALARM times that of
    clean ones rejected; the middle of the widest such gap."""
    order = np.argsort(z, kind="stable")
    z, label = z[order], label[order]
    if not len(z) or label.min() == label.max():
        return 0.0
    missed = np.cumsum(label) / label.sum()
    alarms = 1 - np.cumsum(1 - label) / (1 - label).sum()
    cost = np.round(missed + ALARM * alarms, 12)[:-1]
    gap = np.where(cost == cost.min(), np.diff(z), -1)
    k = int(gap.argmax())
    return float((z[k] + z[k + 1]) / 2)


def fitting(size: np.ndarray, label: np.ndarray, max_chars: int) -> np.ndarray:
    """Which documents fit into max_chars, in random order: one that doesn't fit is left out and the next is tried.

    Those over a hundredth of max_chars come last, the smallest first, so that none crowds out many. Each
    label is filled up to half of max_chars first, then either.
    """
    order = np.random.default_rng(7).permutation(len(size))
    order = order[np.argsort(np.where(100 * size[order] > max_chars, size[order], 0), kind="stable")]
    taken = np.zeros(len(size), bool)
    for kinds, most in (((1,), max_chars // 2), ((0,), max_chars // 2), ((0, 1), max_chars)):
        of_kind = np.isin(label, kinds)
        used = int(size[taken & of_kind].sum())
        for i in order[of_kind[order] & ~taken[order]]:
            if used + size[i] <= most:
                taken[i] = True
                used += int(size[i])
    return order[taken[order]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Model | None:
    """Train on the labelled documents, at most max_toxic + max_clean of them and max_chars characters.

    Of more labels the sample is by hash of the id, of more characters by fitting(). A fifth of it, which is
    not trained on, sets the cut, and a threshold for each language with 20 labels of either kind; where that
    fifth has fewer than 100 documents, or one label only, the whole sample does, trained on or not. None if the labels are not of both kinds; ValueError if they are,
    but none of one kind fits into max_chars. Labels that are null or
    have no document are not used; an id with both labels counts as toxic.
    """
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    order = (F.xxhash64("id"), F.col("id"))
    ids = label.where("label = 1").orderBy(*order).limit(max_toxic).unionByName(label.where("label = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean rows of two numbers
    texts = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "id"))
    sizes = texts.groupBy("id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.first("label").alias("label")).toArrow().sort_by([("id", "ascending")])
    label_ = sizes["label"].to_numpy()
    order = fitting(sizes["n"].to_numpy(), label_, max_chars)
    if len(np.unique(label_)) < 2:
        return None
    if len(np.unique(label_[order])) < 2:
        raise ValueError(f"no labelled document of one kind fits into max_chars = {max_chars}")
    taken = docs.sparkSession.createDataFrame(pa.table({"id": sizes["id"].take(order)}))
    texts = texts.join(F.broadcast(taken), "id").select("id", "text", "lang", "label")

    def rows(batches):
        for b in text_slices(batches, 1):
            word, head, heads = features(b.column(1).to_pylist())
            cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(heads[:-1], heads[1:], strict=True)], pa.binary())
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), cut(word), cut(head)], names=["id", "lang", "label", "word", "head"])

    kind = texts.schema["id"].dataType.simpleString()
    try:
        return _fitted(texts.mapInArrow(lean(rows), f"id {kind}, lang string, label int, word binary, head binary"))
    finally:
        trim()  # what training has used would else stand in the driver beside the needs of all later steps


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The 32-bit numbers of all rows of a column of bytes, one row after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _fitted(rows: DataFrame) -> Model | None:
    """Train on rows (id, lang, label, word, head). The driver holds their features twice at most, and works out
    the responses to some texts at a time only."""
    sample = rows.toArrow().sort_by([("id", "ascending")])
    label_ = np.array(sample["label"].to_pylist(), np.int64)
    if len(np.unique(label_)) < 2:
        return None
    lang = np.array([x or "" for x in sample["lang"].to_pylist()])
    size = pc.binary_length(sample["word"]).to_numpy() // 4
    words, heads_, at = _flat(sample["word"]), _flat(sample["head"]), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    del sample
    pick = np.random.default_rng(7).permutation(len(size))

    def block(chosen):
        w, h = (np.concatenate([t[at[i] : at[i + 1]] for i in chosen]) for t in (words, heads_))
        return w, h, np.concatenate([[0], np.cumsum(size[chosen])]), label_[chosen]

    test, rest = pick[: len(pick) // 5], pick[len(pick) // 5 :]
    model = train(*block(rest))
    held = test if len(np.unique(label_[test])) > 1 and len(test) >= 100 else pick
    *features_, y = block(held)
    z = model.logits_of(*features_)
    model.shift = best_cut(z, y)
    model.scale = float(2 / max(1e-3, np.std(z)))
    score = sigmoid(model.scale * (z - model.shift) + np.log(DECISION / (1 - DECISION)))
    for name in np.unique(lang[held]):
        own = lang[held] == name
        if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20:
            model.thresholds[str(name)] = best_cut(score[own], y[own])
    return model


def scored(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of docs named in `keep` (all by default), then score and toxic.

    score: 0 to 1, from the text alone. toxic: score at or over the threshold of the row's language, or
    DECISION for languages without one. Null and empty texts are scored as texts without words. Without a
    model every score is 0. Rows with null or repeated ids are scored each. Columns named score or toxic
    in docs are left out, so that these names are this operator's; others may have any names.
    """
    at = [i for i, c in enumerate(docs.columns) if c not in ("score", "toxic") and (keep is None or c in keep)]
    return _scored(docs, model, at, text_col, lang_col).toDF(*[docs.columns[i] for i in at], "score", "toxic")


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that scored() doesn't call toxic, with all columns as they are, whatever their names."""
    found = _scored(docs, model, range(len(docs.columns)), text_col, lang_col)
    return found.where("NOT toxic").drop("score", "toxic").toDF(*docs.columns)


def _scored(docs: DataFrame, model: Model | None, keep, text_col: str, lang_col: str) -> DataFrame:
    """The columns at the places `keep`, named by place, then score and toxic."""
    names = place_names(docs.columns)
    kept, text, lang = [names[i] for i in keep], *(names[docs.columns.index(c)] for c in (text_col, lang_col))
    sent = [*kept, *[c for c in dict.fromkeys((text, lang)) if c not in kept]]  # each column once
    at_text, at_lang = sent.index(text), sent.index(lang)
    plain = docs.toDF(*names)
    schema = plain.select(*kept).schema

    def run(batches):
        for b in text_slices(batches, at_text):
            texts, langs = b.column(at_text).to_pylist(), b.column(at_lang).to_pylist()
            s = model.scores(texts) if model else np.zeros(len(texts))
            cuts = np.array([model.thresholds.get(x, DECISION) if model else DECISION for x in langs])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(s, pa.float64()), pa.array(s >= cuts, pa.bool_())], names=[*kept, "score", "toxic"])

    return plain.select(*sent).mapInArrow(lean(run), schema.add("score", "double").add("toxic", "boolean"))
