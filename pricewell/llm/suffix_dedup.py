"""Removal of byte strings that an earlier document holds, by winnowed hash names in two rounds.

Names of 2, 4, 8, 16 and 32 bytes come from pairs of names at offsets 1, 2, 4, 8 and 16. A suffix array of every
position would sort as many rows as there are bytes, at each offset; so the positions are thinned first:
of the 32-byte names within each 50-byte string the least stands for it, the same in each document. A
maximal run of strings that it stands for is a segment. Pairs (32-byte name, name of the segment) are dealt
to tasks by the exchange, and numpy sorts and groups them inside mapInArrow: names that one document alone
has are unique and leave; a segment that an earlier document has too is a repeat; the segments still open
go on to offset 50, where the pairs (32-byte name, 50-byte name) of each of their positions are sorted the
same way. This replaces the plain method, in which Spark sorts pairs of position and rank at growing
offsets and ranks them again: names are hashes, no rank is carried on, and there is no Spark sort.
The result is that of the full array, since equal 50-byte strings have equal names at every step.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import checkpointed, lean, place_names, shuffle_partitions, text_slices, whole_ids
from .word_hash import BYTE, STEP, joined, mixed

LENGTH, FIRST = 50, 32
#: Bytes of a name that are sent.
WIDTH = 5
LAST = (1 << 63) - 1
_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
_OFFSET_STEPS = tuple(np.uint64(x) for x in np.random.default_rng(5).integers(0, 1 << 62, 5) * 2 + 1)


def _power_list(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {int(x): _power_list(x, 1 << 20) for x in (STEP, _BACK)}


def _powers(step: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those of a very long text are made for it alone."""
    return _POWERS[int(step)][:n] if n <= 1 << 20 else _power_list(step, n)


class Names:
    """Names of the strings of some documents. Document d has the bytes bounds[d] : bounds[d + 1] - 1."""

    def __init__(self, parts: list[bytes], length: int = LENGTH):
        self.length = length
        self.data, self.bounds = joined(parts)
        n = len(self.data)
        value = BYTE[self.data]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value * _powers(STEP, n))])
        self.first = FIRST if length >= FIRST else 1 << (length.bit_length() - 1)
        width = length - self.first + 1  # names in a string
        strings = n - length + 1
        if strings < 1:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.name = np.zeros(0, np.uint64)
            return
        name, offset = value, 1
        for step in _OFFSET_STEPS[: self.first.bit_length() - 1]:  # prefix doubling: 1 -> 2 -> 4 -> ... -> FIRST bytes
            name = name[:-offset] * step + name[offset:]
            offset *= 2
        name = mixed(name)
        least, have = name, 1
        while have < width:
            more = min(have, width - have)
            least = np.minimum(least[:-more], least[more:])
            have += more
        least = least[:strings]
        size = np.diff(self.bounds) - 1
        docs = np.flatnonzero(size >= length)
        inside = np.zeros(strings + 1, np.int8)
        inside[self.bounds[docs]] += 1
        inside[self.bounds[docs] + size[docs] - length + 1] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        change = np.ones(strings, bool)
        change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        after = np.ones(strings, bool)
        after[:-1] = change[1:] | ~inside[1:]
        #: segment k: the strings that start at start[k] .. end[k] - 1
        self.start, self.end = np.flatnonzero(inside & change), np.flatnonzero(inside & after) + 1
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        self.name = mixed(least[self.start] + np.uint64(1))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A name of each string data[start:end]."""
        return mixed((self.sums[end] - self.sums[start]) * _powers(_BACK, len(self.data))[start] + (end - start).astype(np.uint64))

    def segments(self) -> np.ndarray:
        return self.span(self.start, self.end + self.length - 1)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _of_doc(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """One value for each (document of a slice, name)."""
    return mixed(name + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _found(replies: list[list[bytes]]) -> np.ndarray:
    """The values of _of_doc of the names that each document of a slice got back."""
    names = [np.frombuffer(b"".join(r), "<u8") for r in replies]
    doc = np.repeat(np.arange(len(names)), [len(x) for x in names])
    return _of_doc(doc, np.concatenate([*names, np.zeros(0, np.uint64)]))


#: A removed range, and a check of the text it belongs to: rows of one id may hold different texts.
RANGE = np.dtype([("start", "<i4"), ("end", "<i4"), ("text", "<u4")])


def with_repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """docs, whose columns must not be named so, with _owner, _names, _ranges: by document the bytes of text_col (UTF-8) that lie in a string of
    `length` bytes that also starts in a document with a smaller id, as names of strings and packed ranges.

    Both joins take the same columns of docs, so that Spark shuffles the texts once."""
    whole_ids(docs, id_col)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    # a window of 19 names holds two chosen ones on average, so about a tenth of the bytes start a segment
    buckets = exchange.buckets_for(size // 10, shuffle_partitions(docs.sparkSession))
    columns, at_text, at_owner = docs.columns, docs.columns.index(text_col), len(docs.columns)
    rows = docs.withColumn("_owner", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))

    def name_segments(batches):
        out = exchange.Flushed(buckets, WIDTH, with_b=True)
        for batch in text_slices(batches):
            names = Names(_bytes(batch.column(0)), length)
            yield from out.add(names.name, names.segments(), batch.column(1).to_numpy()[names.doc])
        yield from out.flush()

    def name_strings(batches):
        """The strings of the open segments; what the first step has found goes on as it is."""
        out = exchange.Flushed(buckets, WIDTH, with_b=True)
        for batch in text_slices(batches, at_text):
            texts, ids = _bytes(batch.column(at_text)), batch.column(at_owner).to_numpy()
            names = Names(texts, length)
            if not len(names.start):
                continue
            check = np.array([zlib.crc32(x) for x in texts], np.int64)
            have = _of_doc(names.doc, exchange.both_names(names.name, names.segments(), WIDTH))
            gone, still = (np.isin(have, _found(batch.column(at_owner + c).to_pylist())) for c in (1, 2))
            still &= ~gone
            at, doc = names.bounds[:-1], names.doc
            ranges = np.zeros(int(gone.sum()), RANGE)
            ranges["start"], ranges["end"], ranges["text"] = (names.start - at[doc])[gone], (names.end + length - 1 - at[doc])[gone], check[doc[gone]]
            yield from map(out._passed, exchange.replies(ids[doc[gone]], ranges, np.ones(len(ranges), bool), buckets))
            doc, string, name, other = _strings(names, still)
            yield from out.add(name, other, ids[doc])
        yield from out.flush()

    one = lambda c, name: F.array(c).alias(name)  # noqa: E731  at most the names of one document
    first = checkpointed(exchange.exchanged(rows.select(text_col, "_owner").mapInArrow(lean(name_segments), exchange.PACKED), buckets, WIDTH, exchange.rank_first))
    first = first.select(F.col("owner").alias("_owner"), one("taken", "_taken"), one("open", "_open"))
    touched = rows.join(first, "_owner").select(*columns, "_owner", "_taken", "_open")
    second = exchange.exchanged(touched.mapInArrow(lean(name_strings), exchange.PACKED), buckets, WIDTH, exchange.rank_taken)
    second = second.select(F.col("owner").alias("_owner"), one("taken", "_names"), one("open", "_ranges"))
    return rows.join(second, "_owner", "left").select(*columns, "_owner", "_names", "_ranges")


def _strings(names: Names, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of the segments marked: document, start, and two names that tell them from all others."""
    size = (names.end - names.start)[segments]
    string = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(names.start[segments], size)
    other = names.span(string, string + names.length)
    return np.repeat(names.doc[segments], size), string, mixed(np.repeat(names.name[segments], size) + other * STEP), other


def _spans(texts: list[bytes], told: list, ranges: list, length: int) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each text."""
    part = [x if t or r else b"" for x, t, r in zip(texts, told, ranges, strict=True)]
    names = Names(part, length)
    step = np.zeros(len(names.data) + 1, np.int32)
    if len(names.start):
        doc, string, name, other = _strings(names, np.array([bool(t and t[0]) for t in told])[names.doc])
        gone = np.isin(_of_doc(doc, exchange.both_names(name, other, WIDTH)), _found([t or [] for t in told]))
        np.add.at(step, string[gone], 1)
        np.add.at(step, string[gone] + length, -1)
    for k, (x, r) in enumerate(zip(part, ranges, strict=True)):
        found = np.frombuffer(b"".join(r or []), RANGE)
        found = found[found["text"] == zlib.crc32(x)]
        np.add.at(step, names.bounds[k] + found["start"], 1)
        np.add.at(step, names.bounds[k] + found["end"], -1)
    covered = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    begin, end = edges[::2], edges[1::2]
    where = np.searchsorted(names.bounds, begin, "right") - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in part]
    for k, a, b in zip(where.tolist(), begin.tolist(), end.tolist(), strict=True):
        runs[k].append((a - int(names.bounds[k]), b - int(names.bounds[k])))
    return runs


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, kept (binary: the bytes that stay), spans (removed runs: start, end in bytes).

    Bytes go that lie in a string of `length` bytes that also starts in a document with a smaller id; strings
    are judged on the input. Null, empty and short texts lose nothing. Rows whose id is null come after all
    others; rows of one id, equal or not, aren't earlier than each other. Ids must be whole numbers, else
    TypeError. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for part in text_slices(batches, 1):
            texts = _bytes(part.column(1))
            spans = _spans(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), length)
            kept = [_without(t, s) for t, s in zip(texts, spans, strict=True)]
            as_spans = [[{"start": x, "end": y} for x, y in s] for s in spans]
            yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(as_spans, span_type)], names=[id_col, "n_bytes", "kept", "spans"])

    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    rows = with_repeats(plain, length, id_col, "text").select(id_col, "text", "_names", "_ranges")
    return rows.mapInArrow(lean(cut), f"`{id_col}` {kind}, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join(out) + text[at:]


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut from text_col; a character of which bytes are cut goes whole. Null texts
    stay null; other columns stay as they are, whatever their names."""
    columns = place_names(docs.columns)
    plain = docs.toDF(*columns)
    id_at, at = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = with_repeats(plain, length, columns[id_at], columns[at]).select(*columns, "_names", "_ranges")

    def cut(batches):
        for b in text_slices(batches, at):
            texts = _bytes(b.column(at))
            spans = _spans(texts, b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist(), length)
            null = b.column(at).is_null().to_pylist()
            new = [None if z else _without(t, s).decode("utf-8", "ignore") for z, t, s in zip(null, texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(columns)])], names=columns)

    return rows.mapInArrow(lean(cut), plain.schema).toDF(*docs.columns)
