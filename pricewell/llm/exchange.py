"""Finding names that several owners share, over all data, without a row for each name in Spark.

Owners (documents, or sets) have names: pairs (a, b) of 64-bit values. Each task packs its names by bucket
into a few binary rows, Spark deals the buckets out, and each bucket is sorted and ranked by itself. Every
owner gets back what it shares. A name that very many owners in one task share is hot: it is settled as far
as possible in the task, and what is left is dealt by (a, b), so that no bucket holds all of its owners.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions
from .word_hash import mixed

#: Names kept until they are packed; owners in one task from which a name is hot.
FLUSH, HOT = 750_000, 256
NAMES, REPLY, HOT_NAMES = 0, 1, 2
PACKED = "bucket int, kind int, n int, a binary, b binary, owner binary, owners binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *[(x, pa.binary()) for x in ("a", "b", "owner", "owners")]])
#: Names that a task sorts at once, about: 24 bytes each, and their copies while they are sorted.
NAMES_IN_BUCKET = 1_500_000
#: Names of a bucket that a task holds before it settles those of many owners.
HELD = 2 * NAMES_IN_BUCKET
#: Buckets have a partition each up to so many.
MOST_PARTITIONS = 10_000
#: Replies on their way: those of many owners in a row. to: where the owners' replies meet; sizes in bytes.
SENT = "to int, owners binary, open binary, sizes binary, data binary"
_SENT = pa.schema([("to", pa.int32()), *[(x, pa.binary()) for x in ("owners", "open", "sizes", "data")]])
REPLIES = "owner long, taken binary, open binary"
#: The owner of a marker: it comes before all others and gets no reply.
NOBODY = -(1 << 63)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte: sorted values then compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    width = len(raw) // n
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def low(x: np.ndarray, width: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * width) - 1)


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a >> np.uint64(44)) % np.uint64(buckets)).astype(np.int32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Flushed:
    """A task's names until they are packed. a, b: names; owner: 64-bit.

    The low `width` bytes of a name are kept; with its bucket they tell a from others.
    """

    def __init__(self, buckets: int, width: int, with_b: bool):
        self.buckets, self.width, self.with_b = buckets, width, with_b
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, a, b, owner) -> Iterator[pa.RecordBatch]:
        self.parts.append((a, b, owner))
        self.size += len(a)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        a, b, owner = (np.concatenate([p[k] for p in self.parts]) if k != 1 or self.with_b else None for k in range(3))
        self.parts, self.size = [], 0
        if self.with_b:
            yield from self._first_owners(a, b, owner)
        else:
            yield from self._counted(a, owner)

    def _first_owners(self, a, b, owner):
        b = low(b, self.width)
        a, b, owner = _sorted([a, b, owner])
        starts = _starts(a, b)
        least = np.repeat(owner[starts], np.diff(np.append(starts, len(a))))
        later = owner > least
        yield from self._reply(replies(owner[later], both_names(a[later], b[later], self.width), np.zeros(int(later.sum()), bool), self.buckets))
        a, b, owner = a[starts], b[starts], owner[starts]
        starts = _starts(a)
        size = np.diff(np.append(starts, len(a)))
        hot = np.repeat(size >= HOT, size)
        marks = a[starts[size >= HOT]]
        yield from self._pack(HOT_NAMES, _bucket(a[hot] ^ (b[hot] << np.uint64(20)), self.buckets), a[hot], b[hot], owner[hot])
        a, b, owner = np.concatenate([a[~hot], marks]), np.concatenate([b[~hot], np.zeros_like(marks)]), np.concatenate([owner[~hot], np.full(len(marks), NOBODY)])
        yield from self._pack(NAMES, _bucket(a, self.buckets), a, b, owner)

    def _counted(self, a, owner):
        order = np.lexsort((owner, a))
        a, owner = a[order], owner[order]
        first = _starts(a, owner)
        a, owner = a[first], owner[first]
        starts = _starts(a)
        size = np.diff(np.append(starts, len(a)))
        hot = np.repeat(size >= HOT, size)
        yield from self._reply(replies(owner[hot], counted_names(low(a[hot], self.width), np.full(int(hot.sum()), HOT, np.uint16)), np.ones(int(hot.sum()), bool), self.buckets))
        marks = a[starts[size >= HOT]]
        a, owner = np.concatenate([a[~hot], marks]), np.concatenate([owner[~hot], np.full(len(marks), NOBODY)])
        yield from self._pack(NAMES, _bucket(a, self.buckets), a, None, owner)

    def _reply(self, rows):
        """What the task knows already goes the same way as the buckets' replies."""
        return map(self._passed, rows)

    def _passed(self, r: pa.RecordBatch) -> pa.RecordBatch:
        """Reply rows in the form of packed ones."""
        n = r.num_rows
        number = lambda x: pa.array(np.full(n, x, np.int32))
        return pa.RecordBatch.from_arrays([r.column(0), number(REPLY), number(0), r.column(4), r.column(2), r.column(3), r.column(1)], schema=_PACKED)

    def _pack(self, kind, bucket, a, b, owner):
        order = np.lexsort((low(a, self.width), bucket))
        bucket, a, owner = bucket[order], a[order], owner[order]
        b = None if b is None else b[order]
        cuts = np.append(_starts(bucket), len(bucket))
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            owners, index = np.unique(owner[i:j], return_inverse=True)
            kind_ = "<u2" if len(owners) < 1 << 16 else "<u4"
            rows.append((int(bucket[i]), kind, int(j - i), planes(a[i:j], self.width), planes(b[i:j], self.width) if b is not None else None, index.astype(kind_).tobytes(), owners.astype("<i8").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


COUNTED = np.dtype([("a", "<u8"), ("count", "<u2")])


def both_names(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """One value for the pair of names, by which its owner finds it again."""
    return mixed(low(a, width) * np.uint64(0x9E3779B97F4A7C15) + low(b, width))


def counted_names(a, count) -> np.ndarray:
    out = np.zeros(len(a), COUNTED)
    out["a"], out["count"] = a, count
    return out


def replies(owner: np.ndarray, records: np.ndarray, is_open: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The records of each owner, those that are open apart from the others, in a row for each place they go to."""
    keep = owner != NOBODY
    owner, records, is_open = owner[keep], records[keep], is_open[keep]
    if not len(owner):
        return
    to = (mixed(owner.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    by_place = np.argsort(to, kind="stable")
    cuts = np.append(_starts(to[by_place]), len(to))
    rows = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # one place at a time, so that copies stay small
        at = by_place[x:y]
        at = at[np.lexsort((is_open[at], owner[at]))]
        some, flag = owner[at], is_open[at]
        starts = _starts(some, flag)
        sizes = (np.diff(np.append(starts, len(at))) * records.dtype.itemsize).astype("<u4")
        rows.append((int(to[at[0]]), some[starts].astype("<i8").tobytes(), flag[starts].astype(np.uint8).tobytes(), sizes.tobytes(), records[at].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each owner, with all its replies."""
    owners, flags, data = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            owners.append(np.frombuffer(r["owners"], "<i8"))
            flags.append(np.frombuffer(r["open"], np.uint8))
            ends = np.cumsum(np.frombuffer(r["sizes"], "<u4").astype(np.int64)).tolist()
            data += [r["data"][i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
    if not owners:
        return
    owner, flag = np.concatenate(owners), np.concatenate(flags)
    order = np.lexsort((flag, owner))
    owner, flag = owner[order], flag[order]
    heads = np.append(_starts(owner), len(owner))
    order, flag = order.tolist(), flag.tolist()
    for at in range(0, len(heads) - 1, 5000):
        some = heads[at : at + 5001].tolist()
        taken, opened = [], []
        for i, j in zip(some[:-1], some[1:], strict=True):
            taken.append(b"".join([data[order[k]] for k in range(i, j) if not flag[k]]))
            opened.append(b"".join([data[order[k]] for k in range(i, j) if flag[k]]))
        yield pa.RecordBatch.from_arrays([pa.array(owner[some[:-1]], pa.int64()), pa.array(taken, pa.binary()), pa.array(opened, pa.binary())], names=["owner", "taken", "open"])


def _read(batches: list[pa.RecordBatch], kind: int):
    """The names of this kind, of which the batches are given up as they are read."""
    a, b, owner, rest = [], [], [], []
    while batches:
        batch = batches.pop()
        of_kind = pc.equal(batch.column(1), kind)
        rest.append(batch.filter(pc.invert(of_kind)))
        for r in batch.filter(of_kind).to_pylist():
            table = np.frombuffer(r["owners"], "<i8")
            index = np.frombuffer(r["owner"], "<u2" if len(table) < 1 << 16 else "<u4")
            a.append(unplanes(r["a"], r["n"]))
            owner.append(table[index])
            if r["b"] is not None:
                b.append(unplanes(r["b"], r["n"]))
    batches += [x for x in rest if x.num_rows]
    return _joined(a), _joined(b), _joined(owner)


def _joined(arrays: list[np.ndarray]) -> np.ndarray | None:
    out = np.concatenate(arrays) if arrays else None
    arrays.clear()
    return out


def _sorted(names: list[np.ndarray | None]) -> tuple:
    """Sorted (a, b, owner) of names, which gives them up one by one: few copies stand beside each other."""
    order = np.lexsort([x for x in (names[2], names[1], names[0]) if x is not None])
    for k in range(3):
        names[k] = None if names[k] is None else names[k][order]
    return tuple(names)


def _passed_on(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    own = batch.filter(pc.equal(batch.column(1), REPLY))
    if own.num_rows:
        yield pa.RecordBatch.from_arrays([own.column(k) for k in (0, 6, 4, 5, 3)], schema=_SENT)


def _collected(batches: Iterator[pa.RecordBatch], shrink):
    """The names of a bucket by kind: {kind: (a, b, owner)}. Replies of the tasks pass through.

    A name that many tasks have a few owners of, too few in each to be hot there, comes here with all of them. So
    whenever HELD names have come, those that can be settled are: shrink() gives their replies, and what must stay
    of them, which is a few rows a name. A bucket thus holds its different names, not all their owners.
    """
    waiting: list[pa.RecordBatch] = []
    held: dict[int, tuple] = {}
    n, most = 0, HELD

    def take_in():
        for kind in (NAMES, HOT_NAMES):
            new = _read(waiting, kind)
            if new[0] is not None:
                held[kind] = tuple(None if x is None else np.concatenate([x, y]) for x, y in zip(held[kind], new, strict=True)) if kind in held else new

    for batch in batches:
        yield from _passed_on(batch)
        own = batch.filter(pc.not_equal(batch.column(1), REPLY))
        waiting.append(own)
        n += int(pc.sum(own.column(2)).as_py() or 0)
        if n >= most:
            take_in()
            for kind in held:
                names, held[kind] = list(held[kind]), None
                rows, held[kind] = shrink(names)
                yield from rows
            n = sum(len(x[0]) for x in held.values())
            most = max(HELD, 2 * n)
    take_in()
    return held


def _later(names: list[np.ndarray]) -> tuple[tuple, np.ndarray]:
    """Sorted (a, b, owner) of names, which is emptied, and which rows have an owner before them."""
    a, b, owner = _sorted(names)
    names.clear()
    full = _starts(a, b)
    return (a, b, owner), owner > np.repeat(owner[full], np.diff(np.append(full, len(a))))


def rank_first(batches: Iterator[pa.RecordBatch], width: int, buckets: int, with_open: bool = True) -> Iterator[pa.RecordBatch]:
    """Sort a bucket's (a, b) by owner. taken: names that an owner before has too. open: names that the owner
    is the first to have, while another owner has a name of the same a and another b. Names whose a has one
    owner, or one b, are settled with that; so are those of an a whose first owners are all one, since all others
    of its names are taken."""

    def shrink(names):
        (a, b, owner), later = _later(names)
        told = replies(owner[later], both_names(a[later], b[later], width), np.zeros(int(later.sum()), bool), buckets)
        first = np.zeros(len(a), bool)
        first[_starts(a, b)] = True
        return told, (a[first], b[first], owner[first])

    held = yield from _collected(batches, shrink)
    for kind in sorted(held):
        (a, b, owner), later = _later(list(held.pop(kind)))
        heads = _starts(a)
        size = np.diff(np.append(heads, len(a)))
        two = lambda x: np.minimum.reduceat(x, heads) != np.maximum.reduceat(x, heads)
        several = np.repeat(two(owner) & two(b), size) | (kind == HOT_NAMES)
        told = later | several if with_open else later
        yield from replies(owner[told], both_names(a[told], b[told], width), ~later[told], buckets)


def rank_taken(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """rank_first() without the open names."""
    return rank_first(batches, width, buckets, with_open=False)


def count_owners(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """open: the names that at least two owners have, with the number of owners, HOT standing for that and more."""

    def counted(names):
        a, _, owner = _sorted(names)
        names.clear()
        first = _starts(a, owner)
        a = a[first]
        owner = owner[first]
        del first
        heads = _starts(a)
        size = np.diff(np.append(heads, len(a)))
        return a, owner, heads, np.repeat(np.where(owner[heads] == NOBODY, HOT, np.minimum(size, HOT)), size).astype(np.uint16)

    told = lambda a, owner, count: replies(owner, counted_names(a, count), np.ones(len(a), bool), buckets)

    def shrink(names):
        a, owner, heads, count = counted(names)
        hot = count == HOT
        marks = a[heads[hot[heads]]]
        return told(a[hot], owner[hot], count[hot]), (np.concatenate([a[~hot], marks]), None, np.concatenate([owner[~hot], np.full(len(marks), NOBODY)]))

    held = yield from _collected(batches, shrink)
    if NAMES in held:
        a, owner, _, count = counted(list(held.pop(NAMES)))
        keep = count > 1
        yield from told(a[keep], owner[keep], count[keep])


def one_by_one(rank):
    """rank() on each run of rows with the same first column, so that a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, at = [], None
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = (np.flatnonzero(np.diff(key)) + 1).tolist()
            for i, j in zip([0, *edges], [*edges, len(key)], strict=True):
                if i < j:
                    if waiting and key[i] != at:
                        yield from rank(iter(waiting))
                        waiting = []
                    at = key[i]
                    waiting.append(batch.slice(i, j - i))
        if waiting:
            yield from rank(iter(waiting))

    return lean(run)


def exchanged(packed: DataFrame, buckets: int, width: int, rank) -> DataFrame:
    """Deal the packed rows by bucket and rank each: one row (owner, taken, open) for each owner that shares a
    name. Replies travel packed too, so that rows stay few. A partition may have many buckets; Spark sorts them,
    spilling where it must, and the task then holds one of them at a time."""
    parts = min(buckets, max(MOST_PARTITIONS, shuffle_partitions(packed.sparkSession)))

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartitionById(parts, F.pmod(key, F.lit(parts))).sortWithinPartitions(key)

    sent = dealt(packed, "bucket").mapInArrow(one_by_one(partial(rank, width=width, buckets=buckets)), SENT)
    return dealt(sent, "to").mapInArrow(one_by_one(gathered), REPLIES)


def buckets_for(names: int, least: int) -> int:
    """So many buckets that none of them, which a task sorts at once, holds more than about NAMES_IN_BUCKET names;
    at least one for each shuffle partition, and equally many in each partition where there are more buckets."""
    wanted, most = max(least, -(-names // NAMES_IN_BUCKET)), max(MOST_PARTITIONS, least)
    return wanted if wanted <= most else -(-wanted // most) * most
