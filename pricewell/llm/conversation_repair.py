"""Repair of damaged conversations with a generalised LR parser of their roles.

Spark brings the rows of each conversation together in order, as a sorted stream. A task reads it row by row and
holds one front of stacks (see role_grammar): what all stacks of the front have in common behind them is decided
and leaves at once, so a conversation of any length passes without being gathered. Whether a row repeats an
earlier one is found before, by a shuffle of digests without texts; such rows are marked by slim rows that sort
before them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, text_slices
from .role_grammar import Costs, Repair, Row

BLANK, STOP = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
NAMES = {"u": "user", "a": "assistant"}
#: Kinds of rows in the stream, in the order in which they are read at one place: that its text repeats an earlier
#: one, a turn itself, and that the conversation exists.
REPEATS, TURN, EXISTS = 0, 1, 2
#: Undecided rows, and characters in them, after which the decided ones are looked for.
PENDING, PENDING_CHARS = 64, 1 << 20
REPORT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id {kind}, place long, edit string, turn {turn}, role string, text string"


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): each row once, with the damage that the CRC-32 of `conv_id:turn` modulo 20
    names: 0 drops it (times is 0), 1 empties the text, 2 removes its `[.!?]`, 3 repeats it (times is 2), 4 makes
    it the user's. Nulls are one space in the key, the role and the text. Other columns are not read.
    """
    c = lambda name: F.col(f"`{name}`")
    key = F.concat(F.coalesce(c(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c(turn_col).cast("string"), F.lit(" ")))
    harm = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(c(role_col).cast("string"), F.lit(" ")), F.coalesce(c(text_col).cast("string"), F.lit(" "))
    return conversations.select(
        c(conv_col).alias("conv_id"),
        c(turn_col).alias("turn"),
        F.when(harm == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(harm == 1, F.lit("")).when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("times"),
    )


def _name() -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))


def stream(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, name, kind, times, role, text, blank, stopped), each conversation whole in one partition and in
    order: by turn, nulls first, then by the digest of role and text."""
    named = rows.withColumn("name", _name())
    there = named.where("times > 0").withColumn("kind", F.lit(TURN))
    gone = named.where("times = 0").select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(b"").alias("name"), F.lit(EXISTS).alias("kind"), F.lit(0).alias("times"), F.lit("").alias("role"), F.lit("").alias("text"))
    # turns whose role and text stood in an earlier turn: rows of one turn are added up before they are sent
    by_name = Window.partitionBy("conv_id", "name").orderBy(F.asc_nulls_first("turn"))
    later = there.groupBy("conv_id", "name", "turn").agg(F.count("*").alias("times")).withColumn("k", F.row_number().over(by_name)).where("k > 1")
    marks = later.select("conv_id", "turn", "name", F.lit(REPEATS).alias("kind"), F.lit(0).alias("times"), F.lit("").alias("role"), F.lit("").alias("text"))
    cols = ["conv_id", "turn", "name", "kind", "times", "role", "text"]
    out = there.select(*cols).unionByName(marks).unionByName(gone)
    return (
        out.select(*cols, ~F.col("text").rlike(BLANK), F.col("text").rlike(STOP))
        .toDF(*cols, "blank", "stopped")
        .repartition(shuffle_partitions(rows.sparkSession), "conv_id")
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "name", "kind")
    )


class Conversation:
    """The turns of one conversation as they come; decided ones are given to `put(edit, turn, role, text)`."""

    def __init__(self, repair: Repair, put):
        self.repair, self.put = repair, put
        self.front, self.cost = repair.start, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_initial: str | None = None
        self.least_turn = self.most_turn = self.last_turn = None
        self.turns = 0
        self.pending: list[tuple] = []
        self.chars, self.look = 0, PENDING

    def add(self, turn, role: str, text: str, blank: bool, stopped: bool, repeats: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.most_turn = self.last_turn = turn
            self.turns += 1
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        short = not (blank or repeats or stopped)
        self.blank += blank
        self.duplicate += repeats and not blank
        self.truncated += short
        symbol = initial if initial in ("s", "u", "a") else ""
        self.front, rise, steps = self.repair.step(self.front, Row(symbol, blank or repeats, short))
        self.cost += rise
        self.pending.append((steps, turn, role, text if not (blank or repeats) else ""))
        self.chars += len(text)
        if len(self.pending) >= self.look or self.chars >= PENDING_CHARS and len(self.pending) > 1:
            self._decide()

    def _decide(self) -> None:
        """Give away the rows up to the last at which all stacks have one behind them."""
        alive, k = set(range(len(self.front))), len(self.pending)
        while k and len(alive) > 1:
            k -= 1
            alive = {self.pending[k][0][x].parent for x in alive}
        self._give(k, next(iter(alive)))
        self.look = max(PENDING, 2 * len(self.pending))
        self.chars = sum(len(p[3]) for p in self.pending) if self.look == PENDING else 0

    def _give(self, k: int, slot: int) -> None:
        """The first k pending rows, by the way that leads to this stack after them."""
        way = []
        for steps, turn, role, text in reversed(self.pending[:k]):
            step = steps[slot]
            slot = step.parent
            way.append((step, turn, role, text))
        del self.pending[:k]
        if k and self.pending:  # what is left starts from the one stack that was decided
            steps, *rest = self.pending[0]
            self.pending[0] = ([s._replace(parent=0) for s in steps], *rest)
        for step, turn, role, text in reversed(way):
            for symbol in step.inserted:
                self.put("I", None, NAMES[symbol], "")
            self.put(step.edit, turn, NAMES[step.symbol] if step.edit == "R" else role, text)

    def end(self) -> None:
        more, slot, inserted = self.repair.end(self.front)
        self.cost += more
        self._give(len(self.pending), slot)
        for symbol in inserted:
            self.put("I", None, NAMES[symbol], "")

    @property
    def gaps(self) -> int:
        return 0 if self.least_turn is None else int(self.most_turn) - int(self.least_turn) + 1 - self.turns


def _conversations(batches, repair: Repair, put_for):
    """(conversation id, Conversation at its end, what put_for gave) of each in the sorted stream; None after each
    batch, when what was put can be sent."""
    conv, marked, last = None, None, None
    key = object()
    for b in text_slices(batches, 6):
        ids, turns, names, kinds, times, roles, texts, blanks, stops = (c.to_pylist() for c in b.columns)
        for i, kind in enumerate(kinds):
            if ids[i] != key or conv is None:
                if conv is not None:
                    conv.end()
                    yield key, conv, put
                key, put = ids[i], put_for(ids[i])
                conv, marked, last = Conversation(repair, put), None, None
            here = (turns[i], names[i])
            if kind == REPEATS:
                marked = here
            elif kind == TURN:
                for _ in range(times[i]):
                    conv.add(turns[i], roles[i], texts[i], blanks[i], stops[i], here in (marked, last))
                    last = here
        yield None
    if conv is not None:
        conv.end()
        yield key, conv, put


class _Digest:
    """The edits of a conversation and the digest of its repaired turns."""

    def __init__(self, _):
        self.edits, self.sha, self.some = bytearray(), hashlib.sha256(), False

    def __call__(self, edit, turn, role, text):
        self.edits += edit.encode()
        if edit != "D":
            self.sha.update((b"\n" if self.some else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.some = True


def repair_report(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of a table (conv_id, turn, role, text, times), such as damaged() gives: what was wrong
    with it, the least cost of repair, the edits (audit) and the SHA-256 of the repaired `role:text` lines.

    A row is blank without a character other than ASCII white space, else duplicate if role and text stood before
    it, else truncated if its last such character is none of `.!?`. Turns are read in order, nulls first; rows of
    one turn by a digest of role and text. gaps counts turns missing between the least and the greatest. A role
    that starts with none of s, u and a, or is empty, fits nowhere. A conversation of which no row is left: zeros,
    an empty audit, the digest of nothing. Null conversation ids are one conversation. No rows: no rows.
    Roles and texts must not be null, and times of 0 marks a row that is gone.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    @lean
    def run(batches):
        repair, out = Repair(costs=costs), []
        for done in _conversations(batches, repair, _Digest):
            if done is not None:
                key, c, put = done
                out.append((key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, put.edits.decode(), put.sha.hexdigest()))
            elif out:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    given = REPORT.format(kind=kind)
    schema = _names_of(given)
    return stream(rows).mapInArrow(run, given)


def repaired_turns(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The turns of the repaired conversations, from a table as repair_report() takes it: conv_id, place (from 0), edit
    (K kept, R with another role, I inserted), turn (null if inserted), role, text. Inserted ones have empty texts.
    A conversation with no turns left has no rows here."""
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    given = TURNS.format(kind=kind, turn=turn)
    schema = _names_of(given)

    @lean
    def run(batches):
        repair, out = Repair(costs=costs), []

        def put_for(key):
            place = iter(range(1 << 62))

            def put(edit, turn, role, text):
                if edit != "D":
                    out.append((key, next(place), edit, turn, role, text))

            return put

        for done in _conversations(batches, repair, put_for):
            if done is None and out:
                yield _batch(out, schema)
                out.clear()
        if out:
            yield _batch(out, schema)

    return stream(rows).mapInArrow(run, given)


def _names_of(given: str) -> list[tuple]:
    types = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    return [(part.split()[0], types.get(part.split()[1])) for part in given.split(", ")]


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])
