"""A table of observations as a log of snapshots.

A snapshot is a numbered entry in the folder `log`: the data folders that make up the table as of then, the last
compaction first. A writer puts its data into a folder of its own and then takes the next number by moving its
entry there, which fails if another has it; it then takes up what the other did and tries the next. Readers take
one entry, so they see whole snapshots, and keep the one they took: data goes only when no snapshot that is kept
names it. A pointer file says where to look first, so no reader lists the log.

Entries are moved by Hadoop's FileContext, whose renaming without overwriting is one step on HDFS; on a store where
it is not, one writer at a time must be seen to. A row with `removed` true takes its key out of the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS = ("material_id", "period")
#: Parts that the rows of a folder are dealt over by a hash of the series, so that a reader of few series opens few.
BUCKETS = 16
#: Data folders after which append() compacts by itself.
MOST_FOLDERS = 24


class Conflict(RuntimeError):
    """Another writer changed what this one had read."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    #: Names of data folders, in the order of their commits.
    folders: tuple[str, ...] = ()
    #: What the commit did: append, replace or compact.
    action: str = "append"
    at: str = ""
    #: Streams and the last batch of each that is in the table.
    batches: dict[str, int] = field(default_factory=dict)


class Log:
    """The snapshots of the table in a folder."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("loaded_at", "value"), buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    # files

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        where, files = self._file(name)
        if not files.exists(where):
            return None
        stream = files.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> bool:
        """False if the file exists and must not be overwritten. The file is filled under another name first, so that
        nobody sees it in part."""
        jvm, (where, files), (made, _) = self.spark._jvm, self._file(name), self._file(f"log/{uuid.uuid4().hex}.tmp")
        stream = files.create(made, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, int(overwrite))
        if overwrite:
            how[0] = kinds.OVERWRITE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, where, how)
        except Exception:
            files.delete(made, False)
            if not overwrite and files.exists(where):
                return False
            raise
        return True

    def _entry(self, number: int) -> Snapshot | None:
        text = self._text(f"log/{number:010d}.json")
        if text is None:
            return None
        got = json.loads(text)
        return Snapshot(got["number"], tuple(got["folders"]), got["action"], got["at"], got["batches"])

    def last(self) -> Snapshot:
        """The last snapshot; one with number 0 and no data before the first commit."""
        number = int(self._text("log/pointer") or 0)
        found = self._entry(number) or Snapshot(0)
        while (later := self._entry(found.number + 1)) is not None:  # the pointer may be behind by what was just committed
            found = later
        return found

    def snapshot(self, number: int) -> Snapshot:
        found = self._entry(number)
        if found is None:
            raise LookupError(f"no snapshot {number}: never made, or expired")
        return found

    def snapshots(self) -> list[Snapshot]:
        """Those that are kept, oldest first."""
        out, last = [], self.last()
        while last is not None and last.number:
            out.append(last)
            last = self._entry(last.number - 1)
        return out[::-1]

    # commits

    def _commit(self, base: Snapshot, change: Callable[[Snapshot], Snapshot | None], tries: int = 100) -> Snapshot:
        """Take the next number with change(last snapshot); if another was quicker, try again on what it left."""
        for _ in range(tries):
            wanted = change(base)
            if wanted is None:
                return base
            new = replace(wanted, number=base.number + 1, at=datetime.now(UTC).isoformat())
            if self._put(f"log/{new.number:010d}.json", json.dumps(asdict(new)), overwrite=False):
                self._put("log/pointer", str(new.number), overwrite=True)
                return new
            base = self.last()
        raise Conflict("other writers took every number that was tried")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int"))

    def _written(self, rows: DataFrame) -> str:
        """A new data folder with the rows, one part for each bucket that a task has rows of."""
        name = f"data/commit={uuid.uuid4().hex}"
        rows = rows if "removed" in rows.columns else rows.withColumn("removed", F.lit(False))
        self._bucketed(rows).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def append(self, rows: DataFrame, stream: str | None = None, batch: int = 0) -> Snapshot:
        """Add rows; of the rows of one key the last by `order` counts. A batch of a stream that is in the table
        already is left out, so a batch that is repeated after a failure changes nothing."""
        if not self.order or not set(self.order) <= set(rows.columns):
            raise ValueError(f"rows need {self.order or 'an order'} to tell which of one key is the last")
        last = self.last()
        if stream is not None and last.batches.get(stream, -1) >= batch:
            return last
        name = self._written(self._newest(rows))

        def change(now: Snapshot) -> Snapshot | None:
            if stream is not None and now.batches.get(stream, -1) >= batch:
                return None
            return replace(now, folders=(*now.folders, name), action="append", batches=now.batches | ({stream: batch} if stream is not None else {}))

        new = self._commit(last, change)
        return self.compact() if len(new.folders) > MOST_FOLDERS else new

    def replace(self, rows: DataFrame, gate: dict | None = None) -> Snapshot | None:
        """Put rows in the place of the whole table, if the gate lets them through: named conditions that no row may
        meet. Their counts are taken while the rows are written, so rows are made once; if one isn't zero, what was
        written stays out of the log, and there is no new snapshot: None."""
        watch = Observation(uuid.uuid4().hex)
        seen = rows.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in (gate or {}).items()])
        name = self._written(seen)
        if any(watch.get[k] for k in gate or {}):
            self._drop(name)
            return None
        return self._commit(self.last(), lambda now: replace(now, folders=(name,), action="replace"))

    def compact(self) -> Snapshot:
        """Merge all folders into one, in place: readers of older snapshots keep theirs, and what others append
        meanwhile is added after it."""
        base = self.last()
        if len(base.folders) < 2:
            return base
        name = self._written(self._read(base))

        def change(now: Snapshot) -> Snapshot:
            if now.folders[: len(base.folders)] != base.folders:
                self._drop(name)
                raise Conflict("the table was compacted or replaced meanwhile")
            return replace(now, folders=(name, *now.folders[len(base.folders) :]), action="compact")

        return self._commit(base, change)

    def expire(self, keep: int) -> list[str]:
        """Forget all but the last `keep` snapshots, and drop the data that none of those names; gives what was dropped.
        Data of a commit that is under way is named by no snapshot yet and stays."""
        all_ = self.snapshots()
        old, kept = all_[:-keep] if keep else [], all_[-keep:] if keep else all_
        needed = {f for s in kept for f in s.folders}
        gone = sorted({f for s in old for f in s.folders} - needed)
        for s in old:  # the entries first: who still finds one must find its data
            self._drop(f"log/{s.number:010d}.json")
        for f in gone:
            self._drop(f)
        return gone

    def _drop(self, name: str) -> None:
        where, files = self._file(name)
        files.delete(where, True)

    # reads

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The last row of each key."""
        rest = [c for c in rows.columns if c not in (*self.keys, *self.order)]
        last = F.max(F.struct(*self.order, *rest)).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*[c if c in self.keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])

    def read(self, number: int | None = None, series: DataFrame | None = None) -> DataFrame | None:
        """The table as of a snapshot, the last if none is named; None before the first commit.

        series: only the rows of these keys[0]. Their buckets, of which there are few, prune what is opened.
        """
        now = self.last() if number is None else self.snapshot(number)
        return self._read(now, series) if now.folders else None

    def _read(self, now: Snapshot, series: DataFrame | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{f}" for f in now.folders]).drop("commit")
        if series is not None:
            ids = series.select(self.keys[0]).distinct()
            few = [r.bucket for r in self._bucketed(ids).select("bucket").distinct().collect()]  # at most `buckets`
            rows = rows.where(F.col("bucket").isin(few)).join(ids, self.keys[0], "left_semi")
        rows = rows.drop("bucket")
        rows = rows if len(now.folders) == 1 else self._newest(rows)
        return rows.where("NOT removed").drop("removed")


def history_between(log: Log, old: int, new: int) -> DataFrame:
    """(keys, old_value, new_value, change) of the rows that two snapshots differ in: inserted, removed or revised."""
    o, n = (log.read(x).select(*log.keys, F.col("value").alias(name)) for x, name in ((old, "old_value"), (new, "new_value")))
    both = o.withColumn("_o", F.lit(True)).join(n.withColumn("_n", F.lit(True)), list(log.keys), "full")
    change = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "removed").otherwise("revised")
    same = F.col("_o").isNotNull() & F.col("_n").isNotNull() & F.col("old_value").eqNullSafe(F.col("new_value"))
    return both.where(~same).select(*log.keys, "old_value", "new_value", change.alias("change"))
