"""Landed files, each content taken in once: a stream of files with a persisted manifest of their digests.

The stream's checkpoint keeps which paths were seen, so a run over the same folder opens nothing; the manifest keeps
which contents were, so a file that lands again under another name is not parsed again. Files that are not admitted
are in the manifest too, with what is wrong, and are left alone from then on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .documents import MAGIC, MAX_BYTES, MIN_BYTES, admitted
from .snapshots import Log

FILES = "path string, modificationTime timestamp, length long, content binary"
#: The manifest's key and what tells the last row of one.
KEYS, ORDER = ("sha256",), ("batch",)
#: The digest of a file that was too large to be opened: its path and length stand for it.
UNOPENED = "unopened:"


def manifest(spark: SparkSession, path: str) -> Log:
    """The log of (sha256, path, length, problem, batch): the first file of each content."""
    return Log(spark, path, KEYS, ORDER)


def take_in(spark: SparkSession, landing: str, path: str, parse: Callable[[DataFrame], DataFrame], table: Log, pattern: str = "*", files_a_batch: int = 100, least: int = MIN_BYTES, most: int = MAX_BYTES, magic: bytes = MAGIC) -> StreamingQuery:
    """Take in what is new in the folder `landing`: parse(files) of admitted files with contents that the manifest lacks
    goes into `table`, and then the files into the manifest. files: (path, length, content, sha256), one a content.

    path: a folder for the manifest and the stream's state. A batch that is repeated after a failure changes nothing,
    wherever it failed: the table and the manifest know the last batch they took. A file under a name that landed
    before is not looked at again, so every delivery needs a name of its own.
    """
    known = manifest(spark, f"{path}/manifest")

    def batch(files: DataFrame, number: int) -> None:
        small = files.withColumn("content", F.when(F.col("length") <= most, F.col("content")))
        judged = admitted(small, least, most, magic)
        name = F.coalesce("sha256", F.concat(F.lit(UNOPENED), "path", F.lit(":"), F.col("length").cast("string")))
        first = judged.withColumn("sha256", name).groupBy("sha256").agg(F.min(F.struct("path", "length", "problem")).alias("f")).select("sha256", "f.*")
        had = known.read()
        new = first if had is None else first.join(had.select("sha256"), "sha256", "left_anti")
        rows = [tuple(r) for r in new.select("sha256", "path", "length", "problem").collect()]  # one a file: at most files_a_batch
        if not rows:
            return
        listed = files.sparkSession.createDataFrame([(*r, number) for r in rows], "sha256 string, path string, length long, problem string, batch long")
        good = listed.where("problem IS NULL").select("path", "sha256")
        table.append(parse(files.select("path", "length", "content").join(good, "path")), "landing", number)
        known.append(listed, "landing", number)

    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
