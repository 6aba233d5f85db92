"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType, NullType


def tokenizer_path(name: str) -> str:
    """The installed vocabulary file `name`; any other path can be given to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir. Without one there is an error, since a folder of this machine
    would be missed by executors on others; only a local master, which has no others, falls back to its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pricewell-"))


#: Shuffle files of a query go when it ends.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


#: What Spark hands to Python, and reads from files, at once. Its own bounds are 10,000 and 4,096 rows, which are tens
#: of megabytes of texts: in the JVM's heap, in its own memory and in Python, for each task of an executor.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def small_batches(spark: SparkSession) -> None:
    """Keep BATCHES in this session, but for what its user has set. Plans take them when they run, so they stay."""
    have = spark.conf.getAll
    for k, v in BATCHES.items():
        if k not in have:
            spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: it survives a lost executor, and the
    shuffle files behind it are no longer needed.

    A written table also keeps later plans short: checkpoint() carries the old plan's constraints along,
    and in a loop of joins those grow until planning takes longer than the work.
    """
    ensure_checkpoint_dir(df.sparkSession)
    small_batches(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in CLEANUP}
    try:
        for k in CLEANUP:
            conf.set(k, "true")
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_ids(df: DataFrame, id_col: str) -> None:
    """TypeError before any job starts if the ids are not whole numbers: these operators compare and order ids as such."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{id_col} must be a column of whole numbers, not {kind.simpleString()}")


def text_slices(batches, column: int = 0, most: int = 600_000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so many bytes of text at a time, or one row if that has more."""
    for b in batches:
        c = b.column(column)
        end = np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """A function of mapInArrow that gives freed memory back when its partition ends: Spark keeps idle Python
    workers, and what one stage has used would else stand beside the needs of the next."""

    def trimmed(batches, *args, **more):
        try:
            yield from run(batches, *args, **more)
        finally:
            trim()

    return trimmed


def place_names(columns: list[str]) -> list[str]:
    """Names by place, for operators that keep all columns of a table: with these, columns of the table may have any
    names, those that an operator uses itself and those with dots included; toDF() puts the names back."""
    return [f"c{i}" for i in range(len(columns))]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
