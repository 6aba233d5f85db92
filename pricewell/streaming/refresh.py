"""Incremental refresh of the observation table from landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Log

OBSERVATIONS = "material_id string, period string, value double, loaded_at timestamp"


def latest_version(rows: DataFrame) -> DataFrame:
    """The row loaded last of each (material_id, period); of rows loaded at one time that of the greatest value."""
    last = F.max(F.struct("loaded_at", "value")).alias("v")
    return rows.groupBy("material_id", "period").agg(last).select("material_id", "period", "v.value", "v.loaded_at")


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """The stream of JSON lines in the files of a folder."""
    return spark.readStream.schema(OBSERVATIONS).json(landing)


def log(spark: SparkSession, table: str) -> Log:
    """The snapshots of the table in a folder."""
    return Log(spark, table)


def refresh(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Take what is new in a stream of OBSERVATIONS and upsert it into the table in the folder `table`.

    Each batch appends its own rows, the last of each (material_id, period), as a snapshot, and the log merges its
    folders when they are many. A batch that is repeated after a failure is in the log already and changes nothing.
    """
    spark, name = stream.sparkSession, checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def upsert(batch: DataFrame, number: int) -> None:
        log(spark, table).append(latest_version(batch), name, number)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as of its last snapshot, or None if it has none."""
    return log(spark, table).read()


def compacted(spark: SparkSession, table: str) -> DataFrame | None:
    """current(), after its folders were merged in place."""
    log(spark, table).compact()
    return current(spark, table)


def daily_event_values(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily count and sum of values by event type over a stream or table of events, late rows dropped after `delay`."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
