"""The gates of single series on a stream: each batch gives the violations it brings.

What a series must remember between batches is small: its last period, and two bits a month that say whether the
month was seen once or more often, so the calendar bounds the state. Periods that are no months are remembered as
texts; each of them is a violation, so a clean stream has none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import PERIOD

#: Rows of a stream; ingest_ord orders those of one series, over batches too.
ROWS = "source string, material_id string, period string, value double, ingest_ord double"
VIOLATIONS = "rule_id string, source string, series_id string, n_bad long, sample string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: How a null period is remembered; no text is stored so, since texts start with a letter of their own.
NONE, TEXT = "n", "t"


class SeriesGate(StatefulProcessor):
    """Order, repeated periods, format and values of one series (source, material_id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getValueState("months", "last string, seen binary, often binary")
        self.odd = handle.getMapState("odd", "period string", "often boolean")
        self.period = re.compile(PERIOD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names are Spark's
        last, seen, often = self.months.get() if self.months.exists() else (None, b"", b"")
        seen, often = int.from_bytes(seen, "little"), int.from_bytes(often, "little")
        bad: dict[str, tuple[int, str | None]] = {}

        def add(rule: str, sample: str | None) -> None:
            n, least = bad.get(rule, (0, None))
            bad[rule] = n + 1, sample if least is None else least if sample is None else min(least, sample)

        batch = pd.concat(rows).sort_values("ingest_ord", kind="stable")
        for period, value in zip(batch["period"], batch["value"], strict=True):
            period = period if isinstance(period, str) else None
            if last is not None and period is not None and last > period:
                add("order", period)
            last = period
            if period is not None and self.period.fullmatch(period):
                bit = 1 << (int(period[:4]) * 12 + int(period[5:]) - 1)
                if seen & bit and not often & bit:
                    often |= bit
                    add("duplicate_period", period)
                seen |= bit
            else:
                add("period_format", "null" if period is None else period)
                name = (NONE if period is None else TEXT + period,)
                if self.odd.containsKey(name):
                    if not self.odd.getValue(name)[0]:
                        self.odd.updateValue(name, (True,))
                        add("duplicate_period", period)
                else:
                    self.odd.updateValue(name, (False,))
            if value is None or not (math.isfinite(value) and value > 0):
                add("value", "null" if period is None else period)
        self.months.update((last, _bytes(seen), _bytes(often)))
        if bad:
            yield pd.DataFrame([(rule, key[0], key[1], n, sample) for rule, (n, sample) in bad.items()], columns=["rule_id", "source", "series_id", "n_bad", "sample"])

    def close(self) -> None:
        pass


def _bytes(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def violations(stream: DataFrame) -> DataFrame:
    """The stream of VIOLATIONS of a stream of ROWS. Its session must keep state in STORE."""
    return stream.groupBy("source", "material_id").transformWithStateInPandas(SeriesGate(), VIOLATIONS, "Append", "None")


def run(spark: SparkSession, landing: str, out: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Judge what is new in the parquet files of `landing`, and append its violations to the parquet folder `out`, once
    each: a run that is begun again goes on from the checkpoint. The state's store is set in a session of its own."""
    session = spark.newSession()
    session.conf.set(*STORE)
    stream = session.readStream.schema(ROWS).option("maxFilesPerTrigger", files_a_batch).parquet(landing)
    return violations(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """The violations of all batches together, as the gates give them of a whole table."""
    return spark.read.schema(VIOLATIONS).parquet(out).groupBy("rule_id", "source", "series_id").agg(F.sum("n_bad").alias("n_bad"), F.min("sample").alias("sample"))
