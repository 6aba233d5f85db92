"""Signals kept up to date by the changes of a refresh.

The signal of a month needs its twelve months before. A month that is inserted, revised or removed therefore
touches its own signal and those of the twelve months after; of all later ones only the count of months changes,
by as many as were inserted less those removed. So only marked series are read, and of those only the months
around the changes are computed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import Log, history_between
from . import signals

#: Months that a signal needs before its own, and so as many as a change reaches.
REACH = 12


def marked(changes: DataFrame) -> DataFrame:
    """(material_id, low, high, net): the first and last changed month of each series, and by how many months it grew.
    changes: (material_id, period, change), change one of inserted, removed and revised."""
    net = F.sum(F.when(F.col("change") == "inserted", 1).when(F.col("change") == "removed", -1).otherwise(0)).alias("net")
    return changes.groupBy("material_id").agg(F.min("period").alias("low"), F.max("period").alias("high"), net)


def _made(obs: DataFrame, marks: DataFrame, reach: int, t: signals.Thresholds) -> DataFrame:
    """Signals of the months of marked series that the changes reach, from those months and as many before them."""
    by_month, whole = Window.partitionBy("material_id").orderBy("period"), Window.partitionBy("material_id")
    rows = obs.join(marks, "material_id").withColumn("_at", F.row_number().over(by_month))
    before = F.count_if(F.col("period") < F.col("low")).over(whole)
    until = F.count_if(F.col("period") <= F.col("high")).over(whole)
    rows = rows.withColumns({"_before": before, "_until": until}).where((F.col("_at") > F.col("_before") - reach) & (F.col("_at") <= F.col("_until") + reach))
    near = rows.withColumn("_own", F.col("_at") > F.col("_before")).drop("low", "high", "net", "_before", "_until")
    return signals.history(near, 1, t).where("_own").withColumn("n_obs", F.col("_at")).drop("_at", "_own")


def refreshed(before: DataFrame, obs: DataFrame, changes: DataFrame, least: int = 13, t: signals.Thresholds = signals.Thresholds()) -> DataFrame:
    """signals.history(obs, least) from that of the observations before the changes.

    Only marked series of obs are looked at, so a table that can be read by series may bring no others. Rows of
    `before` of other series pass as they are; of marked ones those before the first changed month pass, those
    out of reach of the last pass with their count moved, and those between are made again. (A month out of reach
    has `reach` months between itself and the last change, so it had a signal before.)
    """
    marks, reach = marked(changes), max(REACH, least - 1)
    made = _made(obs, marks, reach, t)
    bounds = marks.join(made.groupBy("material_id").agg(F.max("period").alias("_last")), "material_id", "left")
    kept = before.join(bounds, "material_id", "left")
    far = F.col("period") > F.greatest("high", "_last")
    kept = kept.where(F.col("low").isNull() | (F.col("period") < F.col("low")) | far)
    count = F.col("n_obs") + F.when(far, F.col("net")).otherwise(0)
    kept = kept.withColumn("n_obs", count.cast(before.schema["n_obs"].dataType)).select(*before.columns)
    return kept.unionByName(made.where(F.col("n_obs") >= least).select(*before.columns))


def signal_updates(before: DataFrame, obs: DataFrame, changes: DataFrame, least: int = 13, t: signals.Thresholds = signals.Thresholds()) -> DataFrame:
    """What a table of signals must take in: the rows of marked series that are new or differ, `removed` false, and the
    keys of those that are gone, `removed` true and all else null."""
    ids = changes.select("material_id").distinct()
    was = before.join(ids, "material_id", "left_semi")
    now = refreshed(was, obs, changes, least, t)
    new = now.exceptAll(was.select(*now.columns)).withColumn("removed", F.lit(False))
    gone = was.join(now, ["material_id", "period"], "left_anti").select(*[c if c in ("material_id", "period") else F.lit(None).cast(now.schema[c].dataType).alias(c) for c in now.columns], F.lit(True).alias("removed"))
    return new.unionByName(gone)


def maintain(observations: Log, kept: Log, at: int | None = None, least: int = 13, t: signals.Thresholds = signals.Thresholds()) -> int:
    """Bring the table of signals `kept` up to a snapshot of the observations (the last if none is named), and give its
    number. The table knows which snapshot it is of; the first time all signals are made, later only marked series are
    read."""
    now = observations.last().number if at is None else at
    state = kept.last()
    done = state.batches.get(SNAPSHOT)
    stamp = lambda rows: rows.withColumn("made_at", F.lit(now))
    if done is None:
        kept.append(stamp(signals.history(observations.read(now).select("material_id", "period", "value"), least, t)), SNAPSHOT, now)
    elif done < now:
        changes = history_between(observations, done, now)
        ids = changes.select("material_id").distinct()
        obs = observations.read(now, ids).select("material_id", "period", "value")
        kept.append(stamp(signal_updates(kept.read(state.number, ids).drop("made_at"), obs, changes, least, t)), SNAPSHOT, now)
    return now


#: The name under which a table of signals keeps the number of the snapshot it is of.
SNAPSHOT = "observations"
