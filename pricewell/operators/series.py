"""Monthly series: positional changes, trailing statistics, slices and rebased views.

A series is the rows of one `keys` value, ordered by period. Lags count observations, not calendar months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent_change

KEYS = ("material_id",)
LAGS = (1, 3, 6, 12)


def _ordered(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("period")


def newest_first(keys=KEYS):
    return Window.partitionBy(*keys).orderBy(F.desc("period"))


def last_n(obs: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """The last n observations of each series; the limit acts before the shuffle."""
    return obs.withColumn("_n", F.row_number().over(newest_first(keys))).where(F.col("_n") <= n).drop("_n")


def latest(obs: DataFrame, keys=KEYS) -> DataFrame:
    return last_n(obs, 1, keys)


def with_changes(obs: DataFrame, lags=LAGS, keys=KEYS, digits: int | None = 6) -> DataFrame:
    """c1, c3, ...: percent change over so many observations; null where history is short or the base 0."""
    w = _ordered(keys)
    shape = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return obs.select("*", *[shape(percent_change(F.col("value"), F.lag("value", k).over(w))).alias(f"c{k}") for k in lags])


def with_clamped_changes(obs: DataFrame, lags=(1, 3, 12), keys=KEYS) -> DataFrame:
    """Changes that fall back on the first observation where history is short."""
    w = _ordered(keys)
    base = lambda k: F.coalesce(F.lag("value", k).over(w), F.first("value").over(w))
    return obs.select("*", *[F.round(percent_change(F.col("value"), base(k)), 6).alias(f"c{k}") for k in lags])


def with_trailing_stats(obs: DataFrame, months: int = 12, keys=KEYS) -> DataFrame:
    """n_obs, avg12, high12, low12, vs_avg12, range_position (50 where flat), volatility of the last months - 1 returns.

    vs_avg12 and range_position stay unrounded: rules read them.
    """
    w = _ordered(keys)
    frame, returns = w.rowsBetween(1 - months, 0), w.rowsBetween(2 - months, 0)
    v = F.col("value")
    out = obs.select(
        "*",
        F.row_number().over(w).alias("n_obs"),
        F.avg("value").over(frame).alias("avg12"),
        F.max("value").over(frame).alias("high12"),
        F.min("value").over(frame).alias("low12"),
        percent_change(v, F.lag("value", 1).over(w)).alias("_return"),
    )
    hi, lo = F.col("high12"), F.col("low12")
    return out.select(
        "*",
        percent_change(v, F.col("avg12")).alias("vs_avg12"),
        F.when(hi == lo, 50.0).otherwise((v - lo) / (hi - lo) * 100).alias("range_position"),
        F.stddev_pop("_return").over(returns).alias("volatility"),
    ).drop("_return")


def profile(obs: DataFrame, keys=KEYS) -> DataFrame:
    """First and latest period and number of observations of each series."""
    return obs.groupBy(*keys).agg(F.min("period").alias("first_period"), F.max("period").alias("latest_period"), F.count("*").alias("n_obs"))


def rebased(obs: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """The last n observations with pos (from 1) and index100: the first of the slice is 100."""
    w = _ordered(keys)
    return last_n(obs, n, keys).select("*", F.row_number().over(w).alias("pos"), (F.col("value") / F.first("value").over(w) * 100).alias("index100"))


def unit_mismatch(selected: DataFrame) -> DataFrame:
    """One row: true if the selected materials differ in unit or currency, so that only an index compares them."""
    return selected.agg((F.count_distinct(F.concat_ws("|", "display_unit", "currency")) > 1).alias("index_mode"))


def slice_view(obs: DataFrame, selected: DataFrame, n: int, index_wanted: bool = False, keys=KEYS) -> DataFrame:
    """The last n observations of the selected materials in the mode that fits them: material columns, pos, shown."""
    mode = F.broadcast(unit_mismatch(selected))  # one row
    rows = rebased(obs.join(selected.select(*keys), list(keys), "left_semi"), n, keys)
    return rows.crossJoin(mode).select("*", F.when(F.col("index_mode") | F.lit(index_wanted), F.col("index100")).otherwise(F.col("value")).alias("shown"))


def slice_summary(view: DataFrame, keys=KEYS) -> DataFrame:
    """Highest, lowest, mean, first and last shown value of each series."""
    return view.groupBy(*keys).agg(F.max("shown").alias("high"), F.min("shown").alias("low"), F.avg("shown").alias("mean"), F.min_by("shown", "period").alias("first_shown"), F.max_by("shown", "period").alias("last_shown"))


def aligned(obs: DataFrame, ids: list[str], n: int, key: str = "material_id") -> DataFrame:
    """Wide form by position: label (the first selected series' period) and a column for each id."""
    rows = rebased(obs.where(F.col(key).isin(*ids)), n, (key,))
    wide = rows.groupBy("pos").pivot(key, ids).agg(F.first("value"))
    label = rows.where(F.col(key) == ids[0]).select("pos", F.col("period").alias("label"))
    return label.join(wide, "pos").select("pos", "label", *[f"`{i}`" for i in ids])


def in_order(rows: DataFrame, by: str = "ord", key: str = "material_id") -> DataFrame:
    """Rows of the configuration, or joined with it, sorted as it orders them, with `place` (from 1; equal for rows of
    one series). Materials without an order come last, by id. The configuration is one row a series; the places are
    taken from its distinct ids."""
    ids = rows.select(by, key).distinct()
    places = ids.select(F.col(key).alias("_key"), F.row_number().over(Window.orderBy(F.asc_nulls_last(by), key)).alias("place"))
    return rows.join(places, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").orderBy("place")
