"""Trend, negotiation signal, range label and corroboration: ordered rules over series measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fixed, signed
from . import series


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the rules, in percent."""

    reversal: float = 3.0
    flat_3: float = 3.0
    flat_6: float = 5.0
    strong_down_3: float = -8.0
    down_3: float = -3.0
    down_6: float = -5.0
    strong_up_3: float = 8.0
    up_3: float = 3.0
    up_6: float = 5.0
    low_range: float = 20.0
    high_range: float = 80.0
    high_agreement: float = 1.0
    medium_agreement: float = 3.0


PRIORITIES = {"NEGOTIATE_REDUCTION": "HIGH", "CHALLENGE_INCREASE": "MEDIUM", "VERIFY_STRONG_INCREASE": "HIGH", "VERIFY_INCREASE": "MEDIUM", "MONITOR_AND_HOLD": "LOW"}
GROUPS = {"NEGOTIATE_REDUCTION": "DOWN", "CHALLENGE_INCREASE": "DOWN", "VERIFY_STRONG_INCREASE": "UP", "VERIFY_INCREASE": "UP", "MONITOR_AND_HOLD": "MONITOR"}
PRIORITY_LABELS = {"HIGH": "high priority", "MEDIUM": "medium priority"}
#: code -> label and advice in this library's words; callers may join a table of their own.
ADVICE = {
    "NEGOTIATE_REDUCTION": ("Opening for a reduction", "Ask for a recalculation on the same material, unit and month."),
    "CHALLENGE_INCREASE": ("Challenge the increase", "Ask for a split by material, processing, energy, currency and freight."),
    "VERIFY_STRONG_INCREASE": ("Verify upward pressure", "Ask for the material share, purchase months and stock cycle."),
    "VERIFY_INCREASE": ("Verify cost transmission", "Check the cost structure and purchase lag before any surcharge."),
    "MONITOR_AND_HOLD": ("Monitor", "Hold the price and agree on the next review."),
}


def trend(t: Thresholds = Thresholds()) -> Column:
    c1, c3, c6 = F.col("c1"), F.col("c3"), F.col("c6")
    return (
        F.when((c1 >= t.reversal) & (c3 <= -t.reversal), "DOWNTREND_REBOUND")
        .when((c1 <= -t.reversal) & (c3 >= t.reversal), "UPTREND_PULLBACK")
        .when((c1 < 0) & (c3 < 0) & (c6 < 0), "BROAD_DOWNTREND")
        .when((c1 > 0) & (c3 > 0) & (c6 > 0), "BROAD_UPTREND")
        .when((F.abs(c3) < t.flat_3) & (F.abs(c6) < t.flat_6), "RANGE_BOUND")
        .otherwise("MIXED")
    )


def negotiation_signal(t: Thresholds = Thresholds()) -> Column:
    c3, c6, above = F.col("c3"), F.col("c6"), F.col("vs_avg12")
    return (
        F.when((c3 <= t.strong_down_3) | ((c3 <= t.down_3) & (c6 <= t.down_6)), "NEGOTIATE_REDUCTION")
        .when((c3 <= t.down_3) | ((c6 <= t.down_6) & (above < 0)), "CHALLENGE_INCREASE")
        .when((c3 >= t.strong_up_3) | ((c3 >= t.up_3) & (c6 >= t.up_6)), "VERIFY_STRONG_INCREASE")
        .when((c3 >= t.up_3) | (c6 >= t.up_6), "VERIFY_INCREASE")
        .otherwise("MONITOR_AND_HOLD")
    )


def range_label(t: Thresholds = Thresholds()) -> Column:
    p = F.col("range_position")
    return F.when(p <= t.low_range, "low").when(p >= t.high_range, "high").otherwise("mid")


def coded(code: Column, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(code == k, F.lit(v))
    return out


def history(obs: DataFrame, least: int = 13, t: Thresholds = Thresholds()) -> DataFrame:
    """A signal for every period with at least `least` observations so far; one window pass."""
    rows = series.with_trailing_stats(series.with_changes(obs)).where(F.col("n_obs") >= least)
    rows = rows.select("*", trend(t).alias("trend"), negotiation_signal(t).alias("signal"), range_label(t).alias("range_label"))
    return rows.select("*", coded(F.col("signal"), PRIORITIES).alias("priority"), coded(F.col("signal"), GROUPS).alias("signal_group"))


def latest_signals(obs: DataFrame, least: int = 13, t: Thresholds = Thresholds()) -> DataFrame:
    """The signal of each series' last period. Only its last observations are needed, so they are cut first."""
    recent = history(series.last_n(obs, max(13, least)), least, t)
    return series.latest(recent)


def with_advice(signals: DataFrame) -> DataFrame:
    """The label and advice of each signal, and the label of its priority (any but HIGH and MEDIUM: routine watch)."""
    code = F.col("signal")
    priority = F.coalesce(coded(F.col("priority"), PRIORITY_LABELS), F.lit("routine watch"))
    return signals.select("*", priority.alias("priority_label"), coded(code, {k: v[0] for k, v in ADVICE.items()}).alias("label"), coded(code, {k: v[1] for k, v in ADVICE.items()}).alias("action"))


def evidence() -> Column:
    """Four lines of figures and two constant limits of what they say."""
    line = lambda head, c: F.concat(F.lit(head + " "), signed(F.col(c), 2), F.lit("%"))
    place = F.concat(F.lit("at "), fixed(F.col("range_position"), 1), F.lit("% of the 12-month range"))
    return F.array(line("3-month change", "c3"), line("6-month change", "c6"), line("latest against the 12-month average", "vs_avg12"), place, F.lit("Market prices only, not the cost of a finished product."), F.lit("Check the material share, purchase lag, stock, currency and freight as well."))


def corroboration(signals: DataFrame, summary: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """How far the second source agrees; it never changes trend or signal.

    summary: (material_id, comparable, latest_diff_pct, mean_abs_pct, reason); a missing row is NOT_AVAILABLE.
    """
    s = summary.select("material_id", F.col("comparable").alias("_ok"), "latest_diff_pct", "mean_abs_pct", F.col("reason").alias("_reason"))
    rows = signals.join(s, "material_id", "left")
    latest, mean = F.abs("latest_diff_pct"), F.col("mean_abs_pct")
    under = lambda limit: (mean <= limit) & (latest <= limit)
    status = F.when(F.col("_ok").isNull(), "NOT_AVAILABLE").when(~F.col("_ok"), "UNIT_NOT_COMPARABLE").when(under(t.high_agreement), "HIGH_AGREEMENT").when(under(t.medium_agreement), "MEDIUM_AGREEMENT").otherwise("REVIEW_REQUIRED")
    confidence = {"NOT_AVAILABLE": "MEDIUM", "UNIT_NOT_COMPARABLE": "MEDIUM", "HIGH_AGREEMENT": "HIGH", "MEDIUM_AGREEMENT": "MEDIUM", "REVIEW_REQUIRED": "LOW"}
    rows = rows.withColumn("corroboration", status)
    note = F.when(F.col("corroboration") == "UNIT_NOT_COMPARABLE", F.coalesce(F.nullif(F.col("_reason"), F.lit("")), F.lit("second source is context only"))).otherwise("second source is a cross-check only")
    return rows.select(*signals.columns, "corroboration", coded(F.col("corroboration"), confidence).alias("confidence"), "latest_diff_pct", "mean_abs_pct", note.alias("note"))


def priority_counts(signals: DataFrame) -> DataFrame:
    """HIGH, MEDIUM and LOW, zero where absent, and the number of series."""
    n = signals.agg(*[F.count_if(F.col("priority") == p).alias(p) for p in ("HIGH", "MEDIUM", "LOW")], F.count("*").alias("n_series"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.col(p).alias("n"), F.col("n_series")) for p in ("HIGH", "MEDIUM", "LOW")])).alias("r")).select("r.*")


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal").agg(F.count("*").alias("n"))


def dashboard_counts(signals: DataFrame) -> DataFrame:
    group = lambda g: F.count_if(F.col("signal_group") == g)
    return signals.agg(group("DOWN").alias("n_down"), group("UP").alias("n_up"), group("MONITOR").alias("n_monitor"), F.count_if(F.col("priority") == "HIGH").alias("n_high"))


def of_group(signals: DataFrame, group: str = "ALL") -> DataFrame:
    return signals if group == "ALL" else signals.where(F.col("signal_group") == group)


def cards(signals: DataFrame) -> DataFrame:
    """What a signal card shows: position within 0 and 100, texts of period, value and changes."""
    from ..functions.scalars import number_text, period_text, signed_percent

    position = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("range_position", F.lit(0.0))))
    return signals.select("material_id", period_text(F.col("period")).alias("period_text"), number_text(F.col("value"), 2, 0).alias("value_text"), F.round(position, 6).alias("position"), "signal_group", *[signed_percent(F.col(c)).alias(f"{c}_text") for c in ("c1", "c3", "c6", "c12")])
