"""Series, signals and corroboration on inline series and golden rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewell.operators import compare, quality, series, signals

FALL = [50 * 0.97**i for i in range(13)]
RISE = [50 * 1.03**i for i in range(13)]
FLAT = [50 + i % 2 / 4 for i in range(13)]


def obs(spark, **values):
    rows = [("primary", k, f"{2024 + i // 12}-{i % 12 + 1:02d}", float(v), i) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "source string, material_id string, period string, value double, ingest_ord long")


def test_rules_on_inline_series(spark):
    got = {r.material_id: r for r in signals.latest_signals(obs(spark, fall=FALL, rise=RISE, flat=FLAT)).collect()}
    assert got["fall"].signal == "NEGOTIATE_REDUCTION" and got["fall"].trend == "BROAD_DOWNTREND" and got["fall"].priority == "HIGH"
    assert got["rise"].signal == "VERIFY_STRONG_INCREASE" and got["rise"].signal_group == "UP"
    assert got["flat"].signal == "MONITOR_AND_HOLD" and got["flat"].trend == "RANGE_BOUND"


def test_short_history_has_no_signal(spark):
    assert signals.latest_signals(obs(spark, a=FALL[:12])).count() == 0


#: Published market figures of seven materials, and the labels that the rules must give them.
GOLDEN = [
    ("zinc", 1.695394, 6.985731, 12.013694, 10.960382, 100.0, -0.145179, 0.09451, "BROAD_UPTREND", "VERIFY_STRONG_INCREASE", "HIGH_AGREEMENT"),
    ("copper", -0.066411, 4.571076, 4.080848, 12.024374, 99.768161, -0.001323, 0.089511, "MIXED", "VERIFY_INCREASE", "HIGH_AGREEMENT"),
    ("aluminium", -8.083745, -12.194444, 0.60471, 2.011618, 52.759588, -0.086523, 0.07112, "MIXED", "NEGOTIATE_REDUCTION", "HIGH_AGREEMENT"),
    ("nickel", -5.327496, -7.298742, -6.291857, 1.054484, 47.883918, -0.111937, 0.092891, "BROAD_DOWNTREND", "NEGOTIATE_REDUCTION", "HIGH_AGREEMENT"),
    ("iron_ore", -2.579365, -7.445806, -6.919431, -4.667907, 0.0, None, None, "BROAD_DOWNTREND", "NEGOTIATE_REDUCTION", "UNIT_NOT_COMPARABLE"),
    ("crude_oil", -2.34192, -30.730897, 24.850299, 3.656137, 35.875217, 0.431655, 0.484128, "MIXED", "NEGOTIATE_REDUCTION", "HIGH_AGREEMENT"),
    ("natural_gas", -8.253968, 4.33213, -61.873351, -19.554628, 2.494802, 0.0, 0.305555, "UPTREND_PULLBACK", "CHALLENGE_INCREASE", "HIGH_AGREEMENT"),
]


def test_golden_rows(spark):
    rows = spark.createDataFrame([g[:8] for g in GOLDEN], "material_id string, c1 double, c3 double, c6 double, vs_avg12 double, range_position double, latest_diff_pct double, mean_abs_pct double")
    s = rows.select("*", signals.trend().alias("trend"), signals.negotiation_signal().alias("signal"), signals.range_label().alias("range_label"))
    summary = rows.select("material_id", (F.col("material_id") != "iron_ore").alias("comparable"), "latest_diff_pct", "mean_abs_pct", F.lit("").alias("reason"))
    got = {r.material_id: r for r in signals.corroboration(s.drop("latest_diff_pct", "mean_abs_pct"), summary).collect()}
    for g in GOLDEN:
        r = got[g[0]]
        assert (r.trend, r.signal, r.corroboration) == g[8:] and r.range_label == ("low" if g[5] <= 20 else "high" if g[5] >= 80 else "mid")
    none = signals.corroboration(s.drop("latest_diff_pct", "mean_abs_pct"), summary.limit(0)).select("corroboration", "confidence").distinct().collect()
    assert [tuple(r) for r in none] == [("NOT_AVAILABLE", "MEDIUM")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.01, 1e6), min_size=13, max_size=20))
def test_any_series_gets_one_label_and_starts_at_100(spark, values):
    o = obs(spark, a=values)
    assert all(r.trend and r.signal and r.range_label for r in signals.history(o).collect())
    first = series.rebased(o, 13).where("pos = 1").first()
    assert abs(first.index100 - 100) < 1e-9


def test_comparison(spark):
    p, c = obs(spark, copper=[110.0], ore=[5.0]), obs(spark, copper=[111.0], ore=[5.0])
    ok = spark.createDataFrame([("copper", True, None), ("ore", False, "no unit rule")], "material_id string, comparable boolean, reason string")
    rows = compare.compared(p, c, ok).collect()
    assert [(r.material_id, r.diff, r.diff_pct) for r in rows] == [("copper", 1.0, 0.909091)]
    assert {r.material_id: r.latest_diff_pct for r in compare.full_summary(p, c, ok).collect()} == {"copper": 0.909091, "ore": None}


def test_gates(spark):
    clean = obs(spark, a=RISE, b=FALL)
    m = spark.createDataFrame([("a",), ("b",)], "material_id string")
    gates = lambda o: quality.all_violations(quality.min_observations(o, 13), quality.out_of_order(o), quality.duplicates(o), quality.bad_format(o), quality.bad_value(o), quality.stale_series(o), quality.missing_series(o, m, "primary"), quality.id_set_difference(o, m, "primary"))
    assert gates(clean).count() == 0
    quality.require_clean(gates(clean))
    bad = clean.where("NOT (material_id = 'b' AND period > '2024-11')").union(spark.createDataFrame([("primary", "a", "2024-01", float("nan"), 50), ("primary", "c", "2024-1", -1.0, 0)], clean.schema))
    rules = {r.rule_id for r in gates(bad).collect()}
    assert rules == {"min_observations", "order", "duplicate_period", "period_format", "value", "freshness", "id_set"}
    with pytest.raises(ValueError, match="duplicate_period"):
        quality.require_clean(quality.duplicates(bad))
    good, held = quality.quarantined(bad, quality.bad_value(bad))
    assert {r.material_id for r in good.select("material_id").distinct().collect()} == {"b"} and held.count() == bad.count() - good.count()
