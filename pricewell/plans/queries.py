"""The queries of the library over the given tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare, incremental, ingest, intervals, profile, quality, report, rules, series, shouldcost, signals, status
from ..sources import csv_export, documents, nested, snapshots
from ..streaming import gates, refresh
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _fixed(x: str, places: int) -> str:
    """SQL of a number as text with so many places, half up on its decimal digits."""
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,{places})) AS VARCHAR)"


def _signed(x: str, places: int) -> str:
    return f"CASE WHEN starts_with({_fixed(x, places)}, '-') THEN '' ELSE '+' END || {_fixed(x, places)}"


def _plain(x: str) -> str:
    return rf"regexp_replace({_fixed(x, 6)}, '\.?0+$', '')"


def _percent(x: str) -> str:
    f = _fixed(x, 2)
    return f"CASE WHEN {f} = '0.00' THEN '— ' WHEN starts_with({f}, '-') THEN '▼ ' ELSE '▲ +' END || {f} || '%'"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


W = "OVER (PARTITION BY material_id ORDER BY period)"
CHANGES = "changes AS (SELECT *, " + ", ".join(f"round((value - lag(value, {k}) {W}) / lag(value, {k}) {W} * 100, 6) AS c{k}" for k in series.LAGS) + " FROM obs_primary)"
STATS = f"""stats AS (SELECT *, row_number() {W} AS n_obs,
  avg(value) OVER w12 AS avg12, max(value) OVER w12 AS high12, min(value) OVER w12 AS low12,
  (value - lag(value, 1) {W}) / lag(value, 1) {W} * 100 AS ret FROM changes
  WINDOW w12 AS (PARTITION BY material_id ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
stats2 AS (SELECT *, (value - avg12) / avg12 * 100 AS vs_avg12,
  CASE WHEN high12 = low12 THEN 50 ELSE (value - low12) / (high12 - low12) * 100 END AS range_position,
  stddev_pop(ret) OVER (PARTITION BY material_id ORDER BY period ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS volatility FROM stats)"""
SIGNALS = """signals0 AS (SELECT *,
  CASE WHEN c1 >= 3 AND c3 <= -3 THEN 'DOWNTREND_REBOUND' WHEN c1 <= -3 AND c3 >= 3 THEN 'UPTREND_PULLBACK'
    WHEN c1 < 0 AND c3 < 0 AND c6 < 0 THEN 'BROAD_DOWNTREND' WHEN c1 > 0 AND c3 > 0 AND c6 > 0 THEN 'BROAD_UPTREND'
    WHEN abs(c3) < 3 AND abs(c6) < 5 THEN 'RANGE_BOUND' ELSE 'MIXED' END AS trend,
  CASE WHEN c3 <= -8 OR (c3 <= -3 AND c6 <= -5) THEN 'NEGOTIATE_REDUCTION' WHEN c3 <= -3 OR (c6 <= -5 AND vs_avg12 < 0) THEN 'CHALLENGE_INCREASE'
    WHEN c3 >= 8 OR (c3 >= 3 AND c6 >= 5) THEN 'VERIFY_STRONG_INCREASE' WHEN c3 >= 3 OR c6 >= 5 THEN 'VERIFY_INCREASE' ELSE 'MONITOR_AND_HOLD' END AS signal,
  CASE WHEN range_position <= 20 THEN 'low' WHEN range_position >= 80 THEN 'high' ELSE 'mid' END AS range_label
  FROM stats2 WHERE n_obs >= 13),
signals AS (SELECT *,
  CASE signal WHEN 'NEGOTIATE_REDUCTION' THEN 'HIGH' WHEN 'VERIFY_STRONG_INCREASE' THEN 'HIGH' WHEN 'MONITOR_AND_HOLD' THEN 'LOW' ELSE 'MEDIUM' END AS priority,
  CASE signal WHEN 'NEGOTIATE_REDUCTION' THEN 'DOWN' WHEN 'CHALLENGE_INCREASE' THEN 'DOWN' WHEN 'MONITOR_AND_HOLD' THEN 'MONITOR' ELSE 'UP' END AS signal_group
  FROM signals0),
latest AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) = 1)"""
SIGNAL_PARTS = (X.FX1, CHANGES, STATS, SIGNALS)
COMPATIBLE = """compatible AS (SELECT material_id, primary_unit, comparison_unit,
  coalesce(CASE WHEN mno % 5 = 0 THEN false WHEN mno % 3 = 0 THEN contains(lower(primary_unit), '/mt') AND contains(lower(comparison_unit), 'metric ton')
    WHEN mno % 3 = 1 THEN contains(lower(primary_unit), '/bbl') AND contains(lower(comparison_unit), 'barrel')
    ELSE contains(lower(primary_unit), '/mmbtu') AND (contains(lower(comparison_unit), 'million btu') OR contains(lower(comparison_unit), 'mmbtu')) END, false) AS comparable,
  CASE WHEN mno % 5 = 0 THEN 'no unit rule' END AS reason FROM materials)"""
COMPARED = """compared AS (SELECT p.material_id, p.period, p.value AS primary_value, c.value AS comparison_value,
  round(c.value - p.value, 6) AS diff, round((c.value - p.value) / p.value * 100, 6) AS diff_pct
  FROM obs_primary p JOIN obs_comparison c USING (material_id, period) WHERE p.material_id IN (SELECT material_id FROM compatible WHERE comparable)),
summary AS (SELECT material_id, max(period) AS latest_period, arg_max(primary_value, period) AS latest_primary, arg_max(comparison_value, period) AS latest_comparison,
  arg_max(diff_pct, period) AS latest_diff_pct, round(avg(abs(diff_pct)), 6) AS mean_abs_pct, max(abs(diff_pct)) AS max_abs_pct
  FROM (SELECT * FROM compared QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) <= 12) GROUP BY 1)"""
COMPARE_PARTS = (X.FX1, X.FX2, X.FX3, COMPATIBLE, COMPARED)
REVIEWED = """reviewed0 AS (SELECT *, mat_ratio * mat_rate / 100 AS mat_impact, fx_ratio * fx_rate / 100 AS fx_impact, proc_ratio * proc_rate / 100 AS proc_impact,
  energy_ratio * energy_rate / 100 AS energy_impact, other_ratio * other_rate / 100 AS other_impact, mat_ratio + proc_ratio + energy_ratio + other_ratio AS base_ratio_sum FROM quotes),
reviewed1 AS (SELECT *, mat_impact + fx_impact + proc_impact + energy_impact + other_impact AS estimate FROM reviewed0),
reviewed2 AS (SELECT *, estimate - mat_impact AS other_inputs, supplier_ask - estimate AS gap FROM reviewed1),
reviewed3 AS (SELECT *, price * (1 + estimate / 100) AS new_price, price * (1 + supplier_ask / 100) AS requested_price, price * gap / 100 AS unexplained FROM reviewed2),
reviewed4 AS (SELECT *, CASE WHEN price < 0 THEN 'negative_price'
  WHEN least(mat_ratio, fx_ratio, proc_ratio, energy_ratio, other_ratio) < 0 OR greatest(mat_ratio, fx_ratio, proc_ratio, energy_ratio, other_ratio) > 100 THEN 'ratio_out_of_range'
  WHEN least(mat_rate, fx_rate, proc_rate, energy_rate, other_rate, supplier_ask) < -100 THEN 'rate_below_minus_100'
  WHEN base_ratio_sum > 100 THEN 'base_ratios_over_100' WHEN new_price < 0 OR requested_price < 0 THEN 'negative_result_price' END AS invalid_reason FROM reviewed3),
reviewed AS (SELECT *, CASE WHEN invalid_reason IS NOT NULL THEN 'INVALID' WHEN estimate < -0.5 AND supplier_ask >= 0 THEN 'REQUEST_REDUCTION'
  WHEN estimate < -0.5 AND supplier_ask < 0 AND gap > 0.5 THEN 'REQUEST_DEEPER_REDUCTION' WHEN mat_impact < -0.5 AND supplier_ask > 0 AND gap > 0.5 THEN 'CHALLENGE_INCREASE'
  WHEN gap >= 3 THEN 'HIGH_CHALLENGE' WHEN gap >= 1.5 THEN 'REQUEST_EVIDENCE' WHEN gap > 0.5 THEN 'CLARIFY_SMALL_GAP' WHEN abs(gap) <= 0.5 THEN 'CONDITIONAL_REVIEW' ELSE 'SUPPLIER_BELOW_MODEL' END AS verdict FROM reviewed4)"""
REVIEW_PARTS = (X.FX4, REVIEWED)
KEYS = ", ".join(X.QUOTE_KEYS)
GAP_TEXT = f"CASE WHEN abs(gap) < 0.005 THEN '0.00 points (supplier equals the model)' ELSE {_signed('gap', 2)} || ' points (supplier ' || CASE WHEN gap > 0 THEN 'above' ELSE 'below' END || ' the model)' END"
EVIDENCE = f"'model ' || {_signed('estimate', 2)} || '%, supplier ' || {_signed('supplier_ask', 2)} || '%; gap ' || {_signed('gap', 2)} || ' points; material explains ' || {_signed('mat_impact', 2)} || ' points, other inputs ' || {_signed('other_inputs', 2)}"


def _history(spark, d):
    return signals.history(X.obs_primary(spark, d))


def _latest(spark, d):
    return signals.latest_signals(X.obs_primary(spark, d))


def _two_sources(spark, d, p=None):
    p, m = X.obs_primary(spark, d) if p is None else p, X.materials(spark, d)
    return p, X.obs_comparison(p), compare.unit_compatibility(m, X.rules(m))


def _reviewed(spark, d):
    return shouldcost.reviewed(X.quotes(spark, d))


# series


@query(X.sql("SELECT material_id, period, value, c1, c3, c6, c12 FROM changes QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) = 1", X.FX1, CHANGES))
def latest_change(spark: SparkSession, d: str) -> DataFrame:
    """Latest value of each series and its change over 1, 3, 6 and 12 observations."""
    recent = series.last_n(X.obs_primary(spark, d), 13)
    return series.latest(series.with_changes(recent)).select("material_id", "period", "value", "c1", "c3", "c6", "c12").orderBy("material_id")


@query(X.sql("SELECT material_id, period, " + ", ".join(f"round((value - coalesce(lag(value, {k}) {W}, first_value(value) {W})) / coalesce(lag(value, {k}) {W}, first_value(value) {W}) * 100, 6) AS c{k}" for k in (1, 3, 12)) + " FROM obs_primary", X.FX1))
def overview_change_clamped(spark: SparkSession, d: str) -> DataFrame:
    return series.with_clamped_changes(X.obs_primary(spark, d)).select("material_id", "period", "c1", "c3", "c12")


@query(X.sql("SELECT material_id, coalesce(currency, 'USD') AS currency, display_unit, count(*) AS n_obs, min(period) AS first_period, max(period) AS latest_period FROM obs_primary JOIN materials USING (material_id) GROUP BY 1, 2, 3", X.FX1, X.FX3))
def series_profile(spark: SparkSession, d: str) -> DataFrame:
    return ingest.series_header(X.obs_primary(spark, d), X.materials(spark, d))


@query(X.sql("SELECT material_id, period, n_obs, round(avg12, 6) AS avg12, high12, low12, round(vs_avg12, 6) AS vs_avg12, round(range_position, 6) AS range_position FROM stats2", X.FX1, CHANGES, STATS))
def trailing_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = series.with_trailing_stats(X.obs_primary(spark, d)).withColumn("n_obs", F.col("n_obs").cast("long"))
    return _rounded(rows, "avg12", "vs_avg12", "range_position").select("material_id", "period", "n_obs", "avg12", "high12", "low12", "vs_avg12", "range_position")


@query(X.sql("SELECT material_id, period, round(volatility, 6) AS volatility FROM stats2 WHERE n_obs >= 12", X.FX1, CHANGES, STATS))
def return_volatility(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.with_trailing_stats(X.obs_primary(spark, d)).where("n_obs >= 12"), "volatility").select("material_id", "period", "volatility")


@query(X.sql("SELECT material_id, period, value FROM obs_primary QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) <= 13", X.FX1))
def tail_n(spark: SparkSession, d: str) -> DataFrame:
    return series.last_n(X.obs_primary(spark, d), 13).select("material_id", "period", "value")


SLICE = """slice AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY period) AS pos, value / first_value(value) OVER (PARTITION BY material_id ORDER BY period) * 100 AS index100
  FROM (SELECT * FROM obs_primary QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) <= 37)),
mode AS (SELECT count(DISTINCT display_unit || '|' || currency) > 1 AS index_mode FROM materials WHERE mno % 4 <> 1),
view_ AS (SELECT s.*, index_mode, CASE WHEN index_mode THEN index100 ELSE value END AS shown FROM slice s, mode WHERE mno % 4 <> 1)"""


def _view(spark, d):
    return series.slice_view(X.obs_primary(spark, d), X.materials(spark, d).where("mno % 4 <> 1"), 37)


@query(X.sql("SELECT material_id, period, CAST(pos AS BIGINT) AS pos, round(shown, 6) AS shown, index_mode FROM view_", X.FX1, X.FX3, SLICE))
def rebase_100(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_view(spark, d), "shown").select("material_id", "period", F.col("pos").cast("long").alias("pos"), "shown", "index_mode")


@query(X.sql("SELECT material_id, round(max(shown), 6) AS high, round(min(shown), 6) AS low, round(avg(shown), 4) AS mean, round(arg_min(shown, period), 6) AS first_shown, round(arg_max(shown, period), 6) AS last_shown FROM view_ GROUP BY 1", X.FX1, X.FX3, SLICE))
def tail_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(series.slice_summary(_view(spark, d)), "high", "low", "first_shown", "last_shown"), "mean", digits=4)


@query(X.sql("""SELECT CAST(pos AS BIGINT) AS pos, max(CASE WHEN material_id = 'Brand#11' THEN period END) AS label, round(max(CASE WHEN material_id = 'Brand#11' THEN value END), 6) AS a,
  round(max(CASE WHEN material_id = 'Brand#12' THEN value END), 6) AS b, round(max(CASE WHEN material_id = 'Brand#13' THEN value END), 6) AS c FROM slice GROUP BY 1""", X.FX1, X.FX3, SLICE))
def aligned_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = series.aligned(X.obs_primary(spark, d), ["Brand#11", "Brand#12", "Brand#13"], 37)
    return _rounded(wide.toDF("pos", "label", "a", "b", "c"), "a", "b", "c").withColumn("pos", F.col("pos").cast("long"))


@query(X.sql("SELECT material_id, period, CASE WHEN c1 > 0.0005 THEN 'up' WHEN c1 < -0.0005 THEN 'down' WHEN c1 IS NOT NULL THEN 'flat' END AS direction FROM changes", X.FX1, CHANGES))
def direction_class(spark: SparkSession, d: str) -> DataFrame:
    return series.with_changes(X.obs_primary(spark, d)).select("material_id", "period", S.direction(F.col("c1")).alias("direction"))


# signals

SIGNAL_COLUMNS = ("material_id", "period", "c1", "c3", "c6", "c12", "trend", "signal", "priority", "signal_group", "range_label")


@query(X.sql(f"SELECT {', '.join(SIGNAL_COLUMNS)}, round(vs_avg12, 6) AS vs_avg12 FROM signals", *SIGNAL_PARTS))
def signal_history(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_history(spark, d), "vs_avg12").select(*SIGNAL_COLUMNS, "vs_avg12")


@query(X.sql(f"SELECT {', '.join(SIGNAL_COLUMNS)}, round(volatility, 6) AS volatility FROM latest", *SIGNAL_PARTS))
def signal_latest(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_latest(spark, d), "volatility").select(*SIGNAL_COLUMNS, "volatility")


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(X.sql(f"SELECT material_id, signal, {_case('signal', {k: v[0] for k, v in signals.ADVICE.items()})} AS label, {_case('signal', {k: v[1] for k, v in signals.ADVICE.items()})} AS action, CASE priority WHEN 'HIGH' THEN 'high priority' WHEN 'MEDIUM' THEN 'medium priority' ELSE 'routine watch' END AS priority_label FROM latest", *SIGNAL_PARTS))
def signal_advice(spark: SparkSession, d: str) -> DataFrame:
    return signals.with_advice(_latest(spark, d)).select("material_id", "signal", "label", "action", "priority_label")


@query(X.sql(f"""SELECT material_id, concat_ws(chr(10), '3-month change ' || {_signed("c3", 2)} || '%', '6-month change ' || {_signed("c6", 2)} || '%', 'latest against the 12-month average ' || {_signed("vs_avg12", 2)} || '%',
  'at ' || {_fixed("range_position", 1)} || '% of the 12-month range', 'Market prices only, not the cost of a finished product.', 'Check the material share, purchase lag, stock, currency and freight as well.') AS lines FROM latest""", *SIGNAL_PARTS))
def signal_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("material_id", F.array_join(signals.evidence(), "\n").alias("lines"))


@query(X.sql("SELECT p AS priority, (SELECT count(*) FROM latest WHERE priority = p) AS n, (SELECT count(*) FROM latest) AS n_series FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) t(p)", *SIGNAL_PARTS))
def priority_counts(spark: SparkSession, d: str) -> DataFrame:
    return signals.priority_counts(_latest(spark, d))


@query(X.sql("SELECT signal, count(*) AS n FROM signals GROUP BY 1", *SIGNAL_PARTS))
def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return signals.signal_counts(_history(spark, d))


@query(X.sql("SELECT count(*) FILTER (signal_group = 'DOWN') AS n_down, count(*) FILTER (signal_group = 'UP') AS n_up, count(*) FILTER (signal_group = 'MONITOR') AS n_monitor, count(*) FILTER (priority = 'HIGH') AS n_high FROM latest", *SIGNAL_PARTS))
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return signals.dashboard_counts(_latest(spark, d))


@query(X.sql("SELECT material_id, signal, (SELECT count(*) FROM latest WHERE signal_group = 'DOWN') AS n_visible FROM latest WHERE signal_group = 'DOWN'", *SIGNAL_PARTS))
def filtered_signals(spark: SparkSession, d: str) -> DataFrame:
    shown = signals.of_group(_latest(spark, d), "DOWN").select("material_id", "signal")
    return shown.crossJoin(F.broadcast(shown.agg(F.count("*").alias("n_visible"))))  # one row


@query(X.sql("""SELECT material_id, replace(period, '-', '/') AS period_text, round(greatest(0, least(100, range_position)), 6) AS position, signal_group,
  CASE WHEN value < 10 THEN printf('%.2f', value) ELSE format('{:,}', CAST(round(value) AS BIGINT)) END AS value_text, """ + ", ".join(f"{_percent(c)} AS {c}_text" for c in ("c1", "c3", "c6", "c12")) + " FROM latest", *SIGNAL_PARTS))
def signal_cards(spark: SparkSession, d: str) -> DataFrame:
    return signals.cards(_latest(spark, d)).select("material_id", "period_text", "position", "signal_group", "value_text", "c1_text", "c3_text", "c6_text", "c12_text")


#: A group of materials with limits of its own.
CALM = signals.Thresholds(reversal=1.5, flat_3=1.0, flat_6=2.0, strong_down_3=-4.0, down_3=-1.0, down_6=-2.0, strong_up_3=4.0, up_3=1.0, up_6=2.0)


def _trend_sql(t: signals.Thresholds) -> str:
    return f"""CASE WHEN c1 >= {t.reversal} AND c3 <= -{t.reversal} THEN 'DOWNTREND_REBOUND' WHEN c1 <= -{t.reversal} AND c3 >= {t.reversal} THEN 'UPTREND_PULLBACK' WHEN c1 < 0 AND c3 < 0 AND c6 < 0 THEN 'BROAD_DOWNTREND'
    WHEN c1 > 0 AND c3 > 0 AND c6 > 0 THEN 'BROAD_UPTREND' WHEN abs(c3) < {t.flat_3} AND abs(c6) < {t.flat_6} THEN 'RANGE_BOUND' ELSE 'MIXED' END"""


def _signal_sql(t: signals.Thresholds) -> str:
    return f"""CASE WHEN c3 <= {t.strong_down_3} OR (c3 <= {t.down_3} AND c6 <= {t.down_6}) THEN 'NEGOTIATE_REDUCTION' WHEN c3 <= {t.down_3} OR (c6 <= {t.down_6} AND vs_avg12 < 0) THEN 'CHALLENGE_INCREASE'
    WHEN c3 >= {t.strong_up_3} OR (c3 >= {t.up_3} AND c6 >= {t.up_6}) THEN 'VERIFY_STRONG_INCREASE' WHEN c3 >= {t.up_3} OR c6 >= {t.up_6} THEN 'VERIFY_INCREASE' ELSE 'MONITOR_AND_HOLD' END"""


@query(X.sql(f"""SELECT material_id, period, CASE WHEN mno % 3 = 0 THEN {_trend_sql(CALM)} ELSE {_trend_sql(signals.Thresholds())} END AS trend, CASE WHEN mno % 3 = 0 THEN {_signal_sql(CALM)} ELSE {_signal_sql(signals.Thresholds())} END AS signal FROM signals""", *SIGNAL_PARTS))
def rule_table_signals(spark: SparkSession, d: str) -> DataFrame:
    """Trends and signals by tables of rules, with a set of its own for one group of materials."""
    rows = _history(spark, d).drop("trend", "signal").withColumn("group", F.when(F.col("mno") % 3 == 0, "calm").otherwise("default"))
    table = lambda f: rules.rule_table(spark, default=f(), calm=f(CALM))
    rows = rules.decided(rows, table(rules.trend_rules), rules.SIGNAL_MEASURES, "trend", "group")
    return rules.decided(rows, table(rules.signal_rules), rules.SIGNAL_MEASURES, "signal", "group").select("material_id", "period", "trend", "signal")


# two sources


@query(X.sql("SELECT material_id, count(*) AS n_common, min(period) AS first_common, max(period) AS last_common FROM (SELECT material_id, period FROM obs_primary INTERSECT SELECT material_id, period FROM obs_comparison) GROUP BY 1", X.FX1, X.FX2))
def source_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = X.obs_primary(spark, d)
    return compare.overlap(p, X.obs_comparison(p))


@query(X.sql("SELECT material_id, primary_unit, comparison_unit, comparable, reason FROM compatible", X.FX3, COMPATIBLE))
def unit_compatibility(spark: SparkSession, d: str) -> DataFrame:
    m = X.materials(spark, d)
    return compare.unit_compatibility(m, X.rules(m))


@query(X.sql("SELECT material_id, period, primary_value, comparison_value, diff, diff_pct FROM compared", *COMPARE_PARTS))
def compare_rows(spark: SparkSession, d: str) -> DataFrame:
    return compare.compared(*_two_sources(spark, d))


@query(X.sql("""SELECT l.material_id, l.latest_period, l.latest_primary, l.latest_comparison, n_common, comparable, reason, latest_diff_pct, mean_abs_pct, max_abs_pct
  FROM (SELECT p.material_id, max(p.period) AS latest_period, arg_max(p.value, p.period) AS latest_primary, arg_max(c.value, p.period) AS latest_comparison, count(*) AS n_common FROM obs_primary p JOIN obs_comparison c USING (material_id, period) GROUP BY 1) l
  JOIN compatible USING (material_id) LEFT JOIN (SELECT material_id, latest_diff_pct, mean_abs_pct, max_abs_pct FROM summary) s USING (material_id)""", *COMPARE_PARTS))
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.full_summary(*_two_sources(spark, d))


@query(X.sql("SELECT material_id, period, series, value FROM (SELECT material_id, period, primary_value, comparison_value FROM compared QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) <= 12) UNPIVOT (value FOR series IN (primary_value, comparison_value))", *COMPARE_PARTS))
def compare_last12(spark: SparkSession, d: str) -> DataFrame:
    return compare.chart_rows(compare.compared(*_two_sources(spark, d)))


@query(X.sql("SELECT count(*) FILTER (comparable) AS n_comparable, count(*) AS n_materials FROM compatible", X.FX3, COMPATIBLE))
def comparable_count(spark: SparkSession, d: str) -> DataFrame:
    m = X.materials(spark, d)
    return compare.unit_compatibility(m, X.rules(m)).agg(F.count_if("comparable").alias("n_comparable"), F.count("*").alias("n_materials"))


@query(X.sql("""SELECT material_id, trend, signal, CASE WHEN c.comparable IS NULL THEN 'NOT_AVAILABLE' WHEN NOT c.comparable THEN 'UNIT_NOT_COMPARABLE' WHEN mean_abs_pct <= 1 AND abs(latest_diff_pct) <= 1 THEN 'HIGH_AGREEMENT'
    WHEN mean_abs_pct <= 3 AND abs(latest_diff_pct) <= 3 THEN 'MEDIUM_AGREEMENT' ELSE 'REVIEW_REQUIRED' END AS corroboration,
  CASE WHEN c.comparable IS NULL OR NOT c.comparable THEN 'MEDIUM' WHEN mean_abs_pct <= 1 AND abs(latest_diff_pct) <= 1 THEN 'HIGH' WHEN mean_abs_pct <= 3 AND abs(latest_diff_pct) <= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  latest_diff_pct, mean_abs_pct, CASE WHEN c.comparable IS NOT NULL AND NOT c.comparable THEN coalesce(nullif(reason, ''), 'second source is context only') ELSE 'second source is a cross-check only' END AS note
  FROM latest LEFT JOIN (SELECT * FROM compatible WHERE material_id IN (SELECT material_id FROM obs_comparison)) c USING (material_id) LEFT JOIN (SELECT material_id, latest_diff_pct, mean_abs_pct FROM summary) s USING (material_id)""", X.FX1, X.FX2, X.FX3, CHANGES, STATS, SIGNALS, COMPATIBLE, COMPARED))
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.corroboration(_latest(spark, d), compare.full_summary(*_two_sources(spark, d)))
    return rows.select("material_id", "trend", "signal", "corroboration", "confidence", "latest_diff_pct", "mean_abs_pct", "note")


@query(X.sql("""SELECT source, count(*) AS n_series, min(latest) AS min_latest, max(latest) AS max_latest, string_agg(material_id || '=' || latest, ',' ORDER BY material_id) AS latest_text
  FROM (SELECT 'primary' AS source, material_id, max(period) AS latest FROM obs_primary GROUP BY 2 UNION ALL SELECT 'comparison', material_id, max(period) FROM obs_comparison GROUP BY 2) GROUP BY 1""", X.FX1, X.FX2))
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = compare.source_rollup(_sourced(spark, d))
    text = F.array_join(F.transform(F.map_entries("latest_by_series"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return r.select("source", "n_series", "min_latest", "max_latest", text.alias("latest_text"))


# quotes


@query(X.sql(f"""SELECT {KEYS}, CASE k WHEN 1 THEN 'negative_price' WHEN 2 THEN 'ratio_out_of_range' WHEN 3 THEN 'rate_below_minus_100' WHEN 4 THEN 'base_ratios_over_100' WHEN 5 THEN 'not_numeric' WHEN 6 THEN 'not_numeric'
    WHEN 7 THEN 'negative_result_price' WHEN 8 THEN CASE WHEN base_ratio_sum > 100 THEN 'base_ratios_over_100' ELSE 'result_not_finite' END WHEN 9 THEN 'not_numeric' ELSE invalid_reason END AS invalid_reason,
  CASE k WHEN 1 THEN 'price' WHEN 2 THEN 'mat_ratio,fx_ratio' WHEN 3 THEN 'energy_rate' WHEN 5 THEN 'mat_rate' WHEN 6 THEN 'price' WHEN 9 THEN 'supplier_ask' ELSE '' END AS invalid_fields
  FROM (SELECT *, (l_orderkey + l_linenumber) % 50 AS k FROM reviewed)""", *REVIEW_PARTS))
def quote_validity(spark: SparkSession, d: str) -> DataFrame:
    """Some quotes are made invalid, in each way there is."""
    q = X.broken_quotes(X.quotes(spark, d))
    return shouldcost.reviewed(q).select(*X.QUOTE_KEYS, "invalid_reason", F.array_join(shouldcost.invalid_fields(), ",").alias("invalid_fields"))


@query(X.sql(f"SELECT {KEYS}, round(estimate, 6) AS estimate, round(other_inputs, 6) AS other_inputs, round(gap, 6) AS gap, new_price, requested_price, unexplained FROM reviewed", *REVIEW_PARTS))
def should_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = _rounded(shouldcost.estimates(X.quotes(spark, d)), "estimate", "other_inputs", "gap")
    return rows.select(*X.QUOTE_KEYS, "estimate", "other_inputs", "gap", "new_price", "requested_price", "unexplained")


@query(X.sql(f"""SELECT {KEYS}, verdict, CASE WHEN verdict = 'INVALID' THEN NULL WHEN verdict = 'REQUEST_DEEPER_REDUCTION' THEN CASE WHEN gap >= 3 THEN 'high' ELSE 'medium' END WHEN verdict IN ('REQUEST_REDUCTION', 'CHALLENGE_INCREASE', 'HIGH_CHALLENGE') THEN 'high'
  WHEN verdict IN ('REQUEST_EVIDENCE', 'CLARIFY_SMALL_GAP') THEN 'medium' WHEN verdict = 'CONDITIONAL_REVIEW' THEN 'balanced' ELSE 'favorable' END AS tone,
  {GAP_TEXT} AS gap_text, {EVIDENCE} AS evidence FROM reviewed""", *REVIEW_PARTS))
def quote_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select(*X.QUOTE_KEYS, "verdict", "tone", shouldcost.gap_text().alias("gap_text"), F.array_join(shouldcost.verdict_evidence(), "; ").alias("evidence"))


STRICT = shouldcost.CostRules(match=0.25, evidence=1.0, challenge=2.0)


@query(X.sql(f"""SELECT {KEYS}, CASE WHEN l_linenumber % 2 = 0 AND verdict <> 'INVALID' THEN CASE WHEN estimate < -0.25 AND supplier_ask >= 0 THEN 'REQUEST_REDUCTION' WHEN estimate < -0.25 AND supplier_ask < 0 AND gap > 0.25 THEN 'REQUEST_DEEPER_REDUCTION'
  WHEN mat_impact < -0.25 AND supplier_ask > 0 AND gap > 0.25 THEN 'CHALLENGE_INCREASE' WHEN gap >= 2 THEN 'HIGH_CHALLENGE' WHEN gap >= 1 THEN 'REQUEST_EVIDENCE' WHEN gap > 0.25 THEN 'CLARIFY_SMALL_GAP' WHEN abs(gap) <= 0.25 THEN 'CONDITIONAL_REVIEW' ELSE 'SUPPLIER_BELOW_MODEL' END ELSE verdict END AS verdict FROM reviewed""", *REVIEW_PARTS))
def rule_table_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by tables of rules, stricter ones for every second line."""
    rows = shouldcost.estimates(X.quotes(spark, d))
    rows = rows.withColumns({"invalid": shouldcost.invalid_reason().isNotNull().cast("int"), "strictness": F.when(F.col("l_linenumber") % 2 == 0, "strict").otherwise("default")})
    table = rules.rule_table(spark, default=rules.verdict_rules(), strict=rules.verdict_rules(STRICT))
    return rules.decided(rows, table, rules.VERDICT_MEASURES, "verdict", "strictness").select(*X.QUOTE_KEYS, "verdict")


@query(X.sql(f"""SELECT {KEYS}, 'estimate = ' || {" || ' + ' || ".join(f"'(' || {_fixed(c + '_ratio', 2)} || '% x ' || {_fixed(c + '_rate', 2)} || '%)'" for c in shouldcost.COMPONENTS)} || ' = ' || {_fixed("estimate", 2)} || '%; new price = ' || {_fixed("price", 2)}
  || ' x (1 + ' || {_fixed("estimate / 100", 4)} || ') = ' || {_fixed("new_price", 2)} || '; base ratios = ' || {" || ' + ' || ".join(f"{_fixed(c + '_ratio', 2)} || '%'" for c in shouldcost.BASE)} || ' = ' || {_fixed("base_ratio_sum", 1)} || '%' AS formula FROM reviewed""", *REVIEW_PARTS))
def quote_formula(spark: SparkSession, d: str) -> DataFrame:
    return shouldcost.estimates(X.quotes(spark, d)).select(*X.QUOTE_KEYS, shouldcost.formula_text().alias("formula"))


@query(X.sql("SELECT l_suppkey, verdict, count(*) AS n, round(CAST(sum(CAST(unexplained AS DECIMAL(28,6))) AS DOUBLE), 2) AS unexplained, CAST(sum(CAST(gap AS DECIMAL(28,6))) AS DOUBLE) / count(gap) AS mean_gap FROM reviewed WHERE verdict <> 'INVALID' GROUP BY CUBE (l_suppkey, verdict)", *REVIEW_PARTS))
def verdict_rollup(spark: SparkSession, d: str) -> DataFrame:
    return shouldcost.verdict_rollup(_reviewed(spark, d), "l_suppkey", "verdict")


@query(X.sql(f"""SELECT {KEYS}, material_id, carried, carried_period, carried IS NOT NULL AND abs(mat_rate - carried) > 1e-6 AS overridden, round(mat_ratio * mat_rate / 100, 6) AS mat_impact,
  CASE WHEN carried IS NULL THEN 'rate entered by hand, not linked to a signal' WHEN abs(mat_rate - carried) > 1e-6 THEN 'market record: ' || material_id || ' | c6 | ' || {_fixed("carried", 2)} || '% | ' || carried_period || '; rate edited since'
    ELSE 'market data: ' || material_id || ' | c6 | ' || {_fixed("carried", 2)} || '% | ' || carried_period END AS market_context
  FROM (SELECT q.*, material_id, floor(c6 * 100 + 0.5) / 100 AS carried, period AS carried_period, CASE WHEN l_linenumber = 1 OR c6 IS NULL THEN mat_rate0 ELSE floor(c6 * 100 + 0.5) / 100 END AS mat_rate
    FROM (SELECT * EXCLUDE (mat_rate), mat_rate AS mat_rate0 FROM quotes) q JOIN (SELECT p_partkey, p_brand AS material_id FROM part) ON l_partkey = p_partkey LEFT JOIN latest USING (material_id))""", X.FX4, *SIGNAL_PARTS))
def carry_rate(spark: SparkSession, d: str) -> DataFrame:
    brand = X.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("material_id"))
    quotes = X.quotes(spark, d).join(brand, "l_partkey")
    edited = F.when(F.col("l_linenumber") == 1, F.col("mat_rate")).otherwise(F.coalesce("carried", "mat_rate"))
    rows = shouldcost.with_carried_rate(quotes, _latest(spark, d), "c6", edited)
    return rows.select(*X.QUOTE_KEYS, "material_id", "carried", "carried_period", "overridden", F.round(F.col("mat_ratio") * F.col("mat_rate") / 100, 6).alias("mat_impact"), "market_context")


@query(X.sql(f"SELECT {KEYS}, component, ratio, rate, round(impact, 6) AS impact FROM (" + " UNION ALL ".join(f"SELECT {KEYS}, '{report.LABELS[c]}' AS component, {c}_ratio AS ratio, {c}_rate AS rate, {c}_impact AS impact FROM reviewed" for c in shouldcost.COMPONENTS) + ")", *REVIEW_PARTS))
def cost_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.cost_rows(_reviewed(spark, d), *X.QUOTE_KEYS), "impact")


#: Of the report's rows: section, field, value and unit, in SQL.
UNIT = "coalesce(nullif(price_unit, ''), 'calculator unit')"
REPORT_ROWS = [("section", "field", "'value'", "'unit'"), ("document", "name", "'supplier price review'", "''"), ("document", "generated_at", "''", "''")]
REPORT_ROWS += [("case", c, c, "''") for c in ("supplier", "product", "quote_ref", "quote_date", "buyer", "price_unit")]
REPORT_ROWS += [("market", "context", "'not linked to a signal'", "'primary source; second source is a cross-check'")]
REPORT_ROWS += [("result", c, _plain(c), u) for c, u in (("price", UNIT), ("supplier_ask", "'%'"), ("estimate", "'%'"), ("gap", "'points'"), ("unexplained", UNIT), ("new_price", UNIT), ("requested_price", UNIT))]
REPORT_ROWS += [("cost", f"{n} {x}", _plain(f"{c}_{x}"), "'points'" if x == "impact" else "'%'") for c, n in report.LABELS.items() for x in ("ratio", "rate", "impact")]
REPORT_ROWS += [("verdict", "code", "verdict", "'decision support'"), ("verdict", "tone", "tone", "''"), ("verdict", "gap_text", GAP_TEXT, "''"), ("verdict", "evidence", EVIDENCE, "''")]
REPORT_ROWS += [("supplier", "supplier_reason", "supplier_reason", "''"), ("supplier", "evidence_received", "''", "''"), ("purchase", "conclusion", "''", "''"), ("purchase", "target_rate", f"coalesce({_plain('target_rate')}, '')", "'%'"), ("purchase", "note", "note", "''")]
REPORT_ROWS += [("policy", "automatic decision", "'no'", "'a material''s rise is not the product''s'")]
CASES = f"""cases AS (SELECT *, {X.CASE_SQL} FROM reviewed), valid_cases AS (SELECT *, CASE WHEN verdict = 'REQUEST_DEEPER_REDUCTION' THEN CASE WHEN gap >= 3 THEN 'high' ELSE 'medium' END WHEN verdict IN ('REQUEST_REDUCTION', 'CHALLENGE_INCREASE', 'HIGH_CHALLENGE') THEN 'high'
  WHEN verdict IN ('REQUEST_EVIDENCE', 'CLARIFY_SMALL_GAP') THEN 'medium' WHEN verdict = 'CONDITIONAL_REVIEW' THEN 'balanced' ELSE 'favorable' END AS tone FROM cases WHERE verdict <> 'INVALID' AND coalesce(target_rate, 0) >= -100)"""


def _cases(spark, d):
    return X.cases(shouldcost.reviewed(X.quotes(spark, d, dealt=True))).withColumns({"evidence": shouldcost.verdict_evidence(), "gap_text": shouldcost.gap_text()})


@query(X.sql(f"SELECT {KEYS}, md5(concat_ws(chr(10), " + ", ".join(f"'{s}|{f}|' || {v} || '|' || {u}" for s, f, v, u in REPORT_ROWS) + ")) AS report_md5 FROM valid_cases", *REVIEW_PARTS, CASES))
def report_long(spark: SparkSession, d: str) -> DataFrame:
    """All 42 report rows of each valid quote, as a digest of their cells."""
    snapshots = report.snapshots(_cases(spark, d), *X.QUOTE_KEYS)
    rows = report.report_text(snapshots, *X.QUOTE_KEYS, line=lambda r: [f"{r.section}|{r.field}|", r.value(places=6), "|", r.unit], sep="\n")
    return rows.select(*X.QUOTE_KEYS, F.md5(F.col("text").cast("binary")).alias("report_md5"))


@query(X.sql(f"SELECT {KEYS}, CASE WHEN verdict = 'INVALID' THEN invalid_reason WHEN target_rate < -100 THEN 'target_rate' END AS reason, coalesce(nullif(supplier, ''), 'not given') AS supplier, coalesce(nullif(product, ''), 'not given') AS product, 'not given' AS evidence_received, 'waiting for the supplier''s documents' AS conclusion, {UNIT} AS price_unit, CASE WHEN target_rate IS NULL THEN 'not given' ELSE {_signed('target_rate', 2)} || '%' END AS target_rate, 'not linked to a signal' AS market_context FROM cases", *REVIEW_PARTS, CASES))
def report_shown(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of each quote's report sees in its header fields, with the reason if there is none to export."""
    return report.shown(report.snapshots(_cases(spark, d), *X.QUOTE_KEYS)).select(*X.QUOTE_KEYS, "reason", "supplier", "product", "evidence_received", "conclusion", "price_unit", "target_rate", "market_context")


# exports


@query(X.sql("""SELECT material_id, period, concat_ws(',', '"' || material_id || '"', '"' || material_id || '"', '"' || period || '"', {shown}, CASE WHEN index_mode THEN '"index (first = 100)"' ELSE '"price"' END,
  CASE WHEN index_mode THEN '"—"' ELSE '"USD"' END, CASE WHEN index_mode THEN '"index points"' ELSE '"' || display_unit || '"' END, '"' || primary_unit || '"', '"primary"', '"no"', '"monthly"', '"latest"', '"-"') AS line
  FROM view_ JOIN materials USING (material_id)""", X.FX1, X.FX3, SLICE).replace("'\"-\"'", "'\"''-\"'").replace("{shown}", _fixed("shown", 4)))
def csv_price_lines(spark: SparkSession, d: str) -> DataFrame:
    return csv_export.price_lines(_view(spark, d).drop("mno"), X.materials(spark, d), "primary", "latest", "-")


@query(X.sql("""SELECT material_id, period, concat_ws(',', '"' || material_id || '"', '"' || material_id || '"', '"' || period || '"', {numbers}, '"' || primary_unit || '"', '"' || comparison_unit || '"', '""', '"primary"', '"comparison"', '"no"') AS line
  FROM (SELECT * FROM compared QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY period DESC) <= 12) JOIN materials USING (material_id)""", *COMPARE_PARTS).replace("{numbers}", ", ".join(_fixed(c, 6) for c in ("primary_value", "comparison_value", "diff", "diff_pct"))))
def csv_compare_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.last_rows(compare.compared(*_two_sources(spark, d)))
    return csv_export.compare_lines(rows, X.materials(spark, d)).select("material_id", "period", "line")


def _csv_cell(section: str, field: str, value: str) -> str:
    if section in ("result", "cost") or field == "target_rate":
        return f"CASE WHEN {value} = '' THEN '\"\"' ELSE {value} END"
    guarded = f"CASE WHEN regexp_matches({value}, '^[=+\\-@]') THEN '''' || {value} ELSE {value} END" if field in report.FREE_TEXT else value
    return f"'\"' || replace({guarded}, '\"', '\"\"') || '\"'"


@query(X.sql(f"SELECT {KEYS}, md5(concat_ws(chr(13) || chr(10), " + ", ".join(f"'\"{s}\",\"{f}\",' || {_csv_cell(s, f, v)} || ',\"' || {u} || '\"'" for s, f, v, u in REPORT_ROWS) + ")) AS file_md5 FROM valid_cases", *REVIEW_PARTS, CASES))
def csv_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The CSV file of each valid quote's report, as a digest."""
    rows = csv_export.report_files(report.snapshots(_cases(spark, d), *X.QUOTE_KEYS), *X.QUOTE_KEYS)
    return rows.select(*X.QUOTE_KEYS, F.md5(F.col("text").cast("binary")).alias("file_md5"))


@query(X.sql("SELECT material_id, period, value FROM obs_primary", X.FX1))
def json_document(spark: SparkSession, d: str) -> DataFrame:
    """The observations after a round through nested JSON documents."""
    doc = documents.document(X.obs_primary(spark, d), "primary", parts=4)
    parsed = doc.select(F.from_json("value", documents.DOCUMENT).alias("j"))
    rows = parsed.select(F.explode("j.series").alias("material_id", "s")).select("material_id", F.explode("s.observations").alias("o"))
    return rows.select("material_id", "o.period", "o.value")


# nested documents of three kinds, written as files and read back

CONFIG = """config AS (SELECT *, CASE WHEN mno % 6 <> 0 THEN 'Brand ' || mno END AS name, 'Marke ' || mno AS local_name, mno % 2 = 0 AS is_derived, CASE WHEN mno % 4 = 0 THEN 'by license' END AS attribution, 'S' || mno AS series_id, 100 - mno AS ord FROM materials)"""


def _config(spark, d):
    """Materials with the names, flags and order that a configuration gives them; some are left out or empty."""
    mno = F.col("mno")
    return X.materials(spark, d).withColumns(
        {
            "name": F.when(mno % 6 == 0, " ").otherwise(F.concat(F.lit(" Brand "), mno)),
            "local_name": F.concat(F.lit("Marke "), mno),
            "source_unit": F.col("primary_unit"),
            "is_derived": F.when(mno % 2 == 0, True),
            "attribution": F.when(mno % 4 == 0, "by license"),
            "series_id": F.concat(F.lit("S"), mno),
            "ord": 100 - mno,
        }
    )


def _through_files(spark, kind, entries, head, parts):
    """The documents of a run, read back from its files."""
    place = X.scratch(spark)
    return nested.read_run(kind, spark, place, nested.publish(kind, entries, head, "2026-07-02T08:00:00Z", place, parts))


@query(X.sql("""SELECT material_id, coalesce(name, material_id) AS name, local_name, currency, display_unit, coalesce(name, material_id) AS source_column, primary_unit AS source_unit, is_derived, attribution, count(*) OVER s AS n_obs,
  min(period) OVER s AS first_period, max(period) OVER s AS latest_period, period, value, max(period) OVER () AS top_latest, count(*) OVER () AS n_all, (SELECT count(DISTINCT material_id) FROM obs_primary) AS n_series, 'primary' AS source
  FROM obs_primary JOIN config USING (material_id) WINDOW s AS (PARTITION BY material_id)""", X.FX1, X.FX3, CONFIG))
def source_document(spark: SparkSession, d: str) -> DataFrame:
    entries = nested.source_entries(X.stored(X.obs_primary(spark, d)), _config(spark, d))
    docs = _through_files(spark, nested.SOURCE, entries, lambda e: nested.source_head(e, "primary"), 4)
    rows = docs.select("source", F.col("dataset.latestPeriod").alias("top_latest"), F.col("dataset.observationCount").alias("n_all"), F.col("dataset.seriesCount").alias("n_series"), F.explode("series").alias("material_id", "e"))
    names = {"name": "name", "local_name": "localName", "currency": "currency", "display_unit": "displayUnit", "source_column": "sourceColumn", "source_unit": "sourceUnit", "is_derived": "isDerived", "attribution": "attribution", "n_obs": "observationCount", "first_period": "firstPeriod", "latest_period": "latestPeriod"}
    return rows.select("source", "top_latest", "n_all", "n_series", "material_id", *[F.col(f"e.{v}").alias(k) for k, v in names.items()], F.explode("e.observations").alias("o")).select("*", "o.period", "o.value").drop("o")


@query(X.sql("""SELECT material_id, coalesce(name, material_id) AS name, primary_latest, display_unit, primary_unit, series_id, comparison_latest, comparison_unit, n_common, first_common, last_common, comparable, reason, latest_primary, latest_comparison,
  latest_diff_pct, mean_abs_pct, max_abs_pct, period, primary_value, comparison_value, diff, diff_pct, count(*) FILTER (first_row) OVER () AS n_materials, count(*) FILTER (first_row AND comparable) OVER () AS n_comparable
  FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY period) = 1 AS first_row FROM (SELECT p.material_id, min(period) AS first_common, max(period) AS last_common, count(*) AS n_common, arg_max(p.value, period) AS latest_primary, arg_max(c.value, period) AS latest_comparison FROM obs_primary p JOIN obs_comparison c USING (material_id, period) GROUP BY 1)
  JOIN compatible USING (material_id) JOIN config USING (material_id) JOIN (SELECT material_id, max(period) AS primary_latest FROM obs_primary GROUP BY 1) USING (material_id) JOIN (SELECT material_id, max(period) AS comparison_latest FROM obs_comparison GROUP BY 1) USING (material_id)
  LEFT JOIN (SELECT material_id, latest_diff_pct, mean_abs_pct, max_abs_pct FROM summary) USING (material_id) LEFT JOIN compared USING (material_id))""", *COMPARE_PARTS, CONFIG))
def comparison_document(spark: SparkSession, d: str) -> DataFrame:
    p, c, compatible = _two_sources(spark, d, X.stored(X.obs_primary(spark, d)))
    entries = nested.comparison_entries(p, c, compatible, _config(spark, d))
    docs = _through_files(spark, nested.COMPARISON, entries, lambda e: nested.comparison_head(e, "primary", "comparison"), 3)
    rows = docs.select(F.col("summary.materialCount").alias("n_materials"), F.col("summary.comparableCount").alias("n_comparable"), F.explode("materials").alias("material_id", "e"))
    names = {"name": "name", "primary_latest": "primary.latestPeriod", "display_unit": "primary.displayUnit", "primary_unit": "primary.sourceUnit", "series_id": "comparison.seriesId", "comparison_latest": "comparison.latestPeriod", "comparison_unit": "comparison.sourceUnit", "n_common": "overlapCount", "first_common": "firstOverlapPeriod", "last_common": "latestOverlapPeriod", "comparable": "comparisonAvailable", "reason": "comparisonReason", "latest_primary": "latestPrimaryValue", "latest_comparison": "latestComparisonValue", "latest_diff_pct": "latestDifferencePercent", "mean_abs_pct": "meanAbsolutePercent", "max_abs_pct": "maxAbsolutePercent"}
    rows = rows.select("n_materials", "n_comparable", "material_id", *[F.col(f"e.{v}").alias(k) for k, v in names.items()], F.explode_outer("e.observations").alias("o"))
    return rows.select("*", "o.period", F.col("o.primaryValue").alias("primary_value"), F.col("o.comparisonValue").alias("comparison_value"), F.col("o.difference").alias("diff"), F.col("o.differencePercent").alias("diff_pct")).drop("o")


@query(X.sql(f"""SELECT material_id, coalesce(g.name, material_id) AS name, g.display_unit, g.primary_unit AS source_unit, period, round(value, 6) AS value, c1, c3, c6, c12, round(avg12, 6) AS avg12, round(high12, 6) AS high12, round(low12, 6) AS low12, round(vs_avg12, 6) AS vs_avg12,
  round(range_position, 6) AS range_position, range_label, round(volatility, 6) AS volatility, trend, signal, priority, signal_group, {_case('signal', {k: v[1] for k, v in signals.ADVICE.items()})} AS action,
  CASE WHEN c.comparable IS NULL THEN 'NOT_AVAILABLE' WHEN NOT c.comparable THEN 'UNIT_NOT_COMPARABLE' WHEN mean_abs_pct <= 1 AND abs(latest_diff_pct) <= 1 THEN 'HIGH_AGREEMENT' WHEN mean_abs_pct <= 3 AND abs(latest_diff_pct) <= 3 THEN 'MEDIUM_AGREEMENT' ELSE 'REVIEW_REQUIRED' END AS corroboration,
  latest_diff_pct, mean_abs_pct, concat_ws(chr(10), '3-month change ' || {_signed("c3", 2)} || '%', '6-month change ' || {_signed("c6", 2)} || '%', 'latest against the 12-month average ' || {_signed("vs_avg12", 2)} || '%', 'at ' || {_fixed("range_position", 1)} || '% of the 12-month range') AS lines,
  2 AS n_limitations, max(period) OVER () AS top_latest, count(*) FILTER (priority = 'HIGH') OVER () AS n_high, count(*) OVER () AS n_materials, count(*) OVER (PARTITION BY signal) AS n_same_signal
  FROM latest JOIN config g USING (material_id) LEFT JOIN (SELECT material_id, comparable FROM compatible WHERE material_id IN (SELECT material_id FROM obs_comparison)) c USING (material_id) LEFT JOIN (SELECT material_id, latest_diff_pct, mean_abs_pct FROM summary) s USING (material_id)""", X.FX1, X.FX2, X.FX3, CHANGES, STATS, SIGNALS, COMPATIBLE, COMPARED, CONFIG))
def signals_document(spark: SparkSession, d: str) -> DataFrame:
    p = X.stored(X.obs_primary(spark, d))
    entries = nested.signal_entries(signals.latest_signals(p), compare.full_summary(*_two_sources(spark, d, p)), _config(spark, d))
    docs = _through_files(spark, nested.SIGNALS, entries, lambda e: nested.signals_head(e, "primary", "comparison"), 3)
    rows = docs.select("latestPeriod", "summary", F.explode("materials").alias("material_id", "e"))
    c = lambda path, name: F.col(path).alias(name)
    return rows.select(
        *["material_id", c("e.name", "name"), c("e.displayUnit", "display_unit"), c("e.sourceUnit", "source_unit"), c("e.latestPeriod", "period"), c("e.latestValue", "value")],
        *[c(f"e.changes.{a}MonthPercent", b) for a, b in (("one", "c1"), ("three", "c3"), ("six", "c6"), ("twelve", "c12"))],
        *[c(f"e.statistics.{a}", b) for a, b in (("average", "avg12"), ("high", "high12"), ("low", "low12"), ("latestVsAveragePercent", "vs_avg12"), ("rangePositionPercent", "range_position"), ("positionLabel", "range_label"), ("volatilityPercent", "volatility"))],
        *[c("e.trend", "trend"), c("e.signal.code", "signal"), c("e.signal.priority", "priority"), c("e.signal.group", "signal_group"), c("e.signal.action", "action")],
        *[c("e.corroboration.status", "corroboration"), c("e.corroboration.latestDifferencePercent", "latest_diff_pct"), c("e.corroboration.meanAbsolutePercent", "mean_abs_pct")],
        *[F.array_join("e.evidence", "\n").alias("lines"), F.size("e.limitations").alias("n_limitations"), c("latestPeriod", "top_latest"), F.col("summary.priorityCounts")["HIGH"].alias("n_high"), c("summary.materialCount", "n_materials"), F.col("summary.signalCounts")[F.col("e.signal.code")].alias("n_same_signal")],
    )


@query(X.sql("SELECT material_id, coalesce(name, material_id) AS name, is_derived, attribution, ord, CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS place, latest_period, n_obs FROM config JOIN (SELECT material_id, max(period) AS latest_period, count(*) AS n_obs FROM obs_primary GROUP BY 1) USING (material_id)", X.FX1, X.FX3, CONFIG))
def configured_order(spark: SparkSession, d: str) -> DataFrame:
    """The headers of all series in the order of the configuration, with their place in it."""
    listed = series.in_order(ingest.full_header(X.obs_primary(spark, d), _config(spark, d)))
    return listed.select("material_id", "name", "is_derived", "attribution", "ord", "place", "latest_period", "n_obs")


# data quality


def _sourced(spark, d):
    p = X.obs_primary(spark, d)
    row = lambda df, s: df.select(F.lit(s).alias("source"), "material_id", "period", "value")
    return row(p, "primary").unionByName(row(X.obs_comparison(p), "comparison"))


SOURCED = "sourced AS (SELECT 'primary' AS source, material_id, mno, mi, period, value FROM obs_primary UNION ALL SELECT 'comparison', material_id, mno, 0, period, value FROM obs_comparison)"
#: Faults planted in the primary source: some rows read in the wrong order, repeated, malformed or negative.
FAULTY = """faulty AS (SELECT 'primary' AS source, material_id, CASE WHEN mno = 3 AND mi % 10 = 0 THEN replace(period, '-', '') ELSE period END AS period,
  CASE WHEN mno = 4 AND mi % 9 = 0 THEN -value WHEN mno = 5 AND mi % 20 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value, CASE WHEN mno = 6 AND mi % 8 = 0 THEN mi - 2.5 ELSE mi END AS ingest_ord FROM obs_primary
  UNION ALL SELECT 'primary', material_id, period, value, mi + 0.5 FROM obs_primary WHERE mno = 8 AND mi % 7 = 0)"""
FAULT_PARTS = (X.FX1, FAULTY)


def _faulty(spark, d):
    p = X.obs_primary(spark, d)
    mno, mi, nan = F.col("mno"), F.col("mi"), F.lit(float("nan"))
    period = F.when((mno == 3) & (mi % 10 == 0), F.replace("period", F.lit("-"), F.lit(""))).otherwise(F.col("period"))
    value = F.when((mno == 4) & (mi % 9 == 0), -F.col("value")).when((mno == 5) & (mi % 20 == 0), nan).otherwise(F.col("value"))
    order = F.when((mno == 6) & (mi % 8 == 0), mi - 2.5).otherwise(mi.cast("double"))
    rows = p.select(F.lit("primary").alias("source"), "material_id", period.alias("period"), value.alias("value"), order.alias("ingest_ord"))
    again = p.where((mno == 8) & (mi % 7 == 0)).select(F.lit("primary").alias("source"), "material_id", "period", "value", (mi + 0.5).alias("ingest_ord"))
    return rows.unionByName(again)


def _violation_sql(rule: str, sample: str, rows: str) -> str:
    return f"SELECT '{rule}' AS rule_id, source, material_id AS series_id, count(*) AS n_bad, min(CAST({sample} AS VARCHAR)) AS sample FROM ({rows}) GROUP BY 2, 3"


@query(X.sql(_violation_sql("order", "period", "SELECT *, lag(period) OVER (PARTITION BY source, material_id ORDER BY ingest_ord) AS before FROM faulty QUALIFY before > period"), *FAULT_PARTS))
def dq_order(spark: SparkSession, d: str) -> DataFrame:
    return quality.out_of_order(_faulty(spark, d))


@query(X.sql(_violation_sql("duplicate_period", "period", "SELECT source, material_id, period FROM faulty GROUP BY 1, 2, 3 HAVING count(*) > 1"), *FAULT_PARTS))
def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(_faulty(spark, d))


@query(X.sql(_violation_sql("period_format", "period", "SELECT * FROM faulty WHERE NOT regexp_matches(period, '^[0-9]{4}-(0[1-9]|1[0-2])$')") + " UNION ALL " + _violation_sql("value", "period", "SELECT * FROM faulty WHERE NOT (isfinite(value) AND value > 0)"), *FAULT_PARTS))
def dq_format_value(spark: SparkSession, d: str) -> DataFrame:
    rows = _faulty(spark, d)
    return quality.all_violations(quality.bad_format(rows), quality.bad_value(rows))


@query(X.sql(_violation_sql("min_observations", "n", "SELECT source, material_id, count(*) AS n FROM sourced GROUP BY 1, 2 HAVING count(*) < 80"), X.FX1, X.FX2, SOURCED))
def dq_min_obs(spark: SparkSession, d: str) -> DataFrame:
    return quality.min_observations(_sourced(spark, d), 80)


@query(X.sql(_violation_sql("freshness", "latest", "SELECT *, max(latest) OVER (PARTITION BY source) AS top FROM (SELECT source, material_id, max(period) AS latest FROM sourced GROUP BY 1, 2) QUALIFY latest < top"), X.FX1, X.FX2, SOURCED))
def dq_freshness(spark: SparkSession, d: str) -> DataFrame:
    return quality.stale_series(_sourced(spark, d))


@query(X.sql(_violation_sql("completeness", "period", "SELECT 'signals' AS source, material_id, period FROM changes WHERE c12 IS NULL OR c1 IS NULL OR least(c1, c3, c6, c12) < -100"), X.FX1, CHANGES))
def dq_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Rows of short history lack a change; all others pass."""
    return quality.incomplete_signals(series.with_changes(X.obs_primary(spark, d)))


@query(X.sql(_violation_sql("id_set", "side", "SELECT 'comparison' AS source, material_id, 'missing' AS side FROM materials WHERE material_id NOT IN (SELECT material_id FROM obs_comparison)") + " UNION ALL " + _violation_sql("missing_series", "material_id", "SELECT 'comparison' AS source, material_id FROM (SELECT material_id FROM materials WHERE material_id NOT IN (SELECT material_id FROM obs_comparison))"), X.FX1, X.FX2, X.FX3))
def dq_idset(spark: SparkSession, d: str) -> DataFrame:
    rows, m = _sourced(spark, d), X.materials(spark, d)
    return quality.all_violations(quality.id_set_difference(rows, m, "comparison"), quality.missing_series(rows, m, "comparison"))


@query(X.sql("""SELECT 'signals_behind' AS rule_id, 'primary' AS source, '*' AS series_id, CAST(1 AS BIGINT) AS n_bad, (SELECT max(period) FROM obs_primary WHERE mi < 23980) || '/' || (SELECT max(period) FROM obs_primary) AS sample
  UNION ALL SELECT 'policy', source, material_id, CAST(1 AS BIGINT), sample FROM (SELECT *, CASE WHEN mno % 2 = 0 THEN 'primary' ELSE 'comparison' END AS source FROM materials) JOIN (VALUES ('not real'), ('fallback'), ('source name'), ('primary source')) t(sample)
    ON CASE sample WHEN 'not real' THEN mno % 3 = 0 WHEN 'fallback' THEN mno % 5 = 0 WHEN 'source name' THEN mno % 2 = 0 AND mno % 4 = 0 ELSE mno % 7 = 0 END""", X.FX1, X.FX3))
def dq_policy(spark: SparkSession, d: str) -> DataFrame:
    """Signals older than the status table says, and documents that break the policy in each way."""
    p, mno = X.obs_primary(spark, d), F.col("mno")
    state = p.agg(F.lit("primary").alias("source"), F.max("period").alias("latest_period"))
    papers = X.materials(spark, d).select(
        F.when(mno % 2 == 0, "primary").otherwise("comparison").alias("source"),
        "material_id",
        F.when(mno % 4 == 0, "another").otherwise("OFFICIAL").alias("source_name"),
        F.when(mno % 7 == 0, None).otherwise("OFFICIAL").alias("primary_source"),
        (mno % 3 != 0).alias("is_real"),
        F.when(mno % 5 != 0, False).alias("automatic_fallback"),
    )
    return quality.all_violations(quality.freshness_mismatch(p.where("mi < 23980"), state), quality.policy_violations(papers, "OFFICIAL"))


@query(X.sql("""SELECT 'no_overlap' AS rule_id, 'comparison' AS source, material_id AS series_id, CAST(1 AS BIGINT) AS n_bad, material_id AS sample FROM (SELECT DISTINCT material_id FROM obs_comparison WHERE mno % 8 = 3)
  UNION ALL SELECT 'zero_base', 'primary', material_id, count(*), min(period) FROM obs_primary JOIN obs_comparison c USING (material_id, period) WHERE obs_primary.mno % 8 <> 3 AND mi % 30 = 0 GROUP BY material_id""", X.FX1, X.FX2))
def dq_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Some series of the comparison source are of other years; some primary values are 0."""
    p = X.obs_primary(spark, d)
    c = X.obs_comparison(p).withColumns({"source": F.lit("comparison"), "period": F.when(F.col("mno") % 8 == 3, F.concat(F.lit("3"), F.substring("period", 2, 6))).otherwise(F.col("period"))})
    return quality.overlap_gate(p.withColumn("value", F.when(F.col("mi") % 30 == 0, 0.0).otherwise(F.col("value"))), c)


@query("""SELECT p_brand AS material_id, CASE WHEN m % 7 = 0 OR m % 5 = 1 THEN 'version or purpose' WHEN m % 4 = 0 OR m % 9 = 2 THEN 'thresholds' WHEN m % 3 = 0 OR m % 10 = 5 THEN 'policy' END AS problem
  FROM (SELECT DISTINCT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INT) AS m FROM part)""")
def cost_rule_problems(spark: SparkSession, d: str) -> DataFrame:
    """A set of cost rules for each brand, many of them wrong."""
    mno, no = F.col("mno"), F.lit(False)
    rules = X.materials(spark, d).select(
        "material_id",
        F.when(mno % 7 == 0, 2).otherwise(1).alias("version"),
        F.when(mno % 5 == 1, None).otherwise(True).alias("decision_support_only"),
        F.when(mno % 9 == 2, float("nan")).otherwise(0.5).alias("match"),
        F.when(mno % 4 == 0, 0.5).otherwise(1.5).alias("evidence"),
        F.lit(3.0).alias("challenge"),
        no.alias("automatic_acceptance"),
        (mno % 3 == 0).alias("automatic_rejection"),
        no.alias("material_equals_product"),
        F.when(mno % 10 == 5, "PRIMARY").otherwise(shouldcost.SECOND_SOURCE_ROLE).alias("second_source_role"),
    )
    return rules.select("material_id", shouldcost.rule_problem().alias("problem"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN -o_orderkey WHEN 2 THEN o_orderkey + CAST(0.5 AS DOUBLE) END AS number, o_orderkey % 6 < 3 AND (o_orderkey % 6 <> 1 OR o_orderkey <= 100) OR o_orderkey % 6 = 5 AS valid_target FROM orders""")
def form_fields(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as people type them, and whether they may be target rates (a field that is missing may)."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    raw = F.when(key % 6 == 0, "  ").when(key % 6 == 1, F.concat(F.lit(" -"), text)).when(key % 6 == 2, F.concat(text, F.lit(".5 "))).when(key % 6 == 3, F.concat(text, F.lit("abc"))).when(key % 6 == 4, "Infinity")
    rows = X.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), F.when(raw.isNotNull(), S.form_number(raw)).alias("number"))
    return rows.select("o_orderkey", "number", (F.when(F.col("raw").isNull(), shouldcost.valid_target(F.col("number"))).otherwise(F.col("number").isNotNull() & shouldcost.valid_target(F.col("number")))).alias("valid_target"))


@query(X.sql(" UNION ALL ".join([
    _violation_sql("order", "period", "SELECT *, lag(period) OVER (PARTITION BY source, material_id ORDER BY ingest_ord) AS before FROM faulty QUALIFY before > period"),
    _violation_sql("duplicate_period", "period", "SELECT source, material_id, period FROM faulty GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    _violation_sql("period_format", "period", "SELECT * FROM faulty WHERE NOT regexp_matches(period, '^[0-9]{4}-(0[1-9]|1[0-2])$')"),
    _violation_sql("value", "period", "SELECT * FROM faulty WHERE NOT (isfinite(value) AND value > 0)"),
    _violation_sql("min_observations", "n", "SELECT source, material_id, count(*) AS n FROM faulty GROUP BY 1, 2 HAVING count(*) < 84"),
    _violation_sql("freshness", "latest", "SELECT *, max(latest) OVER (PARTITION BY source) AS top FROM (SELECT source, material_id, max(period) AS latest FROM faulty GROUP BY 1, 2) QUALIFY latest < top"),
]), *FAULT_PARTS))
def dq_scan(spark: SparkSession, d: str) -> DataFrame:
    """All rules of single series from one scan."""
    return quality.scan(_faulty(spark, d), 84)


@query(X.sql(" UNION ALL ".join([
    _violation_sql("order", "period", "SELECT *, lag(period) OVER (PARTITION BY source, material_id ORDER BY ingest_ord) AS before FROM faulty QUALIFY before > period"),
    _violation_sql("duplicate_period", "period", "SELECT source, material_id, period FROM faulty GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    _violation_sql("period_format", "period", "SELECT * FROM faulty WHERE NOT regexp_matches(period, '^[0-9]{4}-(0[1-9]|1[0-2])$')"),
    _violation_sql("value", "period", "SELECT * FROM faulty WHERE NOT (isfinite(value) AND value > 0)"),
]), *FAULT_PARTS))
def stream_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates over a stream of files that land in three lots, each taken up by a run that goes on where the last ended."""
    place, rows = X.scratch(spark), X.stored(_faulty(spark, d))
    for low, high in ((0, 23940), (23940, 23970), (23970, 1 << 30)):
        rows.where((F.col("ingest_ord") >= low) & (F.col("ingest_ord") < high)).write.mode("append").parquet(f"{place}/landing")
        gates.run(spark, f"{place}/landing", f"{place}/violations", f"{place}/state").awaitTermination()
    return gates.totals(spark, f"{place}/violations")


@query(X.sql("SELECT material_id, period, value FROM obs_primary", X.FX1))
def gated_publish(spark: SparkSession, d: str) -> DataFrame:
    """What is published after a clean table and then a faulty one were handed in."""
    place = X.scratch(spark)
    clean = X.stored(X.obs_primary(spark, d).select("material_id", "period", "value"))
    if not status.publish_gated(clean, quality.row_gate(), place) or status.publish_gated(clean.withColumn("value", -F.col("value")), quality.row_gate(), place):
        raise RuntimeError("the gate let the wrong table through")
    return status.published(spark, place)


@query(X.sql("SELECT material_id, count(*) AS n_rows FROM faulty WHERE material_id NOT IN ('Brand#3', 'Brand#4', 'Brand#5') GROUP BY 1", *FAULT_PARTS))
def dq_quarantine(spark: SparkSession, d: str) -> DataFrame:
    rows = _faulty(spark, d)
    good, _ = quality.quarantined(rows, quality.all_violations(quality.bad_format(rows), quality.bad_value(rows)))
    return good.groupBy("material_id").agg(F.count("*").alias("n_rows"))


# cleansing and ingest; raw texts come from the given tables


@query("""WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN '  ' || CAST(l_partkey AS VARCHAR) || ' ' WHEN 1 THEN '1,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '.5' WHEN 2 THEN '…' WHEN 3 THEN '-' WHEN 4 THEN 'N/A' WHEN 5 THEN CAST(-l_partkey AS VARCHAR) WHEN 6 THEN 'NaN' ELSE CAST(l_partkey AS VARCHAR) || 'd' END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN nullif(CAST(l_partkey AS DOUBLE), 0) WHEN 1 THEN CAST(1000 + l_partkey % 1000 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS primary_value,
  CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN nullif(CAST(l_partkey AS DOUBLE), 0) WHEN 1 THEN CAST(1000 + l_partkey % 1000 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS comparison_value FROM raw""")
def clean_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, part = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_partkey").cast("string")
    raw = F.when(k % 8 == 0, F.concat(F.lit("  "), part, F.lit(" "))).when(k % 8 == 1, F.concat(F.lit("1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(".5"))).when(k % 8 == 2, "…").when(k % 8 == 3, "-").when(k % 8 == 4, "N/A").when(k % 8 == 5, (-F.col("l_partkey")).cast("string")).when(k % 8 == 6, "NaN").otherwise(F.concat(part, F.lit("d")))
    rows = X.table(spark, d, "lineitem").select(*X.QUOTE_KEYS, raw.alias("raw"))
    return rows.select(*X.QUOTE_KEYS, S.primary_number(F.col("raw")).alias("primary_value"), S.comparison_number(F.col("raw")).alias("comparison_value"))


@query("SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS raw, strftime(l_shipdate, '%Y-%m') AS from_grid, strftime(l_shipdate, '%Y-%m') AS from_date, CAST(NULL AS VARCHAR) AS bad FROM lineitem")
def clean_periods(spark: SparkSession, d: str) -> DataFrame:
    at = X.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("raw")).distinct()
    grid = F.concat(F.substring("raw", 1, 4), F.lit("M"), F.substring("raw", 6, 2))
    return at.select("raw", S.grid_period(grid).alias("from_grid"), S.date_period(F.col("raw")).alias("from_date"), S.grid_period(F.concat(grid, F.lit("3"))).alias("bad"))


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS normal, left(regexp_replace(regexp_replace(trim(coalesce(source, ''), ' '), '[\\/:*?"<>|]+', '_', 'g'), ' +', '_', 'g'), 40) AS label FROM documents""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", S.normalize_text(F.col("text")).alias("normal"), S.filename_part(F.col("source"), "unnamed").alias("label"))


GRID_PARTS = (X.FX1, X.FX5)


def _aliases(spark, d):
    """Names of each brand's column; every seventh brand has a second name that is another brand's too."""
    m = X.materials(spark, d)
    other = F.when(F.col("mno") % 7 == 0, F.lit("brand 11")).otherwise(F.concat(F.lit("BRAND  "), F.col("mno")))
    return m.select("material_id", F.array(F.concat(F.lit("brand "), "mno"), other).alias("names"))


@query("SELECT p_brand AS material_id, CASE WHEN n = 1 THEN mno END AS col, CAST(n AS BIGINT) AS n_matches FROM (SELECT DISTINCT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INT) AS mno, CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INT) % 7 = 0 THEN 2 ELSE 1 END AS n FROM part)")
def resolve_columns(spark: SparkSession, d: str) -> DataFrame:
    return ingest.resolve_columns(X.cells(spark, d), _aliases(spark, d))


@query(X.sql("SELECT material_id, period, value FROM obs_primary WHERE mno % 7 <> 0 AND (mi + mno) % 17 <> 0", X.FX1))
def melt_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    return ingest.melt_grid(cells, ingest.resolve_columns(cells, _aliases(spark, d))).select("material_id", "period", "value")


@query(X.sql("SELECT DISTINCT material_id, CASE WHEN mno % 5 <> 0 THEN '($/mt)' END AS unit FROM obs_primary WHERE mno % 7 <> 0", X.FX1))
def unit_row(spark: SparkSession, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    return ingest.unit_row(cells, ingest.resolve_columns(cells, _aliases(spark, d)))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated FROM orders")
def updated_on(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("o_orderkey") % 3 == 0, "Updated on February 31, 2026").otherwise(F.concat(F.lit("Data; updated  ON "), F.date_format("o_orderdate", "MMMM dd, yyyy")))
    return X.table(spark, d, "orders").select("o_orderkey", S.updated_on(note).alias("updated"))


@query("""SELECT p_brand AS wanted_id, CASE WHEN n <> 1 THEN 'not exactly one' WHEN m % 5 = 0 THEN 'other id' WHEN m % 3 = 0 THEN 'not monthly' WHEN m % 4 = 1 THEN 'no title or units' END AS problem
  FROM (SELECT p_brand, CAST(replace(p_brand, 'Brand#', '') AS INT) AS m, CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INT) % 11 = 0 THEN 2 ELSE 1 END AS n FROM part GROUP BY 1, 2)""")
def series_metadata(spark: SparkSession, d: str) -> DataFrame:
    m, mno = X.materials(spark, d), F.col("mno")
    one = m.select(F.col("material_id").alias("wanted_id"), F.when(mno % 5 == 0, "other").otherwise(F.col("material_id")).alias("id"), F.when(mno % 4 == 1, "  ").otherwise("title").alias("title"), F.when(mno % 3 == 0, "D").otherwise("M").alias("frequency_short"), F.col("display_unit").alias("units"), F.lit("").alias("seasonal_adjustment"), F.lit(None).cast("string").alias("last_updated"), "mno")
    rows = one.unionByName(one.where("mno % 11 = 0")).drop("mno")
    return ingest.series_metadata(rows).select("wanted_id", "problem")


@query(X.sql("""SELECT material_id AS series_id, CASE WHEN NOT bad THEN period END AS period, CASE WHEN given THEN value END AS value, bad AS bad_date
  FROM (SELECT *, mi % 25 = 0 OR mi % 29 = 0 OR mi % 31 = 0 AS bad, (mi + mno) % 9 <> 0 AND mi % 31 <> 0 AS given FROM obs_primary WHERE mi % 37 <> 0) WHERE bad OR given""", X.FX1))
def api_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observation lists in JSON, where some values are missing, some dates are bad, and some items are empty or null."""
    p, mi = X.obs_primary(spark, d), F.col("mi")
    value = F.when((mi + F.col("mno")) % 9 == 0, ".").otherwise(F.col("value").cast("string"))
    date = F.when(mi % 25 == 0, F.concat(F.lit("x"), "period")).when(mi % 29 == 0, F.concat("period", F.lit("-00"))).when(mi % 2 == 0, F.concat(F.lit(" "), "period", F.lit("-31 "))).otherwise(F.concat("period", F.lit("-01")))
    given = mi % 31 != 0
    item = F.when(mi % 37 != 0, F.struct(F.when(given, date).alias("date"), F.when(given, value).alias("value")))
    text = F.to_json(F.struct(F.collect_list(F.coalesce(F.to_json(item), F.lit("null"))).alias("observations")))
    payload = p.groupBy("material_id").agg(text.alias("j"))
    items = payload.select(F.col("material_id").alias("series_id"), F.explode(F.from_json("j", "observations array<string>")["observations"]).alias("o"))
    return ingest.api_observations(items.select("series_id", F.when(F.col("o") != "null", F.from_json("o", "date string, value string")).alias("item")))


@query(X.sql("""SELECT material_id AS series_id, CASE WHEN mno % 12 <> 11 THEN CAST(k AS INTEGER) END AS pos, CASE WHEN good_date THEN period END AS period, CASE WHEN shape = 0 AND v IN (0, 1, 2) THEN value END AS value,
  CASE WHEN mno % 12 = 11 THEN 'no list' WHEN shape > 0 THEN 'no object' WHEN NOT good_date THEN 'bad date' WHEN v > 2 THEN 'no value' END AS problem
  FROM (SELECT *, shape = 0 AND mi % 25 <> 0 AND mi % 29 <> 0 AS good_date FROM (SELECT *, CASE mi % 37 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS shape, (mi + mno) % 11 AS v, row_number() OVER (PARTITION BY material_id ORDER BY mi) - 1 AS k FROM obs_primary))
  WHERE mno % 12 <> 11 OR k = 0""", X.FX1).replace("WHEN good_date THEN period", "WHEN good_date AND mno % 12 <> 11 THEN period").replace("WHEN shape = 0 AND v IN", "WHEN mno % 12 <> 11 AND shape = 0 AND v IN"))
def api_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Raw payloads in which some items are texts, numbers, lists or null, some dates are bad or no texts, some values
    are numbers, flags, lists or missing, and some series have no list at all."""
    p, mi, v = X.obs_primary(spark, d), F.col("mi"), (F.col("mi") + F.col("mno")) % 11
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    date = F.when(mi % 25 == 0, quoted(F.concat(F.lit("x"), "period"))).when(mi % 29 == 0, "20240101").otherwise(quoted(F.concat(F.lit(" "), "period", F.lit("-31"))))
    number = F.col("value").cast("string")
    value = F.when(v == 0, number).when(v == 1, quoted(number)).when(v == 2, quoted(F.concat(F.lit(" "), number))).when(v == 3, "true").when(v == 4, "null").when(v == 5, '"."').when(v == 6, "[1]").when(v == 7, "-2").when(v == 8, '"1 000"').when(v == 9, '{"a": 1}').otherwise('"0"')
    item = F.when(mi % 37 == 0, quoted(F.lit("text"))).when(mi % 37 == 1, "7.5").when(mi % 37 == 2, "[1, 2]").when(mi % 37 == 3, "null").otherwise(F.concat(F.lit('{"date": '), date, F.lit(', "value": '), value, F.lit("}")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mi", item.alias("j")))), lambda x: x["j"]), ", ")
    whole = F.when(F.col("mno") % 24 == 11, F.lit("no JSON")).when(F.col("mno") % 24 == 23, F.lit('{"observations": {"date": 1}}')).otherwise(F.concat(F.lit('{"observations": ['), listed, F.lit("]}")))
    payload = p.groupBy("material_id", "mno").agg(whole.alias("payload"))
    return ingest.api_payloads(payload.select(F.col("material_id").alias("series_id"), "payload"))


@query("SELECT page_id, coalesce(regexp_matches(url, '^https://') AND lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) IN ('tionsh.example.net', 'm.ththth.example.org'), false) AS allowed FROM pages")
def url_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").select("page_id", documents.allowed_url(F.col("url"), ["tionsh.example.net", "m.ththth.example.org"]).alias("allowed"))


@query(r"""WITH clean AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script>', '', 'gsi') AS html FROM pages),
hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1, 'i')) AS href, unnest(range(len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1, 'i')))) AS pos FROM clean)
SELECT page_id, CAST(pos AS BIGINT) AS pos, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)', 1), ''), '/') || href END AS absolute FROM hrefs""")
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    return documents.links(X.table(spark, d, "pages")).withColumn("pos", F.col("pos").cast("long"))


@query()
def file_admission(spark: SparkSession, d: str) -> DataFrame:
    """The files of all given tables as landed files."""
    return documents.admitted_at(spark, d, "*.parquet", magic=b"PAR1").select("length", "sha256", "problem")


# status, versions, profiles


@query(X.sql("""SELECT 'comparison' AS source, 'SUCCESS' AS status, '2026-07-02T08:00:00Z' AS last_attempt_at, '2026-07-02T08:00:00Z' AS last_success_at, (SELECT max(period) FROM obs_comparison) AS latest_period, CAST(NULL AS VARCHAR) AS updated_on,
    sha256((SELECT max(period) FROM obs_comparison)) AS sha256, 'https://data.example.org/comparison' AS url, true AS is_stale, 1 AS n_warnings
  UNION ALL SELECT 'primary', 'SUCCESS', '2026-07-02T08:00:00Z', '2026-07-02T08:00:00Z', (SELECT max(period) FROM obs_primary), '2026-07-01', sha256((SELECT max(period) FROM obs_primary)), 'https://data.example.org/primary', false, 0""", X.FX1, X.FX2))
def status_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Both sources refreshed after a status with a stale comparison source."""
    rows = _sourced(spark, d)
    none = {c: F.lit(None).cast("string") for c in ("last_attempt_at", "last_success_at", "updated_on", "sha256", "url")}
    before = rows.groupBy("source").agg(F.min("period").alias("latest_period")).withColumns(none | {"status": F.lit("FAILED"), "is_stale": F.lit(True), "warnings": F.array(F.lit("old"))})

    def run(source: str, **more: str) -> DataFrame:
        last = rows.where(F.col("source") == source).agg(F.max("period").alias("latest_period"))
        told = {"sha256": F.sha2(F.col("latest_period").cast("binary"), 256), "url": F.lit(f"https://data.example.org/{source}")}
        return status.run_record(last.withColumns(told | {k: F.lit(v) for k, v in more.items()}), "2026-07-02T08:00:00Z")

    after = status.comparison_refreshed(status.primary_refreshed(before, run("primary", updated_on="2026-07-01")), run("comparison"))
    return after.select(*[c for c in status.FIELDS if c != "warnings"], F.size("warnings").alias("n_warnings"))


@query(X.sql("""SELECT material_id, period, o.value AS old_value, n.value AS new_value, CASE WHEN o.value IS NULL THEN 'inserted' WHEN n.value IS NULL THEN 'removed' WHEN o.value = n.value THEN 'same' ELSE 'revised' END AS change
  FROM obs_primary o FULL JOIN obs_comparison n USING (material_id, period)""", X.FX1, X.FX2))
def version_revisions(spark: SparkSession, d: str) -> DataFrame:
    p = X.obs_primary(spark, d)
    return status.revisions(p, X.obs_comparison(p))


@query(X.sql("SELECT material_id, period FROM (SELECT material_id, period, value FROM obs_primary EXCEPT SELECT material_id, period, value FROM obs_comparison)", X.FX1, X.FX2))
def unchanged_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose content hash (of series, period and value) an earlier version lacks."""
    p = X.obs_primary(spark, d)
    hashed = lambda df: df.select("material_id", "period", F.sha2(F.concat_ws("|", "material_id", "period", F.col("value").cast("string")).cast("binary"), 256).alias("sha256"))
    return status.new_files(hashed(p), hashed(X.obs_comparison(p))).select("material_id", "period")


# versions and what is kept up to date by them

#: The months as they stood in four versions: some not yet there, some revised later, some taken out again.
VERSIONED = """versioned AS (SELECT v AS version, material_id, period, CASE WHEN (mi + mno) % 5 = 0 AND v < 4 THEN value * 2 WHEN (mi + mno) % 7 = 0 AND v = 2 THEN NULL ELSE value END AS value FROM obs_primary, (VALUES (1), (2), (4), (7)) t(v)
  WHERE (mi < 23960 OR v >= 4) AND NOT ((mi * 3 + mno) % 11 = 0 AND v IN (2, 7)) AND NOT (mno = 25 AND v = 7))"""


def _versioned(spark, d):
    mi, mno, v = F.col("mi"), F.col("mno"), F.col("version")
    rows = X.obs_primary(spark, d).withColumn("version", F.explode(F.array(*map(F.lit, (1, 2, 4, 7)))))
    kept = rows.where(((mi < 23960) | (v >= 4)) & ~(((mi * 3 + mno) % 11 == 0) & v.isin(2, 7)) & ~((mno == 25) & (v == 7)))
    value = F.when(((mi + mno) % 5 == 0) & (v < 4), F.col("value") * 2).when(((mi + mno) % 7 == 0) & (v == 2), None).otherwise(F.col("value"))
    return kept.select("version", "material_id", "period", value.alias("value"))


@query(X.sql("SELECT version, material_id, period, value FROM versioned", X.FX1, VERSIONED))
def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Every version, looked up in the table of intervals that one pass over all of them made."""
    rows = X.stored(_versioned(spark, d))
    history = intervals.intervals(rows)
    return intervals.numbered(rows).select("version").join(history, (F.col("valid_from") <= F.col("version")) & (F.col("valid_to").isNull() | (F.col("version") < F.col("valid_to")))).select("version", "material_id", "period", "value")


@query(X.sql("""SELECT material_id, period, arg_max(value, version) AS value, min(version) AS valid_from, max(coalesce(next_version, 99)) AS valid_to
  FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY material_id, period ORDER BY version) AS run FROM (SELECT *, coalesce(lag(next_version) OVER w = version AND lag(val) OVER w = val, false) AS same
    FROM (SELECT version, material_id, period, value, coalesce(value, -1) AS val, CASE version WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 4 THEN 7 END AS next_version FROM versioned) WINDOW w AS (PARTITION BY material_id, period ORDER BY version))) GROUP BY 1, 2, run""", X.FX1, VERSIONED).replace("arg_max(value, version)", "nullif(max(val), -1)"))
def version_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The intervals, made of the first two versions and extended by the others one by one."""
    rows = X.stored(_versioned(spark, d))
    out = intervals.intervals(rows.where("version <= 2"))
    for v in (4, 7):
        out = intervals.extended(out, rows.where(F.col("version") == v).select("material_id", "period", "value"), v)
    return out.withColumn("valid_to", F.coalesce("valid_to", F.lit(99)))


def _refreshes(spark, d):
    """A log of observations: an earlier state, and two refreshes that insert, revise and remove months, so that the last
    is the primary source as it is."""
    now = X.stored(X.obs_primary(spark, d))
    mi, mno = F.col("mi"), F.col("mno")
    at = lambda n: F.lit(f"2026-07-0{n} 00:00:00").cast("timestamp").alias("loaded_at")
    late, wrong, extra = (mno % 4 == 1) & (mi > 23985), (mno % 4 == 2) & (mi % 40 == 0), (mno % 5 == 3) & (mi % 50 == 7)
    first = now.where(~late).select("material_id", "period", F.when(wrong, F.col("value") * 3).otherwise(F.col("value")).alias("value"), at(1))
    more = now.where(extra).select("material_id", F.concat("period", F.lit("b")).alias("period"), F.col("value") * 0 + 5, at(1)).toDF(*first.columns)
    log = snapshots.Log(spark, X.scratch(spark))
    log.replace(first.unionByName(more))
    log.append(now.where(late | wrong).select("material_id", "period", "value", at(2)))
    log.append(more.select("material_id", "period", "value", at(3), F.lit(True).alias("removed")))
    return log


@query(X.sql("SELECT material_id, period, value FROM obs_primary", X.FX1))
def snapshot_log(spark: SparkSession, d: str) -> DataFrame:
    """The table after its refreshes and a compaction in place."""
    log = _refreshes(spark, d)
    log.compact()
    return log.read().select("material_id", "period", "value")


@query(X.sql(f"SELECT {', '.join(SIGNAL_COLUMNS)}, CAST(n_obs AS BIGINT) AS n_obs, round(vs_avg12, 6) AS vs_avg12, round(volatility, 6) AS volatility FROM signals", *SIGNAL_PARTS))
def incremental_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of an earlier state, kept up to date through refreshes by the changed series alone."""
    log = _refreshes(spark, d)
    kept = snapshots.Log(spark, X.scratch(spark), order=("made_at",))
    for n in (1, 2, 3):
        incremental.maintain(log, kept, n)
    return _rounded(kept.read(), "vs_avg12", "volatility").select(*SIGNAL_COLUMNS, F.col("n_obs").cast("long").alias("n_obs"), "vs_avg12", "volatility")


FILLED = "filled AS (SELECT doc, sheet, \"row\", count(*) AS n_cells FROM cells WHERE trim(value) <> '' GROUP BY 1, 2, 3)"


@query(X.sql('SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY doc, sheet ORDER BY "row") <= 20', *GRID_PARTS, FILLED))
def profile_head(spark: SparkSession, d: str) -> DataFrame:
    return profile.head_rows(X.cells(spark, d))


@query(X.sql('SELECT * FROM filled WHERE "row" >= greatest(1, (SELECT max("row") FROM cells) - 100) QUALIFY row_number() OVER (PARTITION BY doc, sheet ORDER BY "row" DESC) <= 8', *GRID_PARTS, FILLED))
def profile_tail(spark: SparkSession, d: str) -> DataFrame:
    return profile.tail_rows(X.cells(spark, d))


@query(X.sql("""SELECT doc, sheet, "row", string_agg(DISTINCT k, ',' ORDER BY k) AS keywords FROM cells, (VALUES ('brand'), ('$/mt'), ('zinc')) t(k) WHERE "row" <= 30 AND contains(lower(value), k) GROUP BY 1, 2, 3""", *GRID_PARTS))
def header_candidates(spark: SparkSession, d: str) -> DataFrame:
    return profile.header_candidates(X.cells(spark, d), ["Brand", "$/mt", "zinc"])


@query(X.sql('SELECT doc, sheet, max("row") AS max_row, max(col) AS max_col, count(value) AS n_cells FROM cells GROUP BY 1, 2', *GRID_PARTS))
def sheet_shape(spark: SparkSession, d: str) -> DataFrame:
    return profile.sheet_shape(X.cells(spark, d))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def daily_event_values(spark: SparkSession, d: str) -> DataFrame:
    return refresh.daily_event_values(X.table(spark, d, "events"))


# links, files, cells and texts


LINKED = r"""WITH clean AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script>', '', 'gsi') AS html FROM pages),
roots AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1, 'i') AS all_hrefs FROM clean),
hrefs AS (SELECT page_id, root, unnest(all_hrefs) AS href, unnest(range(len(all_hrefs))) AS pos FROM roots)"""


@query(
    LINKED
    + r""" SELECT page_id, coalesce(found, 'none') AS found FROM pages LEFT JOIN (SELECT page_id, arg_min(root || href, pos) AS found FROM hrefs
  WHERE starts_with(href, '/') AND lower(regexp_extract(href, '([^/?#]*)$', 1)) = 'the' AND regexp_matches(root, '^https://.*[.](org|net)$') GROUP BY 1) USING (page_id)"""
)
def link_target(spark: SparkSession, d: str) -> DataFrame:
    """The first link of each page to a target of this name on an allowed host, else a fallback."""
    pages = X.table(spark, d, "pages")
    hosts = pages.select(F.regexp_extract("url", r"^https://([^/?#]*\.(?:org|net))(?:[/?#]|$)", 1).alias("host")).where("host <> ''").distinct()
    return documents.discovered(pages, "The", hosts, "none")


@query("""SELECT doc_id, n AS length, sha256(c) AS sha256, CASE WHEN n < 50000 THEN 'too small' WHEN n > 52428800 THEN 'too large' WHEN doc_id % 3 = 0 THEN 'not the expected format' END AS problem
  FROM (SELECT doc_id, c, CAST(strlen(c) AS BIGINT) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'XX' ELSE 'PK' END || repeat(coalesce(text, ''), 12) AS c FROM documents))""")
def landed_admission(spark: SparkSession, d: str) -> DataFrame:
    """Every document, repeated to the size of a file, as the content of a landed file; some lack the format's mark."""
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "XX").otherwise("PK"), F.repeat(F.coalesce("text", F.lit("")), F.lit(12))).cast("binary")
    files = X.table(spark, d, "documents").select(F.col("doc_id").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return documents.admitted(files).withColumnRenamed("path", "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS VARCHAR) END AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS state FROM orders")
def profile_values(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 14 == 0, float("nan")).when(F.col("o_orderkey") % 7 == 0, float("-inf")).otherwise(F.col("o_totalprice"))
    rows = X.table(spark, d, "orders").select("o_orderkey", price.alias("price"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("state"))
    return ingest.profile_cells(rows, "price", "at", "day", "state")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS run_time, CASE WHEN event_id % 5 = 0 THEN 'no time' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END AS local_minute,
  strftime(ts, '%Y%m%d') AS compact, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y/%m/%d %H:%M') AS minute FROM events""")
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of times in UTC, whatever the session's time zone, and in the zone of the readers."""
    at = F.col("ts").cast("timestamp_ntz")
    in_zone = F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp")
    rows = X.table(spark, d, "events").select("event_id", S.utc_second(in_zone).alias("run_time"), S.date_stamps(at).alias("s"))
    text = F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.col("run_time"))
    return rows.select("event_id", "run_time", S.local_minute(text).alias("local_minute"), "s.*")


@query(r"SELECT doc_id, left(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]', '', 'g'), 500) AS message FROM documents")
def safe_texts(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", S.safe_message(F.col("text")).alias("message"))


@query("SELECT event_type AS material_id, strftime(ts, '%Y-%m-%d %H') AS period, max(struct_pack(t := ts, v := value)).v AS value FROM events GROUP BY 1, 2")
def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream that is upserted, batch by batch, into a table of the last value of each type and hour."""
    source = spark.readStream.schema(X.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events*.parquet")
    rows = source.select(F.col("event_type").alias("material_id"), F.date_format("ts", "yyyy-MM-dd HH").alias("period"), "value", F.col("ts").cast("timestamp").alias("loaded_at"))
    place = X.scratch(spark)
    refresh.refresh(rows, f"{place}/table", f"{place}/state").awaitTermination()
    return refresh.current(spark, f"{place}/table").select("material_id", "period", "value")
