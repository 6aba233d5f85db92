"""Two sources month by month, under a unit-compatibility rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the unit texts that make two sources comparable, by kind of unit.
UNIT_TOKENS = {"metric ton": (("/mt",), ("metric ton",)), "barrel": (("/bbl",), ("barrel",)), "mmbtu": (("/mmbtu",), ("million btu", "mmbtu"))}


def unit_rules(materials: DataFrame, kind) -> DataFrame:
    """(material_id, primary_tokens, comparison_tokens); materials whose `kind` is null have no rule."""
    rules = materials.select("material_id", kind.alias("kind")).where("kind IS NOT NULL")
    pick = lambda k: F.coalesce(*[F.when(F.col("kind") == name, F.array(*map(F.lit, t[k]))) for name, t in UNIT_TOKENS.items()])
    return rules.select("material_id", pick(0).alias("primary_tokens"), pick(1).alias("comparison_tokens"))


def unit_compatibility(materials: DataFrame, rules: DataFrame) -> DataFrame:
    """materials with comparable: a rule exists and each unit text holds one of its tokens; and the reason if not."""
    holds = lambda tokens, unit: F.exists(tokens, lambda t: F.contains(F.lower(F.coalesce(F.col(unit), F.lit(""))), t))
    out = materials.join(rules, "material_id", "left")
    ok = F.coalesce(holds("primary_tokens", "primary_unit") & holds("comparison_tokens", "comparison_unit"), F.lit(False))
    return out.select("material_id", "primary_unit", "comparison_unit", ok.alias("comparable"), F.when(~ok, F.when(F.col("primary_tokens").isNull(), "no unit rule").otherwise("units differ")).alias("reason"))


def overlap(primary: DataFrame, comparison: DataFrame) -> DataFrame:
    """(material_id, n_common, first_common, last_common)."""
    both = primary.select("material_id", "period").intersect(comparison.select("material_id", "period"))
    return both.groupBy("material_id").agg(F.count("*").alias("n_common"), F.min("period").alias("first_common"), F.max("period").alias("last_common"))


def compared(primary: DataFrame, comparison: DataFrame, compatible: DataFrame) -> DataFrame:
    """(material_id, period, primary_value, comparison_value, diff, diff_pct) of the comparable materials' common months."""
    p = primary.select("material_id", "period", F.col("value").alias("primary_value"))
    c = comparison.select("material_id", "period", F.col("value").alias("comparison_value"))
    rows = p.join(c, ["material_id", "period"]).join(compatible.where("comparable").select("material_id"), "material_id", "left_semi")
    diff = F.col("comparison_value") - F.col("primary_value")
    return rows.select("*", F.round(diff, 6).alias("diff"), F.round(F.try_divide(diff, F.col("primary_value")) * 100, 6).alias("diff_pct"))


def comparison_summary(rows: DataFrame, months: int = 12) -> DataFrame:
    """At the latest common month: values, diff_pct, mean and greatest absolute diff_pct of the last months."""
    newest = Window.partitionBy("material_id").orderBy(F.desc("period"))
    recent = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= months)
    last = lambda c: F.max_by(c, "period")
    return recent.groupBy("material_id").agg(F.max("period").alias("latest_period"), last("primary_value").alias("latest_primary"), last("comparison_value").alias("latest_comparison"), last("diff_pct").alias("latest_diff_pct"), F.round(F.avg(F.abs("diff_pct")), 6).alias("mean_abs_pct"), F.max(F.abs("diff_pct")).alias("max_abs_pct"))


def full_summary(primary: DataFrame, comparison: DataFrame, compatible: DataFrame) -> DataFrame:
    """One row for each material with common months: its summary or, where units differ, latest values and reason."""
    both = primary.select("material_id", "period", F.col("value").alias("p")).join(comparison.select("material_id", "period", F.col("value").alias("c")), ["material_id", "period"])
    last = both.groupBy("material_id").agg(F.max("period").alias("latest_period"), F.max_by("p", "period").alias("latest_primary"), F.max_by("c", "period").alias("latest_comparison"), F.count("*").alias("n_common"))
    found = comparison_summary(compared(primary, comparison, compatible)).select("material_id", "latest_diff_pct", "mean_abs_pct", "max_abs_pct")
    return last.join(compatible.select("material_id", "comparable", "reason"), "material_id").join(found, "material_id", "left")


def last_rows(rows: DataFrame, n: int = 12) -> DataFrame:
    newest = Window.partitionBy("material_id").orderBy(F.desc("period"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def chart_rows(rows: DataFrame, n: int = 12) -> DataFrame:
    """The last n common months as (material_id, period, series, value)."""
    return last_rows(rows, n).unpivot(["material_id", "period"], ["primary_value", "comparison_value"], "series", "value")


def source_rollup(obs: DataFrame) -> DataFrame:
    """By source: number of series, least and greatest latest period, and a map from series to its latest period."""
    each = obs.groupBy("source", "material_id").agg(F.max("period").alias("latest"))
    return each.groupBy("source").agg(F.count("*").alias("n_series"), F.min("latest").alias("min_latest"), F.max("latest").alias("max_latest"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("material_id", "latest")))).alias("latest_by_series"))
