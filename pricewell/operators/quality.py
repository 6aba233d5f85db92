"""Data-quality gates: each rule gives rows (rule_id, source, series_id, n_bad, sample); none means it passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PERIOD, finite

MIN_INGEST, MIN_SIGNALS, MIN_VIEWS, MIN_COMPARED = 60, 13, 61, 12


def _violations(rows: DataFrame, rule: str, sample: Column, source="source", series="material_id") -> DataFrame:
    g = rows.groupBy(F.col(source).alias("source"), F.col(series).alias("series_id"))
    return g.agg(F.count("*").alias("n_bad"), F.min(sample.cast("string")).alias("sample")).select(F.lit(rule).alias("rule_id"), "source", "series_id", "n_bad", "sample")


def min_observations(obs: DataFrame, least: int = MIN_INGEST, rule: str = "min_observations") -> DataFrame:
    """Series with fewer observations than `least`; sample is the number."""
    n = obs.groupBy("source", "material_id").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return _violations(n, rule, F.col("n"))


def out_of_order(obs: DataFrame) -> DataFrame:
    """Rows whose period is before that of the row read just before it; repeats are duplicates() work."""
    w = Window.partitionBy("source", "material_id").orderBy("ingest_ord")
    return _violations(obs.withColumn("_before", F.lag("period").over(w)).where("_before > period"), "order", F.col("period"))


def duplicates(obs: DataFrame) -> DataFrame:
    twice = obs.groupBy("source", "material_id", "period").count().where("count > 1")
    return _violations(twice, "duplicate_period", F.col("period"))


def bad_format(obs: DataFrame) -> DataFrame:
    return _violations(obs.where(~F.coalesce(F.col("period").rlike(PERIOD), F.lit(False))), "period_format", F.coalesce("period", F.lit("null")))


def bad_value(obs: DataFrame) -> DataFrame:
    v = F.col("value")
    return _violations(obs.where(~F.coalesce(finite(v) & (v > 0), F.lit(False))), "value", F.coalesce("period", F.lit("null")))


def stale_series(obs: DataFrame) -> DataFrame:
    """Series whose latest period isn't that of their source."""
    each = obs.groupBy("source", "material_id").agg(F.max("period").alias("latest"))
    whole = each.groupBy("source").agg(F.max("latest").alias("source_latest"))
    return _violations(each.join(whole, "source").where("latest < source_latest"), "freshness", F.col("latest"))


def missing_series(obs: DataFrame, materials: DataFrame, source: str) -> DataFrame:
    absent = materials.select("material_id").join(obs.where(F.col("source") == source), "material_id", "left_anti").withColumn("source", F.lit(source))
    return _violations(absent, "missing_series", F.col("material_id"))


def id_set_difference(obs: DataFrame, materials: DataFrame, source: str) -> DataFrame:
    """Ids that only one of the source and the configuration has."""
    have, want = obs.where(F.col("source") == source).select("material_id").distinct(), materials.select("material_id").distinct()
    both = have.exceptAll(want).withColumn("side", F.lit("unknown")).unionByName(want.exceptAll(have).withColumn("side", F.lit("missing")))
    return _violations(both.withColumn("source", F.lit(source)), "id_set", F.col("side"))


def overlap_gate(primary: DataFrame, comparison: DataFrame) -> DataFrame:
    """Series of the comparison source without a common period, or with a primary value of 0."""
    both = primary.select("material_id", "period", "value").join(comparison.select("material_id", "period"), ["material_id", "period"])
    none = comparison.select("source", "material_id").distinct().join(both, "material_id", "left_anti")
    zero = both.where("value = 0").withColumn("source", F.lit("primary"))
    return _violations(none, "no_overlap", F.col("material_id")).unionByName(_violations(zero, "zero_base", F.col("period")))


def incomplete_signals(signals: DataFrame) -> DataFrame:
    """Signals whose four changes aren't all finite and at least -100."""
    ok = reduce(lambda a, b: a & b, [finite(F.col(c)) & (F.col(c) >= -100) for c in ("c1", "c3", "c6", "c12")])
    return _violations(signals.where(~F.coalesce(ok, F.lit(False))).withColumn("source", F.lit("signals")), "completeness", F.col("period"))


def policy_violations(documents: DataFrame, primary: str) -> DataFrame:
    """Documents that break the policy: no real data, an automatic fallback, a primary document under another
    name than `primary`, or any document that names another primary source.

    documents: (source, material_id, source_name, primary_source, is_real, automatic_fallback); the sample is
    what is wrong, and a document can be wrong in several ways. A missing flag or name counts as wrong.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    named = (F.col("source") != "primary") | (F.col("source_name") == primary)
    wrong = [("not real", ~sure(F.col("is_real"))), ("fallback", ~sure(~F.col("automatic_fallback"))), ("source name", ~sure(named)), ("primary source", ~sure(F.col("primary_source") == primary))]
    bad = documents.select("source", "material_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in wrong]), lambda x: x.isNotNull())).alias("wrong"))
    each = bad.groupBy("source", "material_id", "wrong").agg(F.count("*").alias("n_bad"))
    return each.select(F.lit("policy").alias("rule_id"), "source", F.col("material_id").alias("series_id"), "n_bad", F.col("wrong").alias("sample"))


def freshness_mismatch(signals: DataFrame, status: DataFrame, source: str = "primary") -> DataFrame:
    """One row if the signals' latest period isn't the status table's."""
    have, want = signals.agg(F.max("period").alias("have")), status.where(F.col("source") == source).agg(F.max("latest_period").alias("want"))
    both = have.crossJoin(F.broadcast(want)).where("NOT have <=> want").withColumn("source", F.lit(source)).withColumn("material_id", F.lit("*"))  # one row each
    return _violations(both, "signals_behind", F.concat_ws("/", "have", "want"))


def scan(obs: DataFrame, least: int = MIN_INGEST) -> DataFrame:
    """The violations of min_observations(), out_of_order(), duplicates(), bad_format(), bad_value() and stale_series()
    from one scan: one exchange by series, in which both orders are sorted and all rules are counted at once."""
    by_series = Window.partitionBy("source", "material_id")
    before = F.lag("period").over(by_series.orderBy("ingest_ord"))
    again = F.row_number().over(Window.partitionBy("source", "material_id", "period").orderBy("ingest_ord")) == 2
    period, v, sure = F.col("period"), F.col("value"), lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "order": (F.col("_order"), period),
        "duplicate_period": (F.col("_again"), period),
        "period_format": (~sure(period.rlike(PERIOD)), F.coalesce(period, F.lit("null"))),
        "value": (~sure(finite(v) & (v > 0)), F.coalesce(period, F.lit("null"))),
    }
    rows = obs.withColumn("_order", sure(before > period)).withColumn("_again", again)
    counts = [x for k, (bad, sample) in rules.items() for x in (F.count_if(bad).alias(f"n_{k}"), F.min(F.when(bad, sample.cast("string"))).alias(f"s_{k}"))]
    each = rows.groupBy("source", "material_id").agg(F.count("*").alias("n"), F.max("period").alias("latest"), *counts)
    each = each.withColumn("top", F.max("latest").over(Window.partitionBy("source")))
    one = lambda rule, n, sample: F.struct(F.lit(rule).alias("rule_id"), n.cast("long").alias("n_bad"), sample.cast("string").alias("sample"))
    found = [one(k, F.col(f"n_{k}"), F.col(f"s_{k}")) for k in rules]
    found += [one("min_observations", sure(F.col("n") < least).cast("int"), F.col("n")), one("freshness", sure(F.col("latest") < F.col("top")).cast("int"), F.col("latest"))]
    bad = each.select("source", F.col("material_id").alias("series_id"), F.explode(F.filter(F.array(*found), lambda r: r["n_bad"] > 0)).alias("r"))
    return bad.select("r.rule_id", "source", "series_id", "r.n_bad", "r.sample")


def row_gate() -> dict[str, Column]:
    """What a row of observations must not be, by rule: the gate of a publication, which is counted while it is written."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {"period_format": ~sure(F.col("period").rlike(PERIOD)), "value": ~sure(finite(F.col("value")) & (F.col("value") > 0))}


def all_violations(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def require_clean(violations: DataFrame) -> None:
    """Strict mode: raise if any rule has violations; at most ten are named."""
    if bad := violations.limit(10).collect():
        raise ValueError("data quality: " + "; ".join(f"{r.rule_id} {r.source}/{r.series_id}: {r.n_bad} ({r.sample})" for r in bad))


def quarantined(obs: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of good series, rows of series that have a violation)."""
    bad = violations.select("source", F.col("series_id").alias("material_id")).distinct()
    return obs.join(bad, ["source", "material_id"], "left_anti"), obs.join(bad, ["source", "material_id"], "left_semi")
