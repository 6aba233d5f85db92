"""Ordered rules as data: the first rule of a set whose conditions all hold decides.

A rule is a row (rule_set, ord, outcome, conditions); a condition compares a measure with a bound. A rule without
conditions always holds, so it stands last. Alternatives are rules of one outcome. Sets are small: tens of rules;
the rows they judge may be any number, and each names the set that judges it, such as that of its material group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shouldcost import CostRules
from .signals import Thresholds

RULES = "rule_set string, ord int, outcome string, conditions array<struct<measure:string,op:string,bound:double>>"
OPS = ("<", "<=", ">", ">=", "=", "<>")
Rule = tuple[str, list[tuple[str, str, float]]]


def rule_table(spark: SparkSession, **sets: list[Rule]) -> DataFrame:
    """A table of RULES from lists of (outcome, conditions), numbered in their order."""
    return spark.createDataFrame([(name, k, outcome, conditions) for name, listed in sets.items() for k, (outcome, conditions) in enumerate(listed)], RULES)


def rule_problems(rules: DataFrame, measures: list[str]) -> DataFrame:
    """(rule_set, ord, problem): two rules at one place, no outcome, or a condition with another operator, measure or a
    bound that is no finite number; and sets, with ord null, none of whose rules always holds or one that does not last."""
    ok = lambda c: c["op"].isin(*OPS) & c["measure"].isin(*measures) & c["bound"].isNotNull() & ~F.isnan(c["bound"]) & (F.abs(c["bound"]) < float("inf"))
    fits = F.coalesce(F.forall("conditions", lambda c: F.coalesce(ok(c), F.lit(False))), F.lit(False))
    one = rules.groupBy("rule_set", "ord").agg(F.count("*").alias("n"), F.min(F.when(F.coalesce(F.col("outcome"), F.lit("")) == "", 0).otherwise(1)).alias("named"), F.min(fits.cast("int")).alias("fits"))
    problem = F.when(F.col("ord").isNull() | (F.col("n") > 1), "two rules at one place").when(F.col("named") == 0, "no outcome").when(F.col("fits") == 0, "condition")
    open_end = rules.groupBy("rule_set").agg((F.coalesce(F.max(F.when(F.size("conditions") == 0, F.col("ord"))) == F.max("ord"), F.lit(False)) & (F.count_if(F.size("conditions") == 0) == 1)).alias("closed"))
    sets = open_end.where("NOT closed").select("rule_set", F.lit(None).cast("int").alias("ord"), F.lit("no last rule that always holds").alias("problem"))
    return one.select("rule_set", "ord", problem.alias("problem")).where("problem IS NOT NULL").unionByName(sets)


def _holds(value: Column, op: Column, bound: Column) -> Column:
    tests = {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound, "=": value == bound, "<>": value != bound}
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(op == name, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def decided(rows: DataFrame, rules: DataFrame, measures: dict[str, Column] | list[str], name: str, set_col: str | Column = "rule_set") -> DataFrame:
    """rows with a column `name`: the outcome of the first rule that holds of the set that set_col names; null if none
    does, or there is no such set. A measure that is null, or not among `measures`, meets no condition.

    The rules, which people write, go to every task: rows joined by the name of their set would meet in one task a set."""
    if not isinstance(measures, dict):
        measures = {m: F.col(m) for m in measures}
    listed = rules.groupBy(F.col("rule_set").alias("_set")).agg(F.sort_array(F.collect_list(F.struct("ord", "outcome", "conditions"))).alias("_rules"))  # a set is one row of tens of rules
    key = F.col(set_col) if isinstance(set_col, str) else set_col
    values = F.create_map(*[x for k, v in measures.items() for x in (F.lit(k), v.cast("double"))])
    out = rows.withColumn("_values", values).join(F.broadcast(listed), key == F.col("_set"), "left")
    first = F.get(F.filter("_rules", lambda r: F.forall(r["conditions"], lambda c: _holds(F.try_element_at("_values", c["measure"]), c["op"], c["bound"]))), 0)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], first["outcome"].alias(name))


SIGNAL_MEASURES = ["c1", "c3", "c6", "vs_avg12", "range_position"]


def trend_rules(t: Thresholds = Thresholds()) -> list[Rule]:
    r = t.reversal
    return [
        ("DOWNTREND_REBOUND", [("c1", ">=", r), ("c3", "<=", -r)]),
        ("UPTREND_PULLBACK", [("c1", "<=", -r), ("c3", ">=", r)]),
        ("BROAD_DOWNTREND", [("c1", "<", 0.0), ("c3", "<", 0.0), ("c6", "<", 0.0)]),
        ("BROAD_UPTREND", [("c1", ">", 0.0), ("c3", ">", 0.0), ("c6", ">", 0.0)]),
        ("RANGE_BOUND", [("c3", ">", -t.flat_3), ("c3", "<", t.flat_3), ("c6", ">", -t.flat_6), ("c6", "<", t.flat_6)]),
        ("MIXED", []),
    ]


def signal_rules(t: Thresholds = Thresholds()) -> list[Rule]:
    return [
        ("NEGOTIATE_REDUCTION", [("c3", "<=", t.strong_down_3)]),
        ("NEGOTIATE_REDUCTION", [("c3", "<=", t.down_3), ("c6", "<=", t.down_6)]),
        ("CHALLENGE_INCREASE", [("c3", "<=", t.down_3)]),
        ("CHALLENGE_INCREASE", [("c6", "<=", t.down_6), ("vs_avg12", "<", 0.0)]),
        ("VERIFY_STRONG_INCREASE", [("c3", ">=", t.strong_up_3)]),
        ("VERIFY_STRONG_INCREASE", [("c3", ">=", t.up_3), ("c6", ">=", t.up_6)]),
        ("VERIFY_INCREASE", [("c3", ">=", t.up_3)]),
        ("VERIFY_INCREASE", [("c6", ">=", t.up_6)]),
        ("MONITOR_AND_HOLD", []),
    ]


CORROBORATION_MEASURES = ["available", "comparable", "mean_abs_pct", "latest_diff_pct"]


def corroboration_rules(t: Thresholds = Thresholds()) -> list[Rule]:
    """available and comparable are 1 or 0."""
    within = lambda limit: [("mean_abs_pct", "<=", limit), ("latest_diff_pct", "<=", limit), ("latest_diff_pct", ">=", -limit)]
    return [("NOT_AVAILABLE", [("available", "<", 1.0)]), ("UNIT_NOT_COMPARABLE", [("comparable", "<", 1.0)]), ("HIGH_AGREEMENT", within(t.high_agreement)), ("MEDIUM_AGREEMENT", within(t.medium_agreement)), ("REVIEW_REQUIRED", [])]


VERDICT_MEASURES = ["invalid", "estimate", "supplier_ask", "gap", "mat_impact"]


def verdict_rules(c: CostRules = CostRules()) -> list[Rule]:
    """invalid is 1 or 0."""
    m, e, h = c.match, c.evidence, c.challenge
    return [
        ("INVALID", [("invalid", ">", 0.0)]),
        ("REQUEST_REDUCTION", [("estimate", "<", -m), ("supplier_ask", ">=", 0.0)]),
        ("REQUEST_DEEPER_REDUCTION", [("estimate", "<", -m), ("supplier_ask", "<", 0.0), ("gap", ">", m)]),
        ("CHALLENGE_INCREASE", [("mat_impact", "<", -m), ("supplier_ask", ">", 0.0), ("gap", ">", m)]),
        ("HIGH_CHALLENGE", [("gap", ">=", h)]),
        ("REQUEST_EVIDENCE", [("gap", ">=", e)]),
        ("CLARIFY_SMALL_GAP", [("gap", ">", m)]),
        ("CONDITIONAL_REVIEW", [("gap", ">=", -m), ("gap", "<=", m)]),
        ("SUPPLIER_BELOW_MODEL", []),
    ]
