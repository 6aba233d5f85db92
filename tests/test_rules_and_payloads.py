import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewell.operators import ingest, rules
from pricewell.operators.shouldcost import CostRules
from pricewell.operators.signals import Thresholds


def test_payloads_of_any_shape(spark):
    items = [
        {"date": " 2024-02-31 ", "value": "1,000.5"}, {"date": "2024-03-01", "value": 7}, {"date": "2024-04-01", "value": 2.5}, {"date": "2024-05-01", "value": True}, {"date": "2024-06-01", "value": None}, {"date": "2024-07-01"},
        {"date": "2024-08-01", "value": [1]}, {"date": "2024-09-01", "value": -3}, {"date": "2024-10-01", "value": "N/A"}, {"date": "2024-02-00", "value": None}, {"date": 20240101, "value": 1}, {"date": None, "value": 1}, {"value": 1}, {}, "text", 5, None, [{"date": "2024-01-01"}],
    ]
    rows = [("a", json.dumps({"observations": items})), ("b", json.dumps({"observations": []})), ("c", "{}"), ("d", "no json"), ("e", None), ("f", json.dumps({"observations": {"date": "2024-01-01"}})), ("g", json.dumps([1])), ("h", json.dumps({"observations": None}))]
    got = sorted(map(tuple, ingest.api_payloads(spark.createDataFrame(rows, "series_id string, payload string")).collect()), key=str)
    own = [r for r in got if r[0] == "a"]
    by_pos = {r[1]: r[2:] for r in own}
    assert [by_pos[i] for i in range(3)] == [("2024-02", 1000.5, None), ("2024-03", 7.0, None), ("2024-04", 2.5, None)]
    assert [by_pos[i][2] for i in range(3, 9)] == ["no value"] * 6 and [by_pos[i][2] for i in range(9, 14)] == ["bad date"] * 5 and [by_pos[i][2] for i in range(14, 18)] == ["no object"] * 4
    assert len(own) == 18 and [r[0] for r in got if r[0] != "a"] == ["c", "d", "e", "f", "g", "h"]
    assert {(r[1], r[4]) for r in got if r[0] != "a"} == {(None, "no list")}


def test_first_rule_that_holds_decides(spark):
    table = rules.rule_table(spark, a=[("low", [("x", "<", 1.0)]), ("both", [("x", ">=", 1.0), ("y", "<>", 0.0)]), ("rest", [])], b=[("only", [("z", "=", 1.0)])])
    rows = spark.createDataFrame([("a", 0.5, None), ("a", 2.0, 1.0), ("a", 2.0, 0.0), ("a", None, 1.0), ("a", float("nan"), 1.0), ("b", 1.0, 1.0), ("none", 1.0, 1.0), (None, 1.0, 1.0)], "rule_set string, x double, y double")
    got = [r.out for r in rules.decided(rows.coalesce(1), table, ["x", "y"], "out").collect()]
    assert sorted(got, key=str) == sorted(["low", "both", "rest", "rest", "both", None, None, None], key=str)


@pytest.mark.parametrize("listed", [rules.trend_rules(), rules.signal_rules(Thresholds()), rules.corroboration_rules(), rules.verdict_rules(CostRules())])
def test_own_tables_are_in_order(spark, listed):
    measures = [*rules.SIGNAL_MEASURES, *rules.CORROBORATION_MEASURES, *rules.VERDICT_MEASURES]
    assert rules.rule_problems(rules.rule_table(spark, own=listed), measures).isEmpty()


def test_corroboration_by_table(spark):
    rows = spark.createDataFrame([(0.0, None, None, None), (1.0, 0.0, 0.5, 0.5), (1.0, 1.0, 1.0, -1.0), (1.0, 1.0, 2.0, 3.0), (1.0, 1.0, 2.0, -3.1), (1.0, 1.0, None, 1.0)], "available double, comparable double, mean_abs_pct double, latest_diff_pct double").withColumn("rule_set", F.lit("own"))
    got = [r.out for r in rules.decided(rows.coalesce(1), rules.rule_table(spark, own=rules.corroboration_rules()), rules.CORROBORATION_MEASURES, "out").collect()]
    assert got == ["NOT_AVAILABLE", "UNIT_NOT_COMPARABLE", "HIGH_AGREEMENT", "MEDIUM_AGREEMENT", "REVIEW_REQUIRED", "REVIEW_REQUIRED"]


def test_rule_problems(spark):
    rows = [("a", 0, "x", [("m", "<", 1.0)]), ("a", 0, "y", [("m", "<", 1.0)]), ("a", 1, "z", []), ("b", 0, "", []), ("c", 0, "x", [("m", "~", 1.0)]), ("c", 1, "x", [("n", "<", 1.0)]), ("c", 2, "x", [("m", "<", float("nan"))]), ("c", 3, "x", [("m", "<", None)]), ("c", 4, "x", []), ("d", 0, "x", []), ("d", 1, "x", [("m", "<", 1.0)])]
    got = sorted(map(tuple, rules.rule_problems(spark.createDataFrame(rows, rules.RULES), ["m"]).collect()), key=str)
    last = "no last rule that always holds"
    assert got == sorted([("a", 0, "two rules at one place"), ("b", 0, "no outcome"), *[("c", k, "condition") for k in range(4)], ("d", None, last)], key=str)


@pytest.mark.parametrize("name", ["quote_verdict", "verdict_rollup", "report_long", "csv_report_lines", "quote_formula"])
def test_generated_methods_stay_small_enough_to_be_compiled(spark, sf_dir, name):
    """The JVM does not compile methods of over 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
        assert code.size() and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_of_one_rule_set_stay_where_they_are(spark):
    rows = spark.range(0, 4000, numPartitions=8).select("id", F.when(F.col("id") >= 0, "a").otherwise("b").alias("rule_set"), (F.col("id") % 3).cast("double").alias("x"))
    table = rules.rule_table(spark, a=[("low", [("x", "<", 1.0)]), ("high", [])])
    # as an input too large for Spark to broadcast by itself
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = rules.decided(rows, table, ["x"], "out").groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("out") == "low").alias("low")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 8 and sum(r.n for r in got) == 4000 and sum(r.low for r in got) == 1334
