import pytest
from pyspark.sql import functions as F

from pricewell.operators import quality
from pricewell.plans import fixtures as X
from pricewell.streaming import gates

RULES = ("order", "duplicate_period", "period_format", "value")
ROWS = [
    ("a", "2020-01", 1.0), ("a", "2020-02", 1.0), ("a", "2020-02", 2.0), ("a", "2020-01", -1.0), ("a", None, 1.0), ("a", "2019-12", None), ("a", "2020-02", 1.0), ("a", "x", 1.0), ("a", "x", float("nan")), ("a", None, 0.0),
    ("b", "2020-01", 1.0), ("b", "2020-13", float("inf")), ("b", "2020-03", 1.0),
    ("c", "2021-01", 1.0), ("c", "2021-02", 1.0),
]


def faulty(spark):
    rows = [("s", m, p, v, float(i)) for i, (m, p, v) in enumerate(ROWS)]
    return spark.createDataFrame([*rows, ("t", "a", "2022-01", 1.0, 0.0)], gates.ROWS)


def found(df):
    return sorted(map(tuple, df.select("rule_id", "source", "series_id", "n_bad", "sample").collect()), key=str)


def each(obs, least):
    return quality.all_violations(quality.min_observations(obs, least), quality.out_of_order(obs), quality.duplicates(obs), quality.bad_format(obs), quality.bad_value(obs), quality.stale_series(obs))


def test_one_scan_gives_what_all_rules_give(spark):
    obs = faulty(spark)
    for least in (0, 3, 100):
        assert found(quality.scan(obs, least)) == found(each(obs, least))
    assert quality.scan(obs.limit(0)).isEmpty()


def test_one_scan_reads_once(spark, tmp_path):
    faulty(spark).write.parquet(str(tmp_path / "obs"))
    obs = spark.read.parquet(str(tmp_path / "obs"))
    plan = quality.scan(obs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2  # by series, and sums of series by source
    assert each(obs, 3)._jdf.queryExecution().executedPlan().toString().count("FileScan") > 5


@pytest.mark.parametrize("lots", [1, 2, 5])
def test_stream_gives_what_the_gates_give(spark, lots):
    place, obs = X.scratch(spark), faulty(spark)
    size = -(-len(ROWS) // lots)
    for i in range(lots):
        obs.where((F.col("ingest_ord") >= i * size) & (F.col("ingest_ord") < (i + 1) * size)).write.mode("append").parquet(f"{place}/in")
        for _ in range(2):  # the second run finds nothing new
            gates.run(spark, f"{place}/in", f"{place}/out", f"{place}/state").awaitTermination()
    assert found(gates.totals(spark, f"{place}/out")) == [r for r in found(each(obs, 0)) if r[0] in RULES]
