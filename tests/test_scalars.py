"""Column functions on the awkward inputs."""

import pytest
from pyspark.sql import functions as F

from pricewell.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,primary,comparison",
    [("1,234.5", 1234.5, 1234.5), (" 12 ", 12.0, 12.0), ("...", None, None), ("…", None, None), (".", None, None), ("-", None, None), ("n/a", None, None), ("NULL", None, None), ("0", None, None), ("-3", None, None), ("NaN", None, None), ("inf", None, None), ("1_000", None, None), ("5d", None, None), ("", None, None), (None, None, None), ("1e3", 1000.0, 1000.0), (" 7 ", 7.0, 7.0)],
)
def test_numbers(spark, text, primary, comparison):
    assert one(spark, S.primary_number(F.lit(text))) == primary and one(spark, S.comparison_number(F.lit(text))) == comparison


@pytest.mark.parametrize("text,grid", [("2024M01", "2024-01"), (" 2024M12 ", "2024-12"), ("2024M13", None), ("2024-01", None), ("２０２４M01", None), (None, None)])
def test_grid_periods(spark, text, grid):
    assert one(spark, S.grid_period(F.lit(text))) == grid


@pytest.mark.parametrize("text,period", [("2024-02-31", "2024-02"), (" 2024-02-01\n", "2024-02"), ("2024-02-00", None), ("2024-13-01", None), ("2024-1-1", None), (None, None)])
def test_date_periods(spark, text, period):
    assert one(spark, S.date_period(F.lit(text))) == period


def test_number_texts(spark):
    cases = [(35.0, "35", "35.00", "+35.00"), (-0.005, "-0.005", "-0.01", "-0.01"), (0.0000001, "0", "0.00", "+0.00"), (1234567.125, "1234567.125", "1234567.13", "+1234567.13"), (2.00025, "2.00025", "2.00", "+2.00")]
    for x, plain, two, sign in cases:
        assert (one(spark, S.plain_number(F.lit(x))), one(spark, S.fixed(F.lit(x), 2)), one(spark, S.signed(F.lit(x), 2))) == (plain, two, sign)
    assert one(spark, S.fixed(F.lit(float("nan")), 2)) is None and one(spark, S.plain_number(F.lit(None).cast("double"))) == "" and one(spark, S.plain_number(F.lit(1e300))) == "1.0E300"
    assert [one(spark, S.finite(F.lit(x))) for x in (1.0, float("nan"), float("inf"), float("-inf"))] == [True, False, False, False] and one(spark, S.finite(F.lit(None).cast("double"))) is False


def test_times(spark):
    at = F.lit("2026-07-02 08:09:10.5").cast("timestamp")
    assert one(spark, S.utc_second(at)) == "2026-07-02T08:09:10Z" and one(spark, F.length(S.utc_second())) == 20
    assert tuple(one(spark, S.date_stamps(at))) == ("20260702", "2026-07-02", "2026/07/02 08:09")


def test_texts(spark):
    assert one(spark, S.normalize_text(F.lit(" a \t b\n"))) == "a b" and one(spark, S.normalize_text(F.lit(None).cast("string"))) == ""
    assert one(spark, S.updated_on(F.lit("Updated on July 02, 2026"))) == "2026-07-02" and one(spark, S.updated_on(F.lit("Updated on February 31, 2026"))) is None
    assert one(spark, S.form_number(F.lit("  "))) == 0.0 and one(spark, S.form_number(F.lit("12abc"))) is None and one(spark, S.form_number(F.lit(" -1.5 "))) == -1.5
    assert one(spark, S.filename_part(F.lit(' a/b:c  d"'), "x")) == "a_b_c_d_" and one(spark, S.filename_part(F.lit("  "), "x")) == "x"
    assert one(spark, S.csv_text(F.lit('=1+"2"'))) == '"\'=1+""2"""' and one(spark, S.csv_text(F.lit("-1"), guard=False)) == '"-1"'
    assert one(spark, S.csv_number(F.lit(1.23456))) == "1.2346" and one(spark, S.csv_number(F.lit(float("nan")))) == ""
    assert [one(spark, S.signed_percent(F.lit(x))) for x in (1.234, -1.234, 0.001, -0.001)] == ["▲ +1.23%", "▼ -1.23%", "— 0.00%", "— 0.00%"]
    assert one(spark, S.number_text(F.lit(1234567.0))) == "1,234,567" and one(spark, S.number_text(F.lit(1.234))) == "1.23" and one(spark, S.number_text(F.lit(float("inf")))) == "—"
    assert one(spark, S.period_text(F.lit("2024-05"))) == "2024/05" and one(spark, S.period_text(F.lit("x"))) == "x"
    assert one(spark, S.local_minute(F.lit("2026-07-10T18:30:05Z"))) == "2026-07-11 02:30" and one(spark, S.local_minute(F.lit("soon"))) == "soon"
    assert one(spark, S.safe_message(F.lit("a\x00b\n" + "c" * 600))) == "ab" + "c" * 498
    assert [one(spark, S.carried_rate(F.lit(x))) for x in (0.125, -0.125)] == [0.13, -0.12]
