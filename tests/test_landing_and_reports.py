import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewell.functions import scalars as S
from pricewell.operators import report, shouldcost as C
from pricewell.sources import csv_export, landing, snapshots

GOOD = b"PK" + b"0" * 60_000


def parsed(files):
    return files.select(F.col("sha256").alias("material_id"), F.lit("2024-01").alias("period"), F.col("length").cast("double").alias("value"), F.lit(1).alias("loaded_at"))


def test_contents_are_taken_in_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, calls = snapshots.Log(spark, str(tmp_path / "table")), []

    def parse(files):
        calls.append(sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()))
        return parsed(files)

    def run():
        landing.take_in(spark, str(tmp_path / "in"), str(tmp_path / "own"), parse, table, "*.bin", most=100_000).awaitTermination()
        return {r.path.rsplit("/", 1)[1]: r.problem for r in landing.manifest(spark, str(tmp_path / "own/manifest")).read().collect()}

    land = lambda name, body: (tmp_path / "in" / name).write_bytes(body)
    land("a.bin", GOOD), land("b.bin", GOOD), land("c.bin", b"PK"), land("note.txt", GOOD + b"1")
    assert run() == {"a.bin": None, "c.bin": "too small"} and calls == [["a.bin"]]
    assert run() == {"a.bin": None, "c.bin": "too small"} and calls == [["a.bin"]]  # nothing new: nothing is opened
    land("d.bin", GOOD), land("e.bin", GOOD + b"2"), land("f.bin", b"PK" + b"0" * 200_000), land("g.bin", b"XX" + b"0" * 60_000)
    assert run() == {"a.bin": None, "c.bin": "too small", "e.bin": None, "f.bin": "too large", "g.bin": "not the expected format"}
    assert calls == [["a.bin"], ["e.bin"]]
    assert {r.material_id for r in table.read().collect()} == {hashlib.sha256(x).hexdigest() for x in (GOOD, GOOD + b"2")}


def test_a_batch_that_failed_before_the_manifest_is_repeated_without_harm(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(GOOD)
    table = snapshots.Log(spark, str(tmp_path / "table"))
    go = lambda: landing.take_in(spark, str(tmp_path / "in"), str(tmp_path / "own"), parsed, table).awaitTermination()
    append = snapshots.Log.append

    def fails(log, rows, *args):
        if "sha256" in log.keys:
            raise RuntimeError("lost")
        return append(log, rows, *args)

    monkeypatch.setattr(snapshots.Log, "append", fails)
    try:
        go()
    except Exception as e:
        assert "lost" in str(e)
    monkeypatch.setattr(snapshots.Log, "append", append)
    assert table.last().number == 1
    go()
    assert table.last().number == 1 and table.read().count() == 1 and landing.manifest(spark, str(tmp_path / "own/manifest")).read().count() == 1


def test_one_file_a_report(spark, tmp_path):
    numbers = {c: 10.0 for c in C.NUMBERS}
    rows = [(i, *numbers.values(), ["a/b c", "", None, 'x "y"'][i % 4], "=SUM(A1)\r\nnext" if i == 3 else "plain") for i in range(12)]
    quotes = spark.createDataFrame(rows, "quote_id int, " + ", ".join(f"{c} double" for c in numbers) + ", product string, supplier_reason string").repartition(3)
    reviewed = C.reviewed(quotes).withColumns({"evidence": C.verdict_evidence(), "gap_text": C.gap_text()})
    snaps = report.snapshots(reviewed, "quote_id")
    cells = report.report_cells(snaps.withColumn("label", csv_export.report_labels(F.col("product"), F.col("quote_id"))), "quote_id", "label")
    out = str(tmp_path / "reports")
    csv_export.write_reports(cells, out)
    files = {f.parent.name: f.read_bytes() for f in (tmp_path / "reports").glob("report=*/part-*")}
    assert len(files) == 12 and {"report=a_b_c-0", "report=report-1", "report=report-2", "report=x__y_-3"} <= set(files), sorted(files)
    for raw in files.values():
        assert raw.startswith(b"\xef\xbb\xbf\"section\"") and raw.endswith(b"\r\n") and raw.count(b"\xef\xbb\xbf") == 1
    want = {(r.label, c.section, c.field): c for r in cells.collect() for c in r.cells}
    back = csv_export.read_reports(spark, out).collect()
    assert len(back) == 12 * 42
    for r in back:
        cell = want[r.report, r.section, r.field]
        guarded = ("'" + cell.value) if cell.free and cell.value[:1] in "=+-@" and cell.value else cell.value
        assert (r.value or "", r.unit or "") == (guarded, cell.unit), json.dumps(r.asDict())


@pytest.mark.parametrize("name", ["report_long", "csv_report_lines"])
def test_quotes_of_one_file_are_dealt_and_judged_once(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("THEN result_not_finite") == 1
    assert df.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["report_long", "csv_report_lines", "report_shown", "quote_verdict"])
def test_quotes_are_judged_and_worded_by_generated_code(spark, sf_dir, name):
    """What stands in a lambda is evaluated node by node for each quote; no more than `apart` stands in one."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("THEN result_not_finite") == 1
    bodies = re.findall(r"lambdafunction\((.*?), lambda (\S+), false\)", plan)
    assert bodies and plan.count("lambdafunction(") == len(bodies) and all(body == f"lambda {x}" for body, x in bodies), bodies


def test_report_files_are_the_texts_of_the_cells(spark):
    numbers = {c: 10.0 for c in C.NUMBERS} | {"supplier_ask": 3.3}
    odd = [10.0, 0.1 + 0.2, 35.0000001, 2.9999996, 4e-7, -0.0, 0.0, 12.3456785, 7.25, 99.9999999, 1e15 + 0.5, 123456789012345.6, 1e31, 1e33, 1e300]
    texts = ["plain", "", None, ' 　x "y" ', "=SUM(A1)\r\nnext", "-1", "12.5", " é", "\x7f", "é ", " a", "a\t", "+", "20260702", "😀"]
    rows = [(i, x, *[v for c, v in numbers.items() if c != "price"], t, t, t, t, t) for i, (x, t) in enumerate(zip(odd, texts))]
    kinds = "quote_id int, price double, " + ", ".join(f"{c} double" for c in numbers if c != "price") + ", product string, quote_date string, price_unit string, generated_at string, market_context string"
    reviewed = C.reviewed(spark.createDataFrame(rows, kinds)).withColumns({"evidence": C.verdict_evidence(), "gap_text": C.gap_text(), "target_rate": F.when(F.col("quote_id") % 2 == 0, -0.5)})
    snaps = report.snapshots(reviewed, "quote_id")
    got = {r.quote_id: r.text for r in csv_export.report_files(snaps, "quote_id").collect()}
    cells = report.report_cells(snaps, "quote_id")
    want = {r.quote_id: r.text for r in cells.select("quote_id", csv_export.report_text(F.col("cells")).alias("text")).collect()}
    assert len(got) == len(odd) and got == want
    price = {i: re.search(r'"result","price",(.*?),"', t).group(1) for i, t in got.items()}
    assert list(price.values()) == ["10", "0.3", "35", "3", "0", "0", "0", "12.345679", "7.25", "100", "1000000000000000.5", "123456789012345.6", "1" + "0" * 31, '"1.0E33"', '"1.0E300"']
    at = lambda i: re.search(r'"case","product",(.*),""\r\n"case","quote_ref".*"case","quote_date",(.*),""\r\n"case","buyer"', got[i], re.S).groups()
    assert [at(i) for i in (2, 3, 4, 5, 6, 13)] == [('""', '""'), ('"x ""y"""', '"x ""y"""'), ('"\'=SUM(A1)\r\nnext"', '"=SUM(A1)\r\nnext"'), ('"\'-1"', "-1"), ('"12.5"', "12.5"), ('"20260702"', "20260702")]


def test_a_look_at_the_ends_trims_as_btrim_does(spark):
    texts = [None, "", " ", "a", " a", "a ", "a b", "　a", "a ", "é", "é ", "!~", "\x7f", "\x1f", "\x1c a", "😀", "😀 ", "\n\x85", "~", "x" * 50 + " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.trimmed_at_need(F.col("t")).alias("quick"), S.trimmed(F.col("t")).alias("plain")).collect()
    assert [r.quick for r in rows] == [r.plain for r in rows] and [r.plain for r in rows[3:8]] == ["a", "a", "a", "a b", "a"]
