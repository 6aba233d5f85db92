"""Should-cost review, reports, files, status and the incremental refresh."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pricewell.operators import ingest, profile, quality, report, shouldcost as C, status
from pricewell.sources import csv_export, documents
from pricewell.streaming import refresh

GOLDEN = {"price": 1000, "mat_ratio": 35, "mat_rate": 6, "fx_ratio": 15, "fx_rate": 2, "proc_ratio": 25, "proc_rate": 3, "energy_ratio": 10, "energy_rate": 4, "other_ratio": 15, "other_rate": 0, "supplier_ask": 8}


def quotes(spark, *changes):
    rows = [tuple([i] + [float(v) if v is not None else None for v in (GOLDEN | c).values()]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "quote_id int, " + ", ".join(f"{k} double" for k in GOLDEN))


def test_golden_quote(spark):
    r = C.reviewed(quotes(spark, {})).first()
    assert [round(r[f"{c}_impact"], 9) for c in C.COMPONENTS] == [2.1, 0.3, 0.75, 0.4, 0.0]
    assert (round(r.estimate, 9), round(r.gap, 9), round(r.new_price, 9), r.requested_price, round(r.unexplained, 9)) == (3.55, 4.45, 1035.5, 1080.0, 44.5)
    assert (r.verdict, r.tone) == ("HIGH_CHALLENGE", "high") and abs(r.estimate + r.gap - 8) < 1e-12


def test_every_verdict_and_reason(spark):
    cases = [
        ({"mat_rate": -20}, "REQUEST_REDUCTION"),
        ({"mat_rate": -20, "supplier_ask": -1}, "REQUEST_DEEPER_REDUCTION"),
        ({"mat_rate": -2, "other_rate": 20, "supplier_ask": 5}, "CHALLENGE_INCREASE"),
        ({"supplier_ask": 5.2}, "REQUEST_EVIDENCE"),
        ({"supplier_ask": 4.2}, "CLARIFY_SMALL_GAP"),
        ({"supplier_ask": 3.6}, "CONDITIONAL_REVIEW"),
        ({"supplier_ask": 0}, "SUPPLIER_BELOW_MODEL"),
        ({"price": None}, "not_numeric"),
        ({"mat_rate": float("nan")}, "not_numeric"),
        ({"price": -1}, "negative_price"),
        ({"fx_ratio": 101}, "ratio_out_of_range"),
        ({"energy_rate": -101}, "rate_below_minus_100"),
        ({"other_ratio": 60}, "base_ratios_over_100"),
        ({"mat_ratio": 100, "proc_ratio": 0, "energy_ratio": 0, "other_ratio": 0, "mat_rate": -100, "fx_ratio": 100, "fx_rate": -50}, "negative_result_price"),
    ]
    got = {r.quote_id: r.invalid_reason or r.verdict for r in C.reviewed(quotes(spark, *[c for c, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    fields = quotes(spark, {"price": -1, "fx_ratio": 101}).select(C.invalid_fields().alias("f")).first().f
    assert fields == ["price", "fx_ratio"]
    assert C.CostRules(2.0, 1.0, 3.0).problems() and not C.CostRules().problems()


def test_carried_rate_and_override(spark):
    q = quotes(spark, {}, {}).withColumn("material_id", F.when(F.col("quote_id") == 0, "a").otherwise("b"))
    s = spark.createDataFrame([("a", "2026-07", -7.126)], "material_id string, period string, c6 double")
    got = {r.quote_id: r for r in C.with_carried_rate(q, s).collect()}
    assert got[0].mat_rate == -7.13 and not got[0].overridden and got[1].mat_rate == 6.0 and got[1].carried is None
    assert C.with_carried_rate(q, s, edited=F.lit(1.0)).where("quote_id = 0").first().overridden


def test_report_and_csv(spark, tmp_path):
    r = C.reviewed(quotes(spark, {})).withColumn("evidence", C.verdict_evidence()).withColumn("supplier", F.lit('=A "x"')).withColumn("gap_text", C.gap_text())
    rows = report.report_long(r, "quote_id")
    assert rows.count() == 42 and rows.where("field = 'gap'").first().value == "4.45" and report.cost_rows(r, "quote_id").count() == 5
    lines = csv_export.report_lines(rows, "quote_id")
    out = str(tmp_path / "report")
    csv_export.write_lines(lines.where("pos > 0"), csv_export.REPORT_HEADER, out, ["pos"], "\r\n")
    raw = next((tmp_path / "report").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 42 and '"\'=A ""x"""'.encode() in raw
    back = spark.read.option("escape", '"').csv(out, header=True)
    assert back.where("field = 'price'").first().value == "1000"


def test_snapshot_and_defaults(spark):
    r = C.reviewed(quotes(spark, {}, {"price": -1.0}, {})).withColumns({"target_rate": F.when(F.col("quote_id") == 2, -101.0), "buyer": F.lit("  B "), "price_unit": F.lit("")})
    got = {x.quote_id: x for x in report.snapshots(r, "quote_id").collect()}
    assert [(got[i].valid, got[i].reason) for i in range(3)] == [(True, None), (False, "negative_price"), (False, "target_rate")]
    assert got[0].buyer == "B" and got[0].supplier == "" and got[0].market_context == report.NO_CONTEXT and got[0].verdict == "HIGH_CHALLENGE"
    seen = report.shown(report.snapshots(r, "quote_id")).where("quote_id = 0").first()
    assert (seen.buyer, seen.supplier, seen.price_unit, seen.target_rate) == ("B", report.EMPTY, report.DEFAULTS["price_unit"], report.EMPTY)
    assert {x.quote_id for x in report.report_long(r, "quote_id").collect()} == {0}


def test_review_plan_stays_small(spark):
    r = C.reviewed(quotes(spark, {})).where("verdict <> 'INVALID'").select("quote_id", "verdict", "tone")
    assert len(r._jdf.queryExecution().optimizedPlan().toString()) < 12_000


def test_document_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01", 1.5), ("a", "2024-02", 2.0), ("b", "2024-01", 3.0)], "material_id string, period string, value double")
    documents.write_document(rows, "primary", str(tmp_path / "doc"))
    back = documents.read_document(spark, str(tmp_path / "doc"))
    assert {(r.source, r.material_id, r.period, r.value) for r in back.collect()} == {("primary", *tuple(r)) for r in rows.collect()}


def test_file_admission(spark, tmp_path):
    for name, body in (("good.bin", b"PK" + b"0" * 60000), ("small.bin", b"PK"), ("odd.bin", b"XX" + b"0" * 60000)):
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in documents.admitted(documents.landed_files(spark, str(tmp_path), "*.bin")).collect()}
    assert got == {"good.bin": None, "small.bin": "too small", "odd.bin": "not the expected format"}


def test_large_files_are_hashed_split_by_split(spark, tmp_path):
    body = random.Random(1).randbytes(300_000)
    bodies = {"a.bin": body, "b.bin": body + b"\n", "c.bin": b"\n\n" + body + b"\n\n", "d.bin": b"\xef\xbb\xbf" + body, "e.gz": body, "small.bin": b"PK\n", "lines.bin": b"\r\n" * 100_000, "one.bin": b"x" * 200_000}
    for name, x in bodies.items():
        (tmp_path / name).write_bytes(x)
    key = "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(key, "64k")
        files = documents.admitted_at(spark, str(tmp_path), least=10, most=100_000)
        assert len(documents._updated(spark, str(tmp_path / "a.bin"), None).collect()) >= 5
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256, r.problem) for r in files.collect()}
        assert documents.chained(spark, str(tmp_path / "a.bin"), len(body)) == hashlib.sha256(body).hexdigest()
    finally:
        spark.conf.unset(key)
    assert got == {k: (len(x), hashlib.sha256(x).hexdigest(), "too small" if k == "small.bin" else "too large") for k, x in bodies.items()}


def test_links(spark):
    html = '<a class="x" href="CMO.xlsx">1</a><!-- <a href="no">--><script><a href="no"></script><A HREF="//h.org/a/cmo.XLSX?x=1">2</A><a href="/up">3</a>'
    pages = spark.createDataFrame([(1, "https://h.org/d/i.html", html), (2, "https://h.org", None)], "page_id int, url string, html string")
    assert [r.absolute for r in documents.links(pages).orderBy("pos").collect()] == ["https://h.org/d/CMO.xlsx", "https://h.org/a/cmo.XLSX?x=1", "https://h.org/up"]
    found = {r.page_id: r.found for r in documents.discovered(pages, "cmo.xlsx", ["h.org"], "none").collect()}
    assert found == {1: "https://h.org/d/CMO.xlsx", 2: "none"}


def test_columns_and_profiles(spark):
    cells = spark.createDataFrame([("d", "s", 5, 2, " Copper "), ("d", "s", 5, 3, "Zinc"), ("d", "s", 5, 4, "zinc "), ("d", "s", 6, 2, "($/mt)"), ("d", "s", 7, 1, "2024M01"), ("d", "s", 7, 2, "1,000"), ("d", "s", 8, 1, "note"), ("d", "s", 8, 2, "5"), ("d", "s", 300, 1, "end")], "doc string, sheet string, row int, col int, value string")
    names = spark.createDataFrame([("copper", ["copper", "Cu", "COPPER"]), ("zinc", ["zinc"]), ("tin", ["tin"])], "material_id string, names array<string>")
    cols = ingest.resolve_columns(cells, names)
    assert {r.material_id: (r.col, r.n_matches) for r in cols.collect()} == {"copper": (2, 1), "zinc": (None, 2), "tin": (None, 0)}
    assert [tuple(r) for r in ingest.melt_grid(cells, cols).collect()] == [("copper", "2024-01", 1000.0, 7)]
    assert ingest.unit_row(cells, cols).first().unit == "($/mt)"
    assert [r.row for r in profile.tail_rows(cells).collect()] == [300] and profile.head_rows(cells, 2).count() == 2
    assert profile.header_candidates(cells, ["ZINC", "copper"]).first().keywords == "copper,zinc"


def test_status_and_versions(spark, tmp_path):
    none = spark.createDataFrame([], status.STATUS)
    run = status.run_record(spark.createDataFrame([("2024-01", "u")], "latest_period string, url string"), "2026-07-02T08:00:00Z")
    with pytest.raises(ValueError):
        status.comparison_refreshed(none, run)
    first = status.primary_refreshed(none, run)
    again = status.primary_refreshed(first, run)
    row = ("primary", "SUCCESS", "2026-07-02T08:00:00Z", "2026-07-02T08:00:00Z", "2024-01", None, None, "u", False, [])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == [("comparison", "NOT_CONFIGURED", None, None, None, None, None, None, False, []), row]
    stale = first.withColumns({"is_stale": F.lit(True), "warnings": F.array(F.lit("w"))})
    assert tuple(status.comparison_refreshed(stale, run).where("source = 'comparison'").first())[1:] == ("SUCCESS", *row[2:8], True, ["w"])
    rows = spark.createDataFrame([("a", "2024-01", 1.0)], "material_id string, period string, value double")
    bad = spark.createDataFrame([("x",)], "rule_id string")
    out = str(tmp_path / "published")
    assert status.published(spark, out) is None
    assert status.publish(rows, bad.limit(0), out) and not status.publish(rows.limit(0), bad, out) and status.published(spark, out).count() == 1
    (tmp_path / "published" / "data" / "commit=torn").mkdir()  # a job that died
    assert status.publish(rows.union(rows), bad.limit(0), out) and status.published(spark, out).count() == 2
    wrong = rows.withColumn("value", F.lit(-1.0))
    assert not status.publish_gated(rows.union(wrong), quality.row_gate(), out) and status.published(spark, out).count() == 2
    assert status.publish_gated(rows, quality.row_gate(), out) and status.published(spark, out).count() == 1


def test_refresh(spark, tmp_path):
    landing, table, state = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "state")
    landing.mkdir()

    def land(name, *rows):
        (landing / name).write_text("".join(json.dumps(dict(zip(("material_id", "period", "value", "loaded_at"), r, strict=True))) + "\n" for r in rows))
        refresh.refresh(refresh.landed(spark, str(landing)), table, state).awaitTermination()
        return {(r.material_id, r.period): r.value for r in refresh.current(spark, table).collect()}

    assert land("1.json", ("a", "2024-01", 1.0, "2024-02-01T00:00:00"), ("a", "2024-02", 2.0, "2024-03-01T00:00:00")) == {("a", "2024-01"): 1.0, ("a", "2024-02"): 2.0}
    assert land("2.json", ("a", "2024-01", 1.5, "2024-04-01T00:00:00"), ("a", "2024-02", 9.0, "2024-01-01T00:00:00")) == {("a", "2024-01"): 1.5, ("a", "2024-02"): 2.0}
    (tmp_path / "table" / "data" / "commit=torn").mkdir()  # a batch that died
    whole = refresh.compacted(spark, table)
    assert len(refresh.log(spark, table).last().folders) == 1
    assert {(r.material_id, r.period): r.value for r in whole.collect()} == {("a", "2024-01"): 1.5, ("a", "2024-02"): 2.0}


def test_api_items(spark):
    rows = spark.createDataFrame([("a", (" 2024-02-31 ", "1.5")), ("a", ("2024-02-00", None)), ("a", ("2024-03-01", ".")), ("a", (None, None)), ("a", None)], "series_id string, item struct<date:string,value:string>")
    assert sorted(map(tuple, ingest.api_observations(rows).collect()), key=str) == [("a", "2024-02", 1.5, False), ("a", None, None, True), ("a", None, None, True)]


def test_cost_rules(spark):
    rules = spark.createDataFrame([(1, True, 0.5, 1.5, 3.0, False, False, False, C.SECOND_SOURCE_ROLE), (1, True, 0.5, 0.5, 3.0, False, False, False, C.SECOND_SOURCE_ROLE), (1, None, 0.5, 1.5, 3.0, False, False, False, "x"), (1, True, 0.5, 1.5, 3.0, False, True, False, None)], "version int, decision_support_only boolean, match double, evidence double, challenge double, automatic_acceptance boolean, automatic_rejection boolean, material_equals_product boolean, second_source_role string")
    assert [r.p for r in rules.select(C.rule_problem().alias("p")).collect()] == [None, "thresholds", "version or purpose", "policy"]
    assert C.CostRules(automatic_rejection=True).problems() == ["policy"] and C.CostRules(version=2).problems() == ["version or purpose"]
