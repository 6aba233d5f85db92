"""CSV lines built as columns, with a byte-order mark on the header, which Spark's CSV writer cannot write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import csv_number, csv_plain_number, csv_text, filename_part
from ..operators import report

PRICE_HEADER = ("material", "name", "period", "value", "mode", "currency", "unit", "source_unit", "source", "demo_data", "frequency", "dataset_latest", "synced_at")
COMPARE_HEADER = ("material", "name", "period", "primary_value", "comparison_value", "diff", "diff_pct", "primary_unit", "comparison_unit", "comparison_series", "primary_source", "comparison_source", "automatic_fallback")
REPORT_HEADER = ("section", "field", "value", "unit")
BARE = r"^-?[0-9]+(\.[0-9]+)?$"
MARK = "﻿"


def header(names) -> str:
    return MARK + ",".join(f'"{n}"' for n in names)


def price_lines(view: DataFrame, materials: DataFrame, source: str, latest: str, synced_at: str) -> DataFrame:
    """(material_id, period, line) of a slice view; index mode has no currency, and points for a unit."""
    rows = view.join(materials, "material_id")
    index = F.col("index_mode")
    cells = [
        csv_text(F.col("material_id")),
        csv_text(F.col("material_id")),
        csv_text(F.col("period")),
        csv_number(F.col("shown")),
        csv_text(F.when(index, "index (first = 100)").otherwise("price")),
        csv_text(F.when(index, "—").otherwise(F.col("currency"))),
        csv_text(F.when(index, "index points").otherwise(F.col("display_unit"))),
        csv_text(F.col("primary_unit")),
        csv_text(F.lit(source)),
        csv_text(F.lit("no")),
        csv_text(F.lit("monthly")),
        csv_text(F.lit(latest)),
        csv_text(F.lit(synced_at)),
    ]
    return rows.select("material_id", "period", F.concat_ws(",", *cells).alias("line"))


def compare_lines(rows: DataFrame, materials: DataFrame, comparison_series: str = "") -> DataFrame:
    """(material_id, period, line) of compared months; numbers stay unguarded, so that -1 is a number."""
    out = rows.join(materials, "material_id")
    number = lambda c: csv_number(F.col(c), 6)
    cells = [csv_text(F.col("material_id")), csv_text(F.col("material_id")), csv_text(F.col("period")), number("primary_value"), number("comparison_value"), number("diff"), number("diff_pct"), csv_text(F.col("primary_unit")), csv_text(F.col("comparison_unit")), csv_text(F.lit(comparison_series)), csv_text(F.lit("primary")), csv_text(F.lit("comparison")), csv_text(F.lit("no"))]
    return out.select("material_id", "period", F.concat_ws(",", *cells).alias("line"))


def report_line(section: Column, field: Column, value: Column, unit: Column, free: Column) -> Column:
    """The line of a report row: numbers bare, text quoted, what people typed guarded."""
    quoted = F.when(free, csv_text(value)).otherwise(csv_text(value, guard=False))
    cell = F.when(value.rlike(BARE) & ~free, value).otherwise(quoted)
    plain = lambda c: csv_text(c, guard=False)
    return F.concat_ws(",", plain(section), plain(field), cell, plain(unit))


CELL = ("section", "field", "value", "unit", "free")


def report_lines(report: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, line) of a key/value report."""
    return report.select(*keys, "pos", report_line(*[F.col(c) for c in CELL]).alias("line"))


def report_text(cells: Column) -> Column:
    """The lines of one report's cells as the text of its file, without the mark at the start."""
    return F.array_join(F.transform(cells, lambda r: report_line(*[r[c] for c in CELL])), "\r\n")


def report_files(snapshots: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """(keys, text) of valid snapshots: what report_text() makes of their report_cells(), without making the cells."""
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    plain = lambda x: quoted(x) if isinstance(x, str) else csv_text(x, guard=False)

    def cell(row: report.Row) -> str | Column:
        if row.number:
            return csv_plain_number(F.col(row.number), places)
        if row.free:
            return csv_text(row.text)
        return quoted(row.text) if isinstance(row.text, str) else F.when(row.text.rlike(BARE), row.text).otherwise(plain(row.text))

    line = lambda r: [f"{quoted(r.section)},{quoted(r.field)},", cell(r), ",", plain(r.unit)]
    return report.report_text(snapshots, *keys, line=line, sep="\r\n")


def write_lines(lines: DataFrame, names, path: str, order: list[str], line_end: str = "\n") -> None:
    """Write one file with its header. An export of a view or report is small; tables go to write.csv."""
    body = lines.select(F.lit(1).alias("_k"), *order, "line")
    top = lines.sparkSession.range(1).select(F.lit(0).alias("_k"), *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in order], F.lit(header(names)).alias("line"))
    top.unionByName(body).coalesce(1).sortWithinPartitions("_k", *order).select("line").write.mode("overwrite").option("lineSep", line_end).text(path)


def report_labels(product: Column, *keys: Column) -> Column:
    """A file label for each report: its product as a file name, and its keys, which tell equal products apart."""
    return F.concat_ws("-", filename_part(product, "report"), *[filename_part(k.cast("string"), "none") for k in keys])


def write_reports(reports: DataFrame, path: str, label: str = "label", cells: str = "cells") -> None:
    """Write each report of a table (label, cells) as one CSV file in a folder `report=<label>`, with the mark at its
    start and `\r\n` after each line. Tasks write theirs side by side, one file at a time; labels must be unique."""
    text = F.concat(F.lit(MARK), report_text(F.col(cells)))
    reports.select(F.col(label).alias("report"), text.alias("value")).write.mode("overwrite").partitionBy("report").option("lineSep", "\r\n").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, pos, section, field, value, unit) of the files of write_reports(), as texts, guards included."""
    files = spark.read.schema("value string, report string").text(path, wholetext=True)
    lines = F.split(F.regexp_replace(F.rtrim("value", F.lit("\r\n")), f"^{MARK}", ""), "\r\n(?=\"(?:document|case|market|result|cost|verdict|supplier|purchase|policy)\",)")
    rows = files.select("report", F.posexplode(lines).alias("pos", "line"))
    return rows.select("report", "pos", F.from_csv("line", F.lit("section string, field string, value string, unit string"), {"escape": '"', "multiLine": "true"}).alias("r")).select("report", "pos", "r.*")
