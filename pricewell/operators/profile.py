"""Profiles of cell tables (doc, sheet, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHEET = ("doc", "sheet")


def _filled_rows(cells: DataFrame) -> DataFrame:
    return cells.where("value IS NOT NULL AND trim(value) <> ''").groupBy(*SHEET, "row").agg(F.count("*").alias("n_cells"))


def head_rows(cells: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows of each sheet that aren't empty."""
    w = Window.partitionBy(*SHEET).orderBy("row")
    return _filled_rows(cells).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def tail_rows(cells: DataFrame, limit: int = 8, reach: int = 100) -> DataFrame:
    """The last such rows within the last reach + 1 row numbers."""
    last = cells.groupBy(*SHEET).agg(F.max("row").alias("_last"))
    w = Window.partitionBy(*SHEET).orderBy(F.desc("row"))
    rows = _filled_rows(cells).join(last, list(SHEET)).where(F.col("row") >= F.greatest(F.lit(1), F.col("_last") - reach))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n", "_last")


def header_candidates(cells: DataFrame, keywords: list[str], scan: int = 30) -> DataFrame:
    """Of the first rows, those with a cell that holds a keyword, and which keywords, sorted."""
    hits = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower("value"), k))
    found = cells.where(F.col("row") <= scan).select(*SHEET, "row", F.explode(hits).alias("keyword"))
    return found.groupBy(*SHEET, "row").agg(F.array_join(F.sort_array(F.collect_set("keyword")), ",").alias("keywords"))


def sheet_shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count("value").alias("n_cells"))
