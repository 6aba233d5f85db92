"""Inputs of the queries, derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import unit_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly unit price by brand: (material_id, mno, period, mi, value). Money adds up as decimals."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice", "l_quantity")
    # by part and month first: fewer rows meet the parts than there are line items
    each = li.groupBy("l_partkey", "month").agg(exact("l_extendedprice").alias("amount"), exact("l_quantity").alias("quantity"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = each.join(part, each.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("material_id"), "month").agg(F.sum("amount").cast("double").alias("amount"), F.sum("quantity").cast("double").alias("quantity"))
    return rows.select(
        "material_id",
        F.replace("material_id", F.lit("Brand#"), F.lit("")).cast("int").alias("mno"),
        F.date_format("month", "yyyy-MM").alias("period"),
        (F.year("month") * 12 + F.month("month")).cast("long").alias("mi"),
        (F.col("amount") / F.col("quantity")).alias("value"),
    )


FX1 = """obs_primary AS (
  SELECT p_brand AS material_id, CAST(replace(p_brand, 'Brand#', '') AS INT) AS mno, strftime(l_shipdate, '%Y-%m') AS period,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS mi,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


def obs_comparison(primary: DataFrame) -> DataFrame:
    """A second source with gaps and small differences."""
    mno, mi = F.col("mno"), F.col("mi")
    size = F.when(mno % 3 == 0, 0.001).when(mno % 3 == 1, 0.005).otherwise(0.02)
    kept = primary.where(((mi + mno) % 13 != 0) & (mno != 7))
    return kept.select("material_id", "mno", "period", (F.col("value") * (1 + ((mi * 7 + mno * 3) % 11 - 5) * size)).alias("value"))


FX2 = """obs_comparison AS (
  SELECT material_id, mno, period,
    value * (1 + ((mi * 7 + mno * 3) % 11 - 5) * CASE mno % 3 WHEN 0 THEN CAST(0.001 AS DOUBLE) WHEN 1 THEN CAST(0.005 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END) AS value
  FROM obs_primary WHERE (mi + mno) % 13 <> 0 AND mno <> 7)"""


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each brand: (material_id, mno, currency, display_unit, primary_unit, comparison_unit)."""
    mno = F.col("mno")
    ids = table(spark, sf_dir, "part").select(F.col("p_brand").alias("material_id")).distinct()
    m = ids.withColumn("mno", F.replace("material_id", F.lit("Brand#"), F.lit("")).cast("int"))
    pick = lambda a, b, c, d: F.when(mno % 5 == 0, a).when(mno % 3 == 0, b).when(mno % 3 == 1, c).otherwise(d)
    unit = pick("($/dmtu)", "($/mt)", "($/bbl)", "($/mmbtu)")
    return m.select("material_id", "mno", F.lit("USD").alias("currency"), unit.alias("display_unit"), unit.alias("primary_unit"), pick("U.S. Dollars per Metric Ton", "U.S. Dollars per Metric Ton", "Dollars per Barrel", "Dollars per Million BTU").alias("comparison_unit"))


def rules(m: DataFrame) -> DataFrame:
    mno = F.col("mno")
    return unit_rules(m, F.when(mno % 5 == 0, None).when(mno % 3 == 0, "metric ton").when(mno % 3 == 1, "barrel").otherwise("mmbtu"))


FX3 = """materials AS (
  SELECT material_id, mno, 'USD' AS currency, u AS display_unit, u AS primary_unit,
    CASE WHEN mno % 5 = 0 OR mno % 3 = 0 THEN 'U.S. Dollars per Metric Ton' WHEN mno % 3 = 1 THEN 'Dollars per Barrel' ELSE 'Dollars per Million BTU' END AS comparison_unit
  FROM (SELECT material_id, mno, CASE WHEN mno % 5 = 0 THEN '($/dmtu)' WHEN mno % 3 = 0 THEN '($/mt)' WHEN mno % 3 = 1 THEN '($/bbl)' ELSE '($/mmbtu)' END AS u
        FROM (SELECT DISTINCT p_brand AS material_id, CAST(replace(p_brand, 'Brand#', '') AS INT) AS mno FROM part)))"""

QUOTE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_QUOTES = """
  l_extendedprice / l_quantity AS price,
  CAST(20 + l_partkey % 41 AS DOUBLE) AS mat_ratio, CAST(5 + l_suppkey % 16 AS DOUBLE) AS fx_ratio,
  CAST(10 + l_orderkey % 16 AS DOUBLE) AS proc_ratio, CAST(5 + l_linenumber * 2 AS DOUBLE) AS energy_ratio,
  CAST((l_partkey + l_suppkey) % 21 AS DOUBLE) AS other_ratio,
  CAST(((l_partkey * 7 + l_orderkey * 3) % 41 - 20) AS DOUBLE) * CAST(0.75 AS DOUBLE) AS mat_rate,
  CAST((l_suppkey % 9 - 4) AS DOUBLE) * CAST(0.5 AS DOUBLE) AS fx_rate, CAST((l_orderkey % 7) AS DOUBLE) * CAST(0.5 AS DOUBLE) AS proc_rate,
  CAST(l_linenumber - 3 AS DOUBLE) AS energy_rate, CAST((l_partkey % 5 - 2) AS DOUBLE) * CAST(0.5 AS DOUBLE) AS other_rate,
  CAST((l_suppkey * 5 + l_orderkey) % 27 - 9 AS DOUBLE) + CAST(l_linenumber % 4 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS supplier_ask"""
FX4 = f"quotes AS (SELECT {', '.join(QUOTE_KEYS)}, {_QUOTES} FROM lineitem)"


def quotes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One supplier quote for each line item. dealt: the line items are dealt to all tasks, for queries that work long
    on each; a file of one row group would else be the work of one task."""
    parts = [c.strip() for c in _QUOTES.replace("\n", " ").split(", ")]
    columns, held = [], ""
    for p in parts:  # commas within calls don't end an expression
        held = f"{held}, {p}" if held else p
        if held.count("(") == held.count(")"):
            columns, held = [*columns, held], ""
    items = table(spark, sf_dir, "lineitem")
    if dealt:  # by number: partitions small in bytes would else be put together again
        items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey", "l_linenumber")
    return items.selectExpr(*QUOTE_KEYS, *columns)


def broken_quotes(q: DataFrame) -> DataFrame:
    """Quotes of which some are invalid, each for one of the reasons there are."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 50
    put = {
        "price": [(1, -F.col("price")), (6, None), (8, 1.7e308)],
        "mat_ratio": [(2, 101.0), (7, 100.0)],
        "fx_ratio": [(2, -1.0), (7, 100.0)],
        "proc_ratio": [(7, 0.0)],
        "energy_ratio": [(7, 0.0)],
        "other_ratio": [(4, 100.0), (7, 0.0)],
        "mat_rate": [(5, float("nan")), (7, -100.0)],
        "fx_rate": [(7, -50.0)],
        "energy_rate": [(3, -101.0)],
        "supplier_ask": [(8, 300.0), (9, float("inf"))],
    }

    def changed(name: str) -> Column:
        out = F.col(name)
        for at, value in put[name]:
            out = F.when(k == at, value).otherwise(out)
        return out.cast("double").alias(name)

    return q.select(*[changed(c) if c in put else c for c in q.columns])


def cases(reviews: DataFrame) -> DataFrame:
    """Reviewed quotes with the texts that people add to them."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    return reviews.withColumns(
        {
            "supplier": F.concat(F.lit("  Supplier "), F.col("l_suppkey"), F.lit(" ")),
            "product": F.when(line == 2, "").otherwise(F.concat(F.lit('part "'), part, F.lit('"'))),
            "quote_ref": F.concat(F.lit("-"), F.col("l_orderkey")),
            "quote_date": F.lit("2026-07-02"),
            "buyer": F.lit(None).cast("string"),
            "price_unit": F.when(part % 3 == 0, " USD/kg ").when(part % 3 == 1, "  "),
            "supplier_reason": F.when(line == 1, "=SUM(A1)").otherwise("material"),
            "note": F.lit("none"),
            "target_rate": F.when(line % 4 == 1, None).when(line % 4 == 2, -101.0).otherwise(-2.5),
        }
    )


CASE_SQL = """'Supplier ' || l_suppkey AS supplier, CASE WHEN l_linenumber = 2 THEN '' ELSE 'part "' || l_partkey || '"' END AS product, '-' || l_orderkey AS quote_ref, '2026-07-02' AS quote_date, '' AS buyer,
  CASE WHEN l_partkey % 3 = 0 THEN 'USD/kg' ELSE '' END AS price_unit, CASE WHEN l_linenumber = 1 THEN '=SUM(A1)' ELSE 'material' END AS supplier_reason, 'none' AS note,
  CASE WHEN l_linenumber % 4 = 1 THEN NULL WHEN l_linenumber % 4 = 2 THEN CAST(-101 AS DOUBLE) ELSE CAST(-2.5 AS DOUBLE) END AS target_rate"""


def scratch(spark: SparkSession) -> str:
    """A new folder for a query's own tables, below the one that the cluster shares."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='pricewell-')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in a folder of its own: made once, however often a query reads it."""
    place = scratch(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly prices as a wide grid of cells (doc, sheet, row, col, value): title, headers in row 5, units in
    row 6, periods in column 1 from row 7. Every 17th value is missing."""
    obs = obs_primary(spark, sf_dir)
    month = (F.col("mi") - 23880).cast("int")
    where = [F.lit("grid").alias("doc"), F.lit("monthly").alias("sheet")]
    heads = obs.select("material_id", "mno").distinct()
    missing = F.when((F.col("mi") + F.col("mno")) % 17 == 0, "…").otherwise(F.col("value").cast("string"))
    return (
        obs.select(*where, (month + 7).alias("row"), F.col("mno").alias("col"), missing.alias("value"))
        .unionByName(obs.select("mi", "period").distinct().select(*where, (F.col("mi") - 23880 + 7).cast("int").alias("row"), F.lit(1).alias("col"), F.replace("period", F.lit("-"), F.lit("M")).alias("value")))
        .unionByName(heads.select(*where, F.lit(5).alias("row"), F.col("mno").alias("col"), F.concat(F.lit("  Brand  "), "mno").alias("value")))
        .unionByName(heads.select(*where, F.lit(6).alias("row"), F.col("mno").alias("col"), F.when(F.col("mno") % 5 != 0, F.lit(" ($/mt) ")).otherwise("").alias("value")))
    )


FX5 = """cells AS (
  SELECT 'grid' AS doc, 'monthly' AS sheet, CAST(mi - 23880 + 7 AS INT) AS "row", mno AS col, CASE WHEN (mi + mno) % 17 = 0 THEN '…' ELSE CAST(value AS VARCHAR) END AS value FROM obs_primary
  UNION ALL SELECT DISTINCT 'grid', 'monthly', CAST(mi - 23880 + 7 AS INT), 1, replace(period, '-', 'M') FROM obs_primary
  UNION ALL SELECT DISTINCT 'grid', 'monthly', 5, mno, '  Brand  ' || mno FROM obs_primary
  UNION ALL SELECT DISTINCT 'grid', 'monthly', 6, mno, CASE WHEN mno % 5 <> 0 THEN ' ($/mt) ' ELSE '' END FROM obs_primary)"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body
