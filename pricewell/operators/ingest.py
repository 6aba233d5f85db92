"""From landed cells and documents to the long table of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import comparison_number, date_period, finite, grid_period, normalize_header, normalize_text, primary_number


def resolve_columns(cells: DataFrame, aliases: DataFrame, header_row: int = 5) -> DataFrame:
    """(material_id, col, n_matches): the one column whose header is a name of the material.

    cells: (row, col, value); aliases: (material_id, names array). col is null unless exactly one matches.
    """
    names = aliases.select("material_id", F.explode("names").alias("name")).select("material_id", normalize_header(F.col("name")).alias("header")).distinct()
    headers = cells.where(F.col("row") == header_row).select("col", normalize_header(F.col("value")).alias("header")).where("header <> ''")
    found = names.join(headers, "header").groupBy("material_id").agg(F.count_distinct("col").alias("n"), F.min("col").alias("col"))
    out = aliases.select("material_id").join(found, "material_id", "left")
    return out.select("material_id", F.when(F.col("n") == 1, F.col("col")).alias("col"), F.coalesce("n", F.lit(0)).alias("n_matches"))


def melt_grid(cells: DataFrame, columns: DataFrame, first_row: int = 7, period_col: int = 1) -> DataFrame:
    """(material_id, period, value, ingest_ord). Rows whose period can't be read, and bad values, are skipped."""
    body = cells.where(F.col("row") >= first_row)
    periods = body.where(F.col("col") == period_col).select("row", grid_period(F.col("value")).alias("period")).where("period IS NOT NULL")
    values = body.join(columns.where("col IS NOT NULL").select("material_id", "col"), "col").select("row", "material_id", primary_number(F.col("value")).alias("value"))
    return values.where("value IS NOT NULL").join(periods, "row").select("material_id", "period", "value", F.col("row").cast("long").alias("ingest_ord"))


def unit_row(cells: DataFrame, columns: DataFrame, row: int = 6) -> DataFrame:
    """(material_id, unit): the unit cell of each resolved column; null where it is empty."""
    units = cells.where(F.col("row") == row).select("col", normalize_text(F.col("value")).alias("unit"))
    return columns.where("col IS NOT NULL").select("material_id", "col").join(units, "col", "left").select("material_id", F.nullif(F.col("unit"), F.lit("")).alias("unit"))


def api_observations(rows: DataFrame) -> DataFrame:
    """(series_id, period, value, bad_date) of rows (series_id, item struct<date, value>).

    A missing value is skipped, but a bad date is reported even then, and so is that of an item without
    fields. Null items, which were no objects, are skipped.
    """
    out = rows.where("item IS NOT NULL").select("series_id", date_period(F.col("item.date")).alias("period"), comparison_number(F.col("item.value")).alias("value"))
    out = out.withColumn("bad_date", F.col("period").isNull())
    return out.where("bad_date OR value IS NOT NULL")


def api_payloads(rows: DataFrame) -> DataFrame:
    """(series_id, pos, period, value, problem) of raw payloads (series_id, payload), whatever JSON they hold.

    problem: `no list` (pos null) where the payload is no JSON object with a list of observations; `no object` for an
    item that is none, which is skipped; `bad date` for one whose date is no day in text, whether it has a value or
    not; `no value` for one whose value is missing, of another type than text or number, or not a positive finite
    number. Rows without a problem have both period and value. An empty list gives no rows.
    """
    payload = F.try_parse_json("payload")
    items = F.try_variant_get(payload, "$.observations", "array<variant>")
    each = rows.select("series_id", F.posexplode_outer(F.coalesce(items, F.array(F.parse_json(F.lit("null"))))).alias("pos", "item"), items.isNull().alias("none"))
    each = each.where("item IS NOT NULL OR none")  # of an empty list nothing is left
    kind = lambda path: F.schema_of_variant(F.try_variant_get("item", path, "variant"))
    text = lambda path: F.try_variant_get("item", path, "string")
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    number = F.when(kind("$.value") == "STRING", comparison_number(text("$.value"))).when(kind("$.value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("item", "$.value", "double"))
    found = each.select(
        "series_id",
        F.when(~F.col("none"), F.col("pos")).alias("pos"),
        F.when(is_object & (kind("$.date") == "STRING"), date_period(text("$.date"))).alias("period"),
        F.when(is_object & finite(number) & (number > 0), number).alias("value"),
        "none",
        is_object.alias("is_object"),
    )
    problem = F.when(F.col("none"), "no list").when(~F.col("is_object"), "no object").when(F.col("period").isNull(), "bad date").when(F.col("value").isNull(), "no value")
    return found.select("series_id", "pos", "period", "value", problem.alias("problem"))


def series_metadata(rows: DataFrame) -> DataFrame:
    """One row for each wanted series with `problem` null if its metadata is in order.

    rows: (wanted_id, id, title, frequency_short, units, seasonal_adjustment, last_updated), several for one wanted id at fault.
    """
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = ("id", "title", "frequency_short", "units", "seasonal_adjustment", "last_updated")
    one = rows.groupBy("wanted_id").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in first])
    problem = (
        F.when(F.col("n") != 1, "not exactly one")
        .when(F.coalesce(F.col("id") != F.col("wanted_id"), F.lit(True)), "other id")
        .when(F.coalesce(F.col("frequency_short") != "M", F.lit(True)), "not monthly")
        .when(clean("title").isNull() | clean("units").isNull(), "no title or units")
    )
    return one.select("wanted_id", *[clean(c).alias(c) for c in first[1:]], problem.alias("problem"))


#: What a configuration may say of a material, and what stands where it does not.
CONFIGURED = {"name": None, "local_name": None, "currency": "USD", "display_unit": None, "source_column": None, "source_unit": None, "is_derived": False, "attribution": None, "series_id": None, "ord": None}


def configured(materials: DataFrame) -> DataFrame:
    """material_id and all of CONFIGURED: texts trimmed and null where empty; the name is the id, and the source's
    unit and column are the display unit and the name, where nothing else is given. Other columns are left out."""
    have = set(materials.columns)

    def given(name: str, default) -> Column:
        kind = "boolean" if name == "is_derived" else "int" if name == "ord" else "string"
        c = F.col(name) if name in have else F.lit(None)
        c = c.cast(kind) if kind != "string" else F.nullif(F.trim(c.cast("string")), F.lit(""))
        return (F.coalesce(c, F.lit(default)) if default is not None else c).alias(name)

    m = materials.select("material_id", *[given(k, v) for k, v in CONFIGURED.items()])
    name = F.coalesce("name", "material_id")
    return m.withColumns({"name": name, "source_column": F.coalesce("source_column", name), "source_unit": F.coalesce("source_unit", "display_unit")})


def full_header(obs: DataFrame, materials: DataFrame) -> DataFrame:
    """One row for every configured material: names, currency, units, column, flag, attribution and order of the
    configuration, with its count (0 if it has no observations), first and latest period."""
    counts = obs.groupBy("material_id").agg(F.count("*").alias("n_obs"), F.min("period").alias("first_period"), F.max("period").alias("latest_period"))
    return configured(materials).join(counts, "material_id", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))


def series_header(obs: DataFrame, materials: DataFrame) -> DataFrame:
    """Currency and unit of each configured series with observations, its count, first and latest period."""
    counts = obs.groupBy("material_id").agg(F.count("*").alias("n_obs"), F.min("period").alias("first_period"), F.max("period").alias("latest_period"))
    return counts.join(materials, "material_id").select("material_id", F.coalesce("currency", F.lit("USD")).alias("currency"), "display_unit", "n_obs", "first_period", "latest_period")


def profile_cells(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with these columns as text for profiling: dates and times in ISO form, numbers that aren't finite
    null, everything else as it is printed."""

    def text(name: str) -> Column:
        c, kind = F.col(name), rows.schema[name].dataType.typeName()
        if kind in ("float", "double"):
            return F.when(finite(c), c.cast("string"))
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c.cast("string")

    return rows.withColumns({c: text(c) for c in columns})
