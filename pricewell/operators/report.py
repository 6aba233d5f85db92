"""Report rows of reviewed quotes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import apart, plain_number, signed, trimmed, trimmed_at_need
from .shouldcost import COMPONENTS, valid_target

LABELS = {"mat": "material", "fx": "currency", "proc": "processing", "energy": "energy", "other": "other"}
CASE_FIELDS = ("supplier", "product", "quote_ref", "quote_date", "buyer", "price_unit")
HEADER_FIELDS = (*CASE_FIELDS, "supplier_reason", "evidence_received", "conclusion", "note")
#: Fields that people fill in: their text is guarded against formulas.
FREE_TEXT = tuple(f for f in HEADER_FIELDS if f != "quote_date")
#: What a reader sees for an empty field; all others show EMPTY.
EMPTY, DEFAULTS = "not given", {"price_unit": "calculator unit", "conclusion": "waiting for the supplier's documents"}
NO_CONTEXT = "not linked to a signal"


def or_default(x: Column, default: str = EMPTY) -> Column:
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), F.lit(default))


def cost_rows(reviews: DataFrame, *keys: str) -> DataFrame:
    """Five rows for each quote: component, ratio, rate, impact."""
    row = lambda c: F.struct(F.lit(LABELS[c]).alias("component"), F.col(f"{c}_ratio").cast("double").alias("ratio"), F.col(f"{c}_rate").cast("double").alias("rate"), F.col(f"{c}_impact").alias("impact"))
    return reviews.select(*keys, F.explode(F.array(*map(row, COMPONENTS))).alias("r")).select(*keys, "r.*")


def snapshots(reviews: DataFrame, *keys: str) -> DataFrame:
    """One row for each quote: what its report is made of.

    valid and reason (null if valid: neither an invalid quote nor a target rate that is no rate), the header
    fields as trimmed texts ('' where a column is missing), target_rate, values, impacts, estimate, gap, the
    prices, verdict with tone, gap_text and evidence, and market_context.
    """
    have = set(reviews.columns)
    text = lambda c: trimmed_at_need(F.col(c).cast("string")) if c in have else F.lit("")
    target = F.col("target_rate").cast("double") if "target_rate" in have else F.lit(None).cast("double")
    # apart, twice as a reader may leave out either: so many texts in the code of a whole stage would be too much for the JVM to compile
    reason = F.coalesce(apart(F.col("invalid_reason")), F.when(~valid_target(target), "target_rate"))
    number = lambda c: F.col(c).cast("double").alias(c)
    context = F.coalesce(F.nullif(text("market_context"), F.lit("")), F.lit(NO_CONTEXT))
    return reviews.select(
        *keys,
        reason.alias("reason"),
        text("generated_at").alias("generated_at"),
        *[text(f).alias(f) for f in HEADER_FIELDS],
        target.alias("target_rate"),
        *[number(c) for c in ("price", "supplier_ask", "estimate", "gap", "unexplained", "new_price", "requested_price")],
        *[number(f"{c}_{x}") for c in COMPONENTS for x in ("ratio", "rate", "impact")],
        apart(F.col("verdict")).alias("verdict"),
        "tone",
        *[(F.col(c) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in (("gap_text", "string"), ("evidence", "array<string>"))],
        context.alias("market_context"),
    ).withColumn("valid", F.col("reason").isNull())


def shown(snapshots_: DataFrame) -> DataFrame:
    """snapshots() as a reader sees them: defaults for empty fields, and the target rate as a signed percentage."""
    target = F.when(F.col("target_rate").isNull(), EMPTY).otherwise(F.concat(signed(F.col("target_rate"), 2), F.lit("%")))
    return snapshots_.withColumns({f: or_default(F.col(f), DEFAULTS.get(f, EMPTY)) for f in HEADER_FIELDS} | {"target_rate": target})


class Row(NamedTuple):
    """A row of a report. What all reports share is str; columns are over snapshots(), a text is never null. number: the
    value's column where it is a number."""

    section: str
    field: str
    text: str | Column = ""
    unit: str | Column = ""
    number: str | None = None

    @property
    def free(self) -> bool:
        return self.field in FREE_TEXT

    def value(self, places: int) -> str | Column:
        return plain_number(F.col(self.number), places) if self.number else self.text


def report_rows() -> list[Row]:
    """The 42 rows of a report: 17 head rows with the header, three for each cost component, ten at the tail. Empty
    fields stay empty but for the price unit; so does a missing target."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda section, field, c, u: Row(section, field, unit=u, number=c)
    unit = or_default(F.col("price_unit"), DEFAULTS["price_unit"])
    rows = [Row("section", "field", "value", "unit"), Row("document", "name", "supplier price review"), Row("document", "generated_at", text("generated_at"))]
    rows += [Row("case", f, text(f)) for f in CASE_FIELDS]
    rows.append(Row("market", "context", text("market_context"), "primary source; second source is a cross-check"))
    for c, u in (("price", unit), ("supplier_ask", "%"), ("estimate", "%"), ("gap", "points"), ("unexplained", unit), ("new_price", unit), ("requested_price", unit)):
        rows.append(number("result", c, c, u))
    for c in COMPONENTS:
        rows += [number("cost", f"{LABELS[c]} {x}", f"{c}_{x}", u) for x, u in (("ratio", "%"), ("rate", "%"), ("impact", "points"))]
    # apart: so many rows in the code of a whole stage would be too much for the JVM to compile
    rows.append(Row("verdict", "code", F.coalesce(apart(F.col("verdict")), F.lit("")), "decision support"))
    rows += [Row("verdict", c, text(c)) for c in ("tone", "gap_text")]
    rows.append(Row("verdict", "evidence", F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), "; ")))
    rows += [Row(section, f, text(f)) for section, f in (("supplier", "supplier_reason"), ("supplier", "evidence_received"), ("purchase", "conclusion"))]
    rows += [number("purchase", "target_rate", "target_rate", "%"), Row("purchase", "note", text("note"))]
    return [*rows, Row("policy", "automatic decision", "no", "a material's rise is not the product's")]


def concatenated(parts: list[str | Column]) -> Column:
    """The parts as one text; neighbours that are str become one constant."""
    out: list[str | Column] = []
    for p in parts:
        if out and isinstance(p, str) and isinstance(out[-1], str):
            out[-1] += p
        else:
            out.append(p)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in out])


def report_text(snapshots_: DataFrame, *keys: str, line: Callable[[Row], list[str | Column]], sep: str) -> DataFrame:
    """(keys, text) of valid snapshots: the lines of report_rows() as one text, each put together from the parts that
    `line` gives for its row. No row of a report is ever made by itself."""
    parts = [p for i, row in enumerate(report_rows()) for p in ([sep] if i else []) + line(row)]
    return snapshots_.where("reason IS NULL").select(*keys, concatenated(parts).alias("text"))


def report_cells(snapshots_: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """(keys, cells) of valid snapshots: `cells` are report_rows() as (section, field, value, unit, free)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    cell = lambda r: F.struct(F.lit(r.section).alias("section"), F.lit(r.field).alias("field"), lit(r.value(places)).alias("value"), lit(r.unit).alias("unit"), F.lit(r.free).alias("free"))
    return snapshots_.where("reason IS NULL").select(*keys, F.array(*map(cell, report_rows())).alias("cells"))


def report_long(reviews: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """Key/value rows (pos, section, field, value, unit, free) of each quote with a valid snapshot."""
    rows = report_cells(snapshots(reviews, *keys), *keys, places=places)
    return rows.select(*keys, F.posexplode("cells").alias("pos", "r")).select(*keys, "pos", "r.*")
