"""The history of many versions of a table as intervals of validity.

Versions are whole tables with ascending numbers. A row (keys, value, valid_from, valid_to) says that from version
valid_from on the key had this value, and that valid_to, if it isn't null, is the first version in which it had
another or none. A key that goes and comes back has an interval for each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("material_id", "period")


def numbered(versions: DataFrame, version: str = "version") -> DataFrame:
    """(version, next_version) of the numbers that occur; the last has none. One row a version."""
    each = versions.select(version).distinct()
    return each.select(version, F.lead(version).over(Window.orderBy(version)).alias("next_version"))


def intervals(versions: DataFrame, numbers: DataFrame | None = None, keys: tuple[str, ...] = KEYS, value: str = "value", version: str = "version") -> DataFrame:
    """Intervals of a table (version, keys, value) of any number of versions, by one window pass over it.

    numbers: (version) of all versions, empty ones included; those that have rows if it isn't given. A null value is
    a value; keys must be unique in a version.
    """
    w = Window.partitionBy(*keys).orderBy(version)
    at = numbered(numbers if numbers is not None else versions, version)
    rows = versions.join(at, version)
    before, said = F.lag("next_version").over(w), F.lag(value).over(w)
    starts = F.when(before.eqNullSafe(F.col(version)) & said.eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = rows.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.max_by(value, version).alias(value), F.min(version).alias("valid_from"), F.max_by("next_version", version).alias("valid_to"))
    return out.drop("_run")


def as_of(history: DataFrame, version: Column | int) -> DataFrame:
    """The table as of a version: its keys and values."""
    at = version if isinstance(version, Column) else F.lit(version)
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))).drop("valid_from", "valid_to")


def extended(history: DataFrame, rows: DataFrame, version: int, keys: tuple[str, ...] = KEYS, value: str = "value") -> DataFrame:
    """history with one more version, which must come after all others: only open intervals are compared with it."""
    closed = history.where("valid_to IS NOT NULL")
    was = history.where("valid_to IS NULL").select(*keys, F.col(value).alias("_was"), "valid_from", F.lit(True).alias("_had"))
    now = rows.select(*keys, F.col(value).alias("_now"), F.lit(True).alias("_has"))
    both = was.join(now, list(keys), "full")
    same = F.col("_had").isNotNull() & F.col("_has").isNotNull() & F.col("_was").eqNullSafe(F.col("_now"))
    kind = history.schema["valid_from"].dataType
    number, none = F.lit(version).cast(kind), F.lit(None).cast(kind)
    old = F.when(F.col("_had"), F.struct(F.col("_was").alias(value), "valid_from", F.when(same, none).otherwise(number).alias("valid_to")))
    new = F.when(F.col("_has") & ~same, F.struct(F.col("_now").alias(value), number.alias("valid_from"), none.alias("valid_to")))
    made = both.select(*keys, F.explode(F.filter(F.array(old, new), lambda x: x.isNotNull())).alias("i")).select(*keys, "i.*")
    return closed.select(*keys, value, "valid_from", "valid_to").unionByName(made)


def changes(history: DataFrame, after: int, until: int, keys: tuple[str, ...] = KEYS, value: str = "value") -> DataFrame:
    """(keys, old_value, new_value, change) between two versions: inserted, removed or revised."""
    old, new = (as_of(history, v).select(*keys, F.col(value).alias(n), F.lit(True).alias(f"_{n}")) for v, n in ((after, "old_value"), (until, "new_value")))
    both = old.join(new, list(keys), "full")
    change = F.when(F.col("_old_value").isNull(), "inserted").when(F.col("_new_value").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "revised")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "old_value", "new_value", "change")
