"""Source status, publication and versions of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Log

STATUS = "source string, status string, last_attempt_at string, last_success_at string, latest_period string, updated_on string, sha256 string, url string, is_stale boolean, warnings array<string>"
FIELDS = tuple(x.split(" ")[0] for x in STATUS.split(", "))
RUN = ("latest_period", "at", "updated_on", "sha256", "url")


def upsert(previous: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """Rows of `new`, and those of `previous` whose key it lacks."""
    return new.unionByName(previous.join(new, key, "left_anti"))


def run_record(runs: DataFrame, at: str) -> DataFrame:
    """runs with `at`, the time of the run, and with nulls for the fields of RUN that it lacks."""
    have = runs.withColumn("at", F.lit(at))
    return have.select(*[c for c in runs.columns if c not in RUN], *[(F.col(c) if c in have.columns else F.lit(None)).cast("string").alias(c) for c in RUN])


def _success(source: str, run: DataFrame) -> DataFrame:
    at = F.col("at")
    return run.select(F.lit(source).alias("source"), F.lit("SUCCESS").alias("status"), at.alias("last_attempt_at"), at.alias("last_success_at"), "latest_period", "updated_on", "sha256", "url")


def primary_refreshed(previous: DataFrame, run: DataFrame) -> DataFrame:
    """The primary source succeeded: its row is that of the run, not stale and without warnings; the other's
    stays or is NOT_CONFIGURED. run: one row with the fields of RUN (run_record())."""
    new = _success("primary", run).withColumns({"is_stale": F.lit(False), "warnings": F.array().cast("array<string>")})
    default = previous.sparkSession.createDataFrame([("comparison", "NOT_CONFIGURED")], "source string, status string")
    default = default.select("source", "status", *[F.lit(None).cast("string").alias(c) for c in FIELDS[2:8]], F.lit(False).alias("is_stale"), F.array().cast("array<string>").alias("warnings"))
    return upsert(upsert(default, previous.select(*FIELDS)), new)


def comparison_refreshed(previous: DataFrame, run: DataFrame) -> DataFrame:
    """The comparison source succeeded. Needs a successful primary; stale mark and warnings are kept."""
    if previous.where("source = 'primary' AND status = 'SUCCESS'").isEmpty():
        raise ValueError("the primary source has not succeeded")
    kept = previous.where("source = 'comparison'").select("source", "is_stale", "warnings")
    row = _success("comparison", run).join(kept, "source", "left")
    row = row.withColumns({"is_stale": F.coalesce("is_stale", F.lit(False)), "warnings": F.coalesce("warnings", F.array().cast("array<string>"))})
    return upsert(previous.select(*FIELDS), row.select(*FIELDS))


def _published(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, order=())


def publish(obs: DataFrame, violations: DataFrame, path: str) -> bool:
    """Publish the table as a snapshot of the log in `path` only if no rule is violated; else leave what was published
    before. Readers (published()) see whole snapshots, so a job that fails on its way changes nothing for them."""
    if not violations.isEmpty():
        return False
    _published(obs.sparkSession, path).replace(obs)
    return True


def publish_gated(obs: DataFrame, gate: dict[str, Column], path: str) -> bool:
    """The same with conditions that no row may meet (quality.row_gate()): they are counted while the rows are written,
    so that obs is made once, and what was written becomes a snapshot only if the counts are zero."""
    return _published(obs.sparkSession, path).replace(obs, gate) is not None


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The last snapshot, or None."""
    return _published(spark, path).read()


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content hash the manifest lacks."""
    return files.join(manifest.select("sha256"), "sha256", "left_anti")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(material_id, period, old_value, new_value, change): inserted, removed, revised or same."""
    o, n = old.select("material_id", "period", F.col("value").alias("old_value")), new.select("material_id", "period", F.col("value").alias("new_value"))
    change = F.when(F.col("old_value").isNull(), "inserted").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") == F.col("new_value"), "same").otherwise("revised")
    return o.join(n, ["material_id", "period"], "full").withColumn("change", change)
