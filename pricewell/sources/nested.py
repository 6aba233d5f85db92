"""Nested JSON documents of three kinds: a source's series, the comparison of two sources, and signals.

A document is a head (version, source, counts) and a map from material to a typed entry. A run deals its entries
over as many documents as their number asks for, writes one file a document, and last a manifest with the digest
of each; readers take what a manifest names, so a run that failed on its way is never read. All kinds come back
as they went, nulls and empty lists included.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, ingest, signals

#: Fixed value: the version that readers accept.
VERSION = 1
#: Entries of one document, about.
ENTRIES = 1000

SOURCE_ENTRY = """struct<id:string, name:string, localName:string, currency:string, displayUnit:string, sourceColumn:string, sourceUnit:string, isDerived:boolean, attribution:string,
  observationCount:long, firstPeriod:string, latestPeriod:string, observations:array<struct<period:string,value:double>>>"""
COMPARISON_ENTRY = """struct<id:string, name:string, primary:struct<latestPeriod:string,displayUnit:string,sourceUnit:string>, comparison:struct<seriesId:string,latestPeriod:string,displayUnit:string,sourceUnit:string>,
  overlapCount:long, firstOverlapPeriod:string, latestOverlapPeriod:string, comparisonAvailable:boolean, comparisonReason:string, latestPrimaryValue:double, latestComparisonValue:double, latestDifferencePercent:double,
  meanAbsolutePercent:double, maxAbsolutePercent:double, observations:array<struct<period:string,primaryValue:double,comparisonValue:double,difference:double,differencePercent:double>>>"""
SIGNAL_ENTRY = """struct<id:string, name:string, currency:string, displayUnit:string, sourceUnit:string, latestPeriod:string, latestValue:double,
  changes:struct<oneMonthPercent:double,threeMonthPercent:double,sixMonthPercent:double,twelveMonthPercent:double>,
  statistics:struct<average:double,high:double,low:double,latestVsAveragePercent:double,rangePositionPercent:double,positionLabel:string,volatilityPercent:double>,
  trend:string, signal:struct<code:string,label:string,priority:string,group:string,action:string>,
  corroboration:struct<status:string,confidence:string,latestDifferencePercent:double,meanAbsolutePercent:double,note:string>, evidence:array<string>, limitations:array<string>>"""
_TOP = "schemaVersion int, generatedAt string, isRealData boolean"


@dataclass(frozen=True)
class Kind:
    """A kind of document: the name of its map, the type of an entry, and the fields of its head."""

    name: str
    entries: str
    entry: str
    head: str

    @property
    def schema(self) -> str:
        return f"{_TOP}, {self.head}, {self.entries} map<string,{self.entry}>"


SOURCE = Kind("source", "series", SOURCE_ENTRY, "source string, frequency string, dataset struct<latestPeriod:string,seriesCount:long,observationCount:long>")
COMPARISON = Kind("comparison", "materials", COMPARISON_ENTRY, "primarySource string, comparisonSource string, sourcePolicy struct<primaryRole:string,comparisonRole:string,automaticFallback:boolean>, summary struct<materialCount:long,comparableCount:long>")
SIGNALS = Kind("signals", "materials", SIGNAL_ENTRY, "latestPeriod string, primarySource string, comparisonSource string, thresholds map<string,double>, summary struct<materialCount:long,priorityCounts:map<string,long>,signalCounts:map<string,long>>")
KINDS = {k.name: k for k in (SOURCE, COMPARISON, SIGNALS)}


def _entry(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def source_entries(obs: DataFrame, materials: DataFrame) -> DataFrame:
    """(material_id, entry) of SOURCE: the header of each series of `materials` that has observations, and those in
    order of period. A series is one row here: twelve observations a year."""
    own = obs.groupBy("material_id").agg(F.sort_array(F.collect_list(F.struct("period", "value"))).alias("observations"))
    h = ingest.full_header(obs, materials).where("n_obs > 0").join(own, "material_id")
    c = F.col
    return h.select("material_id", _entry(id=c("material_id"), name=c("name"), localName=c("local_name"), currency=c("currency"), displayUnit=c("display_unit"), sourceColumn=c("source_column"), sourceUnit=c("source_unit"), isDerived=c("is_derived"), attribution=c("attribution"), observationCount=c("n_obs"), firstPeriod=c("first_period"), latestPeriod=c("latest_period"), observations=c("observations")).cast(SOURCE_ENTRY).alias("entry"))


def comparison_entries(primary: DataFrame, comparison: DataFrame, compatible: DataFrame, materials: DataFrame) -> DataFrame:
    """(material_id, entry) of COMPARISON for each material with common months; without rows where units differ."""
    rows = compare.compared(primary, comparison, compatible)
    listed = rows.groupBy("material_id").agg(F.sort_array(F.collect_list(F.struct("period", F.col("primary_value").alias("primaryValue"), F.col("comparison_value").alias("comparisonValue"), F.col("diff").alias("difference"), F.col("diff_pct").alias("differencePercent")))).alias("observations"))
    latest = lambda df, name: df.groupBy("material_id").agg(F.max("period").alias(name))
    s = compare.full_summary(primary, comparison, compatible).withColumnRenamed("latest_period", "last_common")
    s = s.join(compare.overlap(primary, comparison).select("material_id", "first_common"), "material_id").join(compatible.select("material_id", "primary_unit", "comparison_unit"), "material_id")
    s = s.join(latest(primary, "primary_latest"), "material_id").join(latest(comparison, "comparison_latest"), "material_id").join(listed, "material_id", "left").join(ingest.configured(materials).select("material_id", "name", "display_unit", "series_id"), "material_id")
    c = F.col
    return s.select(
        "material_id",
        _entry(
            id=c("material_id"),
            name=c("name"),
            primary=F.struct("primary_latest", "display_unit", "primary_unit"),
            comparison=F.struct("series_id", "comparison_latest", "display_unit", "comparison_unit"),
            overlapCount=c("n_common"),
            firstOverlapPeriod=c("first_common"),
            latestOverlapPeriod=c("last_common"),
            comparisonAvailable=c("comparable"),
            comparisonReason=c("reason"),
            latestPrimaryValue=c("latest_primary"),
            latestComparisonValue=c("latest_comparison"),
            latestDifferencePercent=c("latest_diff_pct"),
            meanAbsolutePercent=c("mean_abs_pct"),
            maxAbsolutePercent=c("max_abs_pct"),
            observations=F.coalesce("observations", F.array()),
        )
        .cast(COMPARISON_ENTRY)
        .alias("entry"),
    )


def signal_entries(latest: DataFrame, summary: DataFrame, materials: DataFrame, thresholds: signals.Thresholds = signals.Thresholds()) -> DataFrame:
    """(material_id, entry) of SIGNALS from latest_signals() and full_summary()."""
    rows = signals.with_advice(signals.corroboration(latest, summary, thresholds)).join(ingest.configured(materials), "material_id")
    c, lines = F.col, signals.evidence()
    six = lambda name: F.round(name, 6)
    return rows.select(
        "material_id",
        _entry(
            id=c("material_id"),
            name=c("name"),
            currency=c("currency"),
            displayUnit=c("display_unit"),
            sourceUnit=c("source_unit"),
            latestPeriod=c("period"),
            latestValue=six("value"),
            changes=F.struct("c1", "c3", "c6", "c12"),
            statistics=F.struct(six("avg12"), six("high12"), six("low12"), six("vs_avg12"), six("range_position"), "range_label", six("volatility")),
            trend=c("trend"),
            signal=F.struct("signal", "label", "priority", "signal_group", "action"),
            corroboration=F.struct("corroboration", "confidence", "latest_diff_pct", "mean_abs_pct", "note"),
            evidence=F.slice(lines, 1, 4),
            limitations=F.slice(lines, 5, 2),
        )
        .cast(SIGNAL_ENTRY)
        .alias("entry"),
    )


def source_head(entries: DataFrame, source: str, frequency: str = "monthly") -> DataFrame:
    """The head of SOURCE documents: one row."""
    e = entries.agg(F.max("entry.latestPeriod").alias("a"), F.count("*").alias("b"), F.coalesce(F.sum("entry.observationCount"), F.lit(0)).alias("c"))
    return e.select(F.lit(source).alias("source"), F.lit(frequency).alias("frequency"), F.struct("a", "b", "c").alias("dataset"))


def comparison_head(entries: DataFrame, primary: str, comparison: str) -> DataFrame:
    e = entries.agg(F.count("*").alias("a"), F.count_if("entry.comparisonAvailable").alias("b"))
    policy = F.struct(F.lit("PRIMARY"), F.lit("INDEPENDENT_COMPARISON_ONLY"), F.lit(False))
    return e.select(F.lit(primary).alias("primarySource"), F.lit(comparison).alias("comparisonSource"), policy.alias("sourcePolicy"), F.struct("a", "b").alias("summary"))


def signals_head(entries: DataFrame, primary: str, comparison: str, thresholds: signals.Thresholds = signals.Thresholds()) -> DataFrame:
    """The head of SIGNALS documents; all three priorities are counted, signals only where there are any."""
    codes = sorted(signals.PRIORITIES)
    e = entries.agg(F.max("entry.latestPeriod").alias("latest"), F.count("*").alias("n"), *[F.count_if(F.col("entry.signal.priority") == p).alias(p) for p in ("HIGH", "MEDIUM", "LOW")], *[F.count_if(F.col("entry.signal.code") == s).alias(s) for s in codes])
    tally = lambda names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))
    limits = F.create_map(*[F.lit(x) for pair in vars(thresholds).items() for x in pair])
    return e.select("latest", F.lit(primary).alias("primarySource"), F.lit(comparison).alias("comparisonSource"), limits.alias("thresholds"), F.struct("n", tally(["HIGH", "MEDIUM", "LOW"]), F.map_filter(tally(codes), lambda _, v: v > 0)).alias("summary")).withColumnRenamed("latest", "latestPeriod")


def documents(kind: Kind, entries: DataFrame, head: DataFrame, generated_at: str, parts: int | None = None, real: bool = True) -> DataFrame:
    """(part, n_entries, sha256, value): JSON documents that together hold all entries, dealt by a hash of the id.

    Each has the whole head. `parts` follows from the number of entries, so that a document stays small; no
    entries give one document with an empty map.
    """
    if parts is None:
        parts = max(1, -(-entries.count() // ENTRIES))
    spark = entries.sparkSession
    part = F.pmod(F.xxhash64("material_id"), F.lit(parts)).cast("int").alias("part")
    body = F.map_from_entries(F.sort_array(F.collect_list(F.struct("material_id", F.col("entry").alias("e")))))
    dealt = entries.groupBy(part).agg(F.count("*").alias("n_entries"), body.alias(kind.entries))
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind.entry}>"))
    whole = every.join(dealt, "part", "left").crossJoin(F.broadcast(head))  # one row
    top = F.struct(F.lit(VERSION).alias("schemaVersion"), F.lit(generated_at).alias("generatedAt"), F.lit(real).alias("isRealData"), *head.columns, F.coalesce(kind.entries, empty).alias(kind.entries))
    value = F.to_json(top.cast(f"struct<{_struct(kind.schema)}>"))
    return whole.select("part", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), value.alias("value")).select("part", "n_entries", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"), "value")


def _struct(fields: str) -> str:
    """Top-level fields `a int, b map<..>` as those of a struct type."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, kind = fields[start:i].split(None, 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def publish(kind: Kind, entries: DataFrame, head: Callable[[DataFrame], DataFrame], generated_at: str, path: str, parts: int | None = None) -> str:
    """Write entries as a run of documents with the head that `head` makes of them; gives the run's name. The entries
    are made once: they are stored beside the documents as a typed table, from which head and documents are taken."""
    place = f"{path}/{kind.name}_entries/{uuid.uuid4().hex}"
    entries.write.parquet(place)
    stored = entries.sparkSession.read.schema(entries.schema).parquet(place)
    return write_run(kind, documents(kind, stored, head(stored), generated_at, parts), path)


def write_run(kind: Kind, docs: DataFrame, path: str) -> str:
    """Write a run of documents below the folder `path`, one file each, then its manifest; gives the run's name.

    The rows are made once for both: the manifest is taken from the files as they were written.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    place = f"{path}/{kind.name}/run={run}"
    docs.select("part", "value").write.partitionBy("part").text(place)
    manifest = _texts(spark, place).select(F.lit(kind.name).alias("kind"), F.lit(run).alias("run"), "part", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"), F.size(F.from_json("value", kind.schema)[kind.entries]).cast("long").alias("n_entries"), F.from_json("value", kind.schema)["generatedAt"].alias("generated_at"))
    manifest.write.mode("append").json(f"{path}/manifest")
    return run


def _texts(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema("value string, part int").text(place, wholetext=True).withColumn("value", F.rtrim("value", F.lit("\n")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(kind, run, part, sha256, n_entries, generated_at) of all documents of complete runs."""
    return spark.read.schema("kind string, run string, part int, sha256 string, n_entries long, generated_at string").json(f"{path}/manifest")


def read_run(kind: Kind, spark: SparkSession, path: str, run: str) -> DataFrame:
    """The documents of a run as rows of kind.schema. Those that the manifest lacks, or has with another digest,
    and those of another version are an error."""
    place = f"{path}/{kind.name}/run={run}"
    told = manifest(spark, path).where((F.col("kind") == kind.name) & (F.col("run") == run)).select("part", F.col("sha256").alias("told"))
    docs = _texts(spark, place).join(told, "part", "full")
    fits = F.sha2(F.col("value").cast("binary"), 256) == F.col("told")
    whole = F.when(F.coalesce(fits, F.lit(False)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not as the manifest says: part "), "part")))
    return parsed(kind, docs.select(whole.alias("value")))


def parsed(kind: Kind, texts: DataFrame) -> DataFrame:
    """Rows of kind.schema from documents `value`; a text that is no document of VERSION is an error."""
    doc = texts.select(F.from_json("value", kind.schema).alias("d"))
    known = F.coalesce(F.col("d.schemaVersion") == VERSION, F.lit(False))
    return doc.select(F.when(known, F.col("d")).otherwise(F.raise_error(F.lit(f"not a {kind.name} document of version {VERSION}"))).alias("d")).select("d.*")


def entries_of(kind: Kind, docs: DataFrame) -> DataFrame:
    """(material_id, entry) of documents."""
    return docs.select(F.explode(kind.entries).alias("material_id", "entry"))


def observations_of(docs: DataFrame) -> DataFrame:
    """(source, material_id, period, value, unit, ingest_ord) of SOURCE documents: what the other operators read."""
    rows = docs.select("source", F.explode("series").alias("material_id", "e"))
    return rows.select("source", "material_id", F.col("e.sourceUnit").alias("unit"), F.posexplode("e.observations").alias("ingest_ord", "o")).select("source", "material_id", "o.period", "o.value", "unit", "ingest_ord")
