"""Nested JSON documents, landed files, and links of pages."""

from __future__ import annotations

import _hashlib
import ctypes
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "dataset struct<source:string,latestPeriod:string>, series map<string,struct<displayUnit:string,sourceUnit:string,observations:array<struct<period:string,value:double>>>>"
MIN_BYTES, MAX_BYTES, MAGIC = 50_000, 50 * 1024 * 1024, b"PK"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(source, material_id, period, value, ingest_ord) of a JSON document with a map of series."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    series = docs.select(F.col("dataset.source").alias("source"), F.explode("series").alias("material_id", "s"))
    return series.select("source", "material_id", F.posexplode("s.observations").alias("ingest_ord", "o")).select("source", "material_id", "o.period", "o.value", "ingest_ord")


def document(obs: DataFrame, source: str, parts: int = 1) -> DataFrame:
    """Rows `value`: JSON documents, as read_document() reads them, that together hold all series, dealt over
    `parts` of them by a hash of the id. One document is one row of one task, so give enough parts."""
    each = obs.groupBy("material_id").agg(F.sort_array(F.collect_list(F.struct("period", "value"))).alias("observations"), F.max("period").alias("latest"))
    body = F.map_from_entries(F.sort_array(F.collect_list(F.struct("material_id", F.struct("observations").alias("s")))))
    top = each.agg(F.max("latest").alias("latest"))  # one row
    dealt = each.groupBy(F.pmod(F.xxhash64("material_id"), F.lit(parts)).alias("part")).agg(body.alias("series"))
    whole = dealt.crossJoin(F.broadcast(top))
    return whole.select(F.to_json(F.struct(F.struct(F.lit(source).alias("source"), F.col("latest").alias("latestPeriod")).alias("dataset"), "series")).alias("value"))


def write_document(obs: DataFrame, source: str, path: str, parts: int = 1) -> None:
    document(obs, source, parts).write.mode("overwrite").text(path)


def landed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def admitted(files: DataFrame, least: int = MIN_BYTES, most: int = MAX_BYTES, magic: bytes = MAGIC) -> DataFrame:
    """(path, length, sha256, problem): problem is null for files of an allowed size that start as they should."""
    n = F.col("length")
    problem = F.when(n < least, "too small").when(n > most, "too large").when(F.substring("content", 1, len(magic)) != F.lit(magic), "not the expected format")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), problem.alias("problem"))


#: Files that Spark's text source would unpack, and so are read whole.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd")


def admitted_at(spark: SparkSession, path: str, pattern: str = "*", least: int = MIN_BYTES, most: int = MAX_BYTES, magic: bytes = MAGIC) -> DataFrame:
    """admitted() of the files there. The SHA-256 of those that are too large is worked out here, in parts (`chained`)."""
    files = landed_files(spark, path, pattern)
    large = files.where(F.col("length") > most).select("path", "length").collect()  # a row for each refused file
    done = [(r.path, r.length, x, "too large") for r in large if not r.path.endswith(PACKED) and (x := chained(spark, r.path, r.length))]
    rest = [r.path for r in large if r.path not in {x[0] for x in done}]
    out = admitted(files.where((F.col("length") <= most) | F.col("path").isin(rest)), least, most, magic)
    return out.unionByName(spark.createDataFrame(done, out.schema)) if done else out


def chained(spark: SparkSession, path: str, length: int) -> str | None:
    """The SHA-256 of a file of which each task reads one split: the hash's state, about a hundred bytes, goes from
    the task of one split to that of the next. None if the lines read don't make up the file's length, as where the
    text source skips a byte order mark, or OpenSSL can't be reached."""
    if not hasattr(ctypes.CDLL(_hashlib.__file__), "SHA256_Init"):  # an OpenSSL without it: read whole
        return None
    parts = _updated(spark, path, None).getNumPartitions()
    state = None
    for k in range(parts):
        state = spark.sparkContext.runJob(_updated(spark, path, state), list, [k])[0].state
    if state is None:
        return None
    context, n = _unpacked(bytes(state))
    crypto = ctypes.CDLL(_hashlib.__file__)
    if n == length - 1:
        crypto.SHA256_Update(context, b"\n", ctypes.c_size_t(1))
        n += 1
    digest = ctypes.create_string_buffer(32)
    crypto.SHA256_Final(digest, context)
    return digest.raw.hex() if n == length else None


def _unpacked(state: bytes | None) -> tuple:
    """OpenSSL's SHA256_CTX, and how many bytes it has taken; -1 before the first line."""
    if state is None:
        context = ctypes.create_string_buffer(256)
        ctypes.CDLL(_hashlib.__file__).SHA256_Init(context)
        return context, -1
    return ctypes.create_string_buffer(state[8:], 256), struct.unpack("<q", state[:8])[0]


def _updated(spark: SparkSession, path: str, state: bytes | None):
    """Each split of the file: the state after its lines."""

    def run(batches):
        crypto = ctypes.CDLL(_hashlib.__file__)
        context, n = _unpacked(None if state is None else bytes(state))
        for b in batches:
            if b.num_rows:
                data = (b"\n" if n >= 0 else b"") + b"\n".join(b.column(0).to_pylist())
                crypto.SHA256_Update(context, data, ctypes.c_size_t(len(data)))
                n = max(n, 0) + len(data)
        yield pa.record_batch([pa.array([struct.pack("<q", n) + context.raw], pa.binary())], names=["state"])

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, "state binary").rdd


def secure_host(url: Column) -> Column:
    """The lower-cased host of an https URL; null for any other."""
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lower(F.try_parse_url(url, F.lit("HOST"))))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, and one of the hosts."""
    return F.coalesce(secure_host(url).isin(*hosts), F.lit(False))


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, pos, href, absolute): the links of <a> tags outside comments and scripts, made absolute."""
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), 1)).alias("pos", "href"))
    scheme = F.regexp_extract("_url", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract("_url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1), F.lit("")), F.lit("/")))
    href = F.col("href")
    absolute = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    return rows.select(id_col, "pos", "href", absolute.alias("absolute"))


def discovered(pages: DataFrame, target: str, hosts: list[str] | DataFrame, fallback: str, id_col: str = "page_id") -> DataFrame:
    """(page_id, found): the first allowed link of each page whose last path part is `target`, else the fallback.

    hosts: a short list, or a table with a column `host` of any size.
    """
    base = F.lower(F.regexp_extract("absolute", r"([^/?#]*)(?:[?#].*)?$", 1))
    hits = links(pages, id_col).where(base == target.lower())
    if isinstance(hosts, DataFrame):
        hits = hits.withColumn("host", secure_host(F.col("absolute"))).join(hosts.select("host"), "host", "left_semi")
    else:
        hits = hits.where(allowed_url(F.col("absolute"), hosts))
    first = hits.groupBy(id_col).agg(F.min_by("absolute", "pos").alias("found"))
    return pages.select(id_col).join(first, id_col, "left").select(id_col, F.coalesce("found", F.lit(fallback)).alias("found"))
