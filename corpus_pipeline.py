"""From documents to packed training sequences: drop toxic and near-duplicate documents, cut repeated
passages, mask personal data, pack tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm.common import checkpointed, load
from pricewell.llm.ngram_join import first_of_each
from pricewell.llm.packing import packed
from pricewell.llm.pii import redacted
from pricewell.llm.queries import held_out
from pricewell.llm.suffix_dedup import without_repeats
from pricewell.llm.toxicity import fit, without_toxic


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold of their language."""
    model = fit(docs, load(spark, sf_dir, "labels").where(~held_out()))
    return without_toxic(docs, model)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    return first_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a document with a smaller doc_id has."""
    return _with_length(without_repeats(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return _with_length(redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids as base64 of little-endian 32-bit integers."""
    out = packed(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.base64("ids").alias("ids"))


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("suffix_dedup", suffix_dedup), ("pii", pii), ("packing", packing)]
#: SQL can't express the trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
