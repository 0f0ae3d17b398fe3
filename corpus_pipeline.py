"""Corpus pipeline: quality rules, near-dedup, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``.

Defined results: a null text counts as empty and fails the quality rules; of
repeated rows, near-dedup keeps one, and mixing counts each on its own; the
columns of ``documents`` that a table lacks are null, others go; an empty table
passes through every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import byte_bpe, mixing, near_dedup, personal_data, quality_rules
from skein.llm.exprs import keep_columns, text_of
from skein.llm.scratch import Scratch

TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def documents(docs: DataFrame) -> DataFrame:
    return keep_columns(docs, *TYPES).select(*[F.col(c).cast(t).alias(c) for c, t in TYPES.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.apply_rules(documents(docs)).filter("kept").select(*TYPES)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the representative's.

    The representative is a text under an id, so of different texts that share a
    doc_id each is judged by its own class.  Where its row repeats, the one with
    the least (source, lang, n_chars), nulls first, stays.
    """
    docs = documents(docs)
    winners = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    marked = docs.withColumn("_md5", F.md5(text_of("text")))
    left = marked.join(winners, marked["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_md5") == F.col("_t")), "left_semi")
    one = left.groupBy("doc_id", "_md5").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("r"))
    return one.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    clean = personal_data.redact(documents(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, each row by its own number of copies."""
    return mixing.draw(documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes they decode to."""
    return byte_bpe.encode_and_decode(documents(docs))


STAGES = [("quality rules", quality), ("MinHash near-dedup", dedup), ("PII", private), ("mixing sources", mix), ("byte-level BPE", encode)]

#: The near-dedup and mixing stages hash and iterate; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    previous = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
            scratch.drop(previous)
            previous = docs
    return docs
