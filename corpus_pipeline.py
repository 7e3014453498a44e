"""From documents to training ids: quality, near-duplicates, source mix, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import byte_bpe, mixing, quality, simhash
from rollbook.llm.queries import RANKS, THRESHOLD, digests
from rollbook.llm.shared import settle


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    return docs.where(quality.score(model, F.col("text")) >= THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs, "doc_id", "text", shingle=3, radius=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for."""
    return mixing.apply_mix(docs, "doc_id", "text", "source")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and digests of the ids and of what they decode to."""
    ids = byte_bpe.encode(docs, "text", ["doc_id", "source"], RANKS, public_tokenizers.PATTERN)
    return digests(ids.withColumn("token_ids", F.col("ids")))


STAGES = [
    ("quality", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

# The classifier and the fingerprints' hash are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
