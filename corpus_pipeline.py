"""The corpus pipeline: stages over documents, each written and read again.

Each stage works on all that its predecessor kept, and returns the columns of documents; the last returns the
pieces of packed sequences. A document that a stage drops is dropped by key.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ship, without_keys, written
from quillon.llm.near_duplicates import near_duplicates
from quillon.llm.packing import pack_documents
from quillon.llm.quality_classifier import quality_scores
from quillon.llm.repeats import cut_repeats
from quillon.llm.secret_scan import redact


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_keys(docs, quality_scores(docs, labels).where("predicted = 0").select("doc_id"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least key."""
    ship(spark)
    found = near_duplicates(docs)
    return without_keys(docs, found.where("not kept").select("doc_id"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier are cut out."""
    ship(spark)
    return _recounted(cut_repeats(docs), docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced by the names of their kinds."""
    return _recounted(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: A trained classifier and a tokenizer can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
