"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_quotes import quote_threads
from .common import ship
from .embedding_duplicates import linked_vectors
from .near_duplicates import near_duplicates
from .oracles import ORACLES
from .packing import pack_documents
from .piece_codec import encode_documents
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .repeats import without_repeats
from .secret_scan import secret_report
from .toxicity import toxicity_scores

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op2_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads(_table(spark, sf_dir, "conversations"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_quote_threads, op3_piece_codec, op4_quality_rules, op5_embedding_duplicates, op6_toxicity,
    op7_secret_scan, op8_quality_classifier, op9_packing, op10_repeats,
)}
