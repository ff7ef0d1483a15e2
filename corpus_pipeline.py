"""Corpus pipeline: quality classifier, exact dedup, near-dedup, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns it was given.  Each is written as Parquet and read
back as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from escrowlens.llm import bpe, exact, minhash, mixing, quality
from escrowlens.llm.common import staged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# The classifier's draw and the hash-threshold mix have no SQL form over whole
# tables; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling selects; the others go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the largest id, stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the smallest id, stays."""
    return minhash.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian 32-bit) of every row."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("source_mix", source_mix), ("tokenise", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
