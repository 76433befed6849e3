"""A corpus pipeline: every stage calls one operator of ``pricetide.llm`` on what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import bpe_chunks, entropy_mix, language_id, minhash_dedup, secret_scan
from pricetide.llm.common import prepared, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language as their ``lang``; texts without letters go."""
    prepared(spark)
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepared(spark)
    return minhash_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    prepared(spark)
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix of their sources takes them."""
    prepared(spark)
    return entropy_mix.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix takes, each with its language."""
    return bpe_chunks.op9_bpe_chunks(docs, public_tokenizers.path("word_bpe_49k.json"), ("lang",))


STAGES = [
    ("language_id", language), ("minhash_dedup", near_duplicates), ("secret_scan", secrets), ("entropy_mix", mix), ("bpe_chunks", encode),
]

# Trained models, rounding by hash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
