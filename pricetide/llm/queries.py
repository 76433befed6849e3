"""The dealt operators over the shared tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    ann_search, bpe_chunks, entropy_mix, exact_topk, filter_audit, html_text, language_id, license_scan, minhash_dedup, secret_scan, spelling, token_file, toxicity,
)
from .common import table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(build: Build) -> Build:
    QUERIES[build.__name__] = build
    return build


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_id(spark, sf_dir):
    return language_id.op10_language_id(table(spark, sf_dir, "documents"))


@query
def op1_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op1_minhash_dedup"] = minhash_dedup.SQL


@query
def op8_secret_scan(spark, sf_dir):
    return secret_scan.op8_secret_scan(table(spark, sf_dir, "documents"))


@query
def op6_token_file(spark, sf_dir):
    return token_file.op6_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_bpe_chunks(spark, sf_dir):
    return bpe_chunks.op9_bpe_chunks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_entropy_mix(spark, sf_dir):
    return entropy_mix.op4_entropy_mix(table(spark, sf_dir, "documents"))


@query
def op2_exact_topk(spark, sf_dir):
    return exact_topk.op2_exact_topk(table(spark, sf_dir, "embeddings"))


SQL["op2_exact_topk"] = exact_topk.SQL


@query
def op3_ann_search(spark, sf_dir):
    return ann_search.op3_ann_search(table(spark, sf_dir, "embeddings"))


@query
def op5_html_text(spark, sf_dir):
    return html_text.op5_html_text(table(spark, sf_dir, "pages"))


@query
def op11_spelling_groups(spark, sf_dir):
    return spelling.op11_spelling_groups(table(spark, sf_dir, "documents"))


SQL["op11_spelling_groups"] = spelling.SQL


@query
def op12_license_scan(spark, sf_dir):
    return license_scan.op12_license_scan(table(spark, sf_dir, "documents"))


SQL["op12_license_scan"] = license_scan.SQL


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.op13_filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


SQL["op13_filter_audit"] = filter_audit.SQL
