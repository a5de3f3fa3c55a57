"""Queries over the driver's tables that apply each operator with its production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontaminate, html, language, licenses, neardup, quality, tokens, toxicity, urls
from quillspark.llm.common import read_table


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents of all documents: one row each, repeated rows included. Null and empty texts have no token; an empty table gives no row."""
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens of all documents: one row each, repeated rows included. Null and empty texts have 0 bytes and tokens; an empty table gives no row."""
    docs = read_table(spark, sf_dir, "documents")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.op1_language,
    "op2_licenses": licenses.op2_licenses,
    "op3_neardup": neardup.op3_neardup,
    "op4_urls": urls.op4_urls,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html": html.op7_html,
    "op8_bpe": op8_bpe,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op2_licenses": licenses.oracle(), "op4_urls": urls.oracle()}
