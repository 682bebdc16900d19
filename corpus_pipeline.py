"""The corpus pipeline: low-quality documents go, exact copies go, one of each group of near copies stays, secrets are masked, and the rest is packed.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents; the last returns the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import exact_dedup, ngram_join, packing, quality, secrets
from rowmill.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocab=public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality_filter", quality_filter), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mask_secrets", mask_secrets), ("pack", pack)]

#: A trained classifier and a packing are no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
