"""The registered queries of the training-data operators, thin wrappers that derive digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import ann, bpe, exact_dedup, langid, licenses, ngram_join, packing, quality, secrets, toxicity
from rowmill.llm.common import remainder, table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocab=public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def _held_out(mod: int, held: int) -> Column:
    return (remainder(F.col("doc_id"), mod) == held).alias("held_out")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(3, 1), "score", "predicted", "evidence")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, vocab=public_tokenizers.path("byte_bpe_50k.json")))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocab=public_tokenizers.path("word_bpe_49k.json")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(4, 2), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_neighbours": op8_neighbours,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
}

ORACLE: dict[str, str] = {"op2_exact_dedup": exact_dedup.ORACLE, "op3_ngram_join": ngram_join.ORACLE}
