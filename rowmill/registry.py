"""The register of queries with their SQL, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmill.sources.ocf import write_ocf
from rowmill.sources.scratch import drop_at_exit, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        ORACLE[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ocf(spark: SparkSession, df: DataFrame, tag: str, **options: object) -> str:
    path = scratch(spark, f"ocf-{tag}")
    write_ocf(df, path, **options)
    drop_at_exit(spark, path)
    return path
