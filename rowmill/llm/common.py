"""What the training-data operators share: tables, materialised steps and joins that bear hot keys."""

from __future__ import annotations

import ctypes
import ctypes.util
import glob
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.sources.scratch import drop_at_exit, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a row group of intermediate tables: writers and readers hold one at a time, so it stays small beside an executor's memory.
ROW_GROUP = 16 << 20


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, so that a lost executor costs one stage, not the whole job; the table goes when the application ends."""
    path = scratch(df.sparkSession, tag)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _libc():
    name = ctypes.util.find_library("c")
    library = ctypes.CDLL(name) if name else None
    return library if hasattr(library, "malloc_trim") else None


def release() -> None:
    """Give memory that is free in this process back to the system: a worker lives on after its task, and another stage's may stand beside it."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


@lru_cache(maxsize=1)
def one_thread() -> bool:
    """Let numpy's matrix products run on one thread in this process, as a task has one core; True if its library was found."""
    found = False
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                found = True
    return found


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """docs as a written table with a key for each row, and the key's name. Written, because a row's number does not outlast another evaluation."""
    key = fresh(docs, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), tag), key


def without_rows(docs: DataFrame, key: str, gone: DataFrame, tag: str) -> DataFrame:
    """docs without the rows whose key is in gone (one column), and without the key. Spark broadcasts gone while it is small, and shuffles beyond."""
    gone = materialize(gone.toDF(key), tag)
    return docs.join(gone, key, "left_anti").drop(key)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000, how: str = "left") -> DataFrame:
    """Left or inner join to a right side with one row for each key.

    weight is the right side's column with the number of left rows of a key. Keys with more than
    total / share rows are fewer than share, so that part is broadcast and its left rows stay where they
    are; no key of the shuffled rest has more than that part of the rows. Without such keys it is a plain join.
    The right side is evaluated more than once, so it should be a written table.
    """
    bound = max(total // share, 100)
    if not right.where(F.col(weight) > bound).limit(1).collect():
        return left.join(right, keys, how)
    hot = F.broadcast(right.where(F.col(weight) > bound))
    rest = right.where(F.col(weight) <= bound)
    cold = left.join(F.broadcast(right.where(F.col(weight) > bound).select(*keys)), keys, "left_anti")
    return left.join(hot, keys, "inner").unionByName(cold.join(rest, keys, how))


def arrow_rows(batches: Iterable[pa.RecordBatch], *names: str, most: int = 2000) -> Iterator[list[list]]:
    """Columns as Python lists, in slices of at most so many rows; at the end of a task free memory is given back."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
    release()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of a graph: (node, component), component being the smallest node. Self-loops and nulls are ignored.

    Alternating large-star and small-star rounds until nothing changes; every round is minima by key with map-side
    combining and joins that leave the edges of a hub where they are, and rows never exceed twice the edges.
    Only a count and one flag reach the driver each round.
    """
    star = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    star = materialize(star, "edges")
    while True:
        total = 2 * star.count()
        both = star.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(star.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = materialize(both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("degree")).select("x", F.least("x", "m").alias("m"), "degree"), "low")
        large = materialize(join_hot(both.where("y > x"), low, ["x"], "degree", total, how="inner").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "low")
        if not low.where("degree > 1").limit(1).collect() and not low.select(F.col("m").alias("u")).join(low, "u", "left_semi").limit(1).collect():
            break
        small = join_hot(large, low, ["u"], "degree", total, how="inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
    return large.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(large.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
