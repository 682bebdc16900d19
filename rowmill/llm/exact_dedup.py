"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import join_hot, materialize, release, row_keys, without_rows

BLANKS = " \t\n\x0b\x0c\r"
#: A run's columns in the order of the merge: cp is negative, so that the most code points come first; a null id comes last.
RUN = "node int, digest string, check long, size long, cp long, id_null boolean, id long, key long, n long"
#: Rows that a task of a merge is dealt on average at most; with fewer, Spark chooses the number of tasks.
TASK_ROWS = 250_000


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Multiway merge of sorted runs by a heap of their heads: the first row of a text stays, with the sum of the counts.

    Rows are of one text if node, digest, second hash and length agree; rows of one digest that differ in another are of
    different texts and stay apart.
    """
    for _, rows in groupby(heapq.merge(*runs), key=lambda r: r[:4]):
        first = next(rows)
        yield (*first[:-1], first[-1] + sum(r[-1] for r in rows))


def _rows(part: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as tuples in the order of the merge; missing ids are 0 there."""
    for at in range(0, part.num_rows, 4096):
        yield from zip(*(c.fill_null(0).to_pylist() if c.null_count else c.to_pylist() for c in part.slice(at, 4096).columns))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the runs that come one after the other apart, where the order falls, merge them, and give the merged run in batches."""
    runs: list[list[pa.RecordBatch]] = []
    schema, last = None, None
    for batch in batches:
        start, schema = 0, batch.schema
        for k, row in enumerate(_rows(batch)):
            if last is None or row < last:
                if k > start:
                    runs[-1].append(batch.slice(start, k - start))
                runs.append([])
                start = k
            last = row
        if batch.num_rows > start:
            runs[-1].append(batch.slice(start))
    out: list[tuple] = []

    def given() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)]
        columns[6] = [None if none else i for none, i in zip(columns[5], columns[6])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in merged([chain.from_iterable(map(_rows, parts)) for parts in runs]):
        out.append(row)
        if len(out) == 10_000:
            yield given()
            out = []
    if out:
        yield given()
    release()


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, key_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and key (key_col, or a number of the row).

    Every partition sorts its digests into a run with one row for each text. In each round the runs of
    fan_in neighbouring nodes (log2(fan_in) binomial rounds at once) meet on their common parent, dealt by
    digest prefix, and a heap merges them; the row with the most code points, then the smallest id,
    stays at every level, and a second 64-bit hash and the length verify that rows of one digest are of one text. A hot
    digest is one row for each node at most from the first run on, and tasks grow in number with the rows, not in size.

    Null text counts as empty, and all empty texts are equal. A null id comes after all others. Repeated rows
    all count in group_size, and one of them is kept. Other columns of docs are ignored. An empty table gives
    an empty result. Only the number of partitions limits the rounds; texts of any length are hashed whole.
    Building the result runs the rounds.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    leaves = docs.select(F.col(id_col).cast("long").alias("id"), (-F.length(text)).cast("long").alias("cp"), normalised(F.col(text_col)).alias("norm"), F.spark_partition_id().alias("node"), key.alias("key"))
    leaves = leaves.select("node", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("check"), F.length("norm").cast("long").alias("size"), "cp", F.col("id").isNull().alias("id_null"), "id", "key", F.lit(1).cast("long").alias("n"))
    leaves = materialize(leaves, "digests")
    total, top = leaves.agg(F.count("*"), F.max("node")).first()
    runs = leaves.sortWithinPartitions("node", "digest", "check", "size", "cp", "id_null", "id", "key").mapInArrow(_merge, RUN)
    nodes, tasks, usual = (top or 0) + 1, -(-total // TASK_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        runs = runs.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        by = ("node", F.substring("digest", 1, 4))
        runs = runs.repartition(tasks, *by) if tasks > usual else runs.repartition(*by)
        runs = materialize(runs.mapInArrow(_merge, RUN), "runs")
    groups = runs.where("n > 1").select("digest", "check", "size", F.col("id").alias("keep_id"), F.col("key").alias("keep_key"), F.col("n").alias("group_size"))
    out = join_hot(leaves.select("id", "key", "digest", "check", "size"), groups, ["digest", "check", "size"], "group_size", total)
    alone = F.col("keep_key").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("key") == F.col("keep_key"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "key",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept: one row of each text stays, of repeated rows one; columns as they are."""
    keyed, key = row_keys(docs, "keyed")
    return without_rows(keyed, key, exact_duplicates(keyed, key_col=key).where(~F.col("kept")).select("key"), "gone")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS cp FROM documents),
r AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept
      FROM d WINDOW w AS (PARTITION BY t ORDER BY cp DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM r
"""
