"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, *, mod: int, held: int, per_class: dict[int, int], max_chars: int = 32_000_000) -> tuple[list[int], list[str], list[int], float]:
    """Ids, texts and labels of at most so many documents for each value of a 0/1 label, outside the held-out remainder, and the share of label 1 there.

    The ids with the smallest hashes are taken, so the sample is the same however the tables are dealt; a
    document that would take a label's texts beyond max_chars characters is passed over, so the driver gets at
    most twice that. Of rows that repeat an id the longest text counts. Null labels and null ids are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != held)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    label_of = {}
    for y in (0, 1):
        label_of |= {r["doc_id"]: y for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class[y]).collect()}
    if not label_of:
        return [], [], [], share
    rows = docs.where(F.col("doc_id").isin(list(label_of))).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()}
    chosen, left = [], {0: max_chars, 1: max_chars}
    for i, y in label_of.items():
        if i in sizes and sizes[i] <= left[y]:
            left[y] -= sizes[i]
            chosen.append(i)
    got = rows.where(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")).collect() if chosen else []
    got = sorted((r["doc_id"], r["text"]) for r in got)
    return [i for i, _ in got], [t for _, t in got], [label_of[i] for i, _ in got], share
