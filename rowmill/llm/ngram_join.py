"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows, connected_components, join_hot, materialize, one_thread, release, row_keys, without_rows
from rowmill.llm.tokens import Recent

#: Most classes and n-grams of a block, and blocks that a group of at least SPREAD_ROWS classes for each is spread over anyway.
BLOCK_ROWS, BLOCK_GRAMS, SPREAD, SPREAD_ROWS = 2048, 1_000_000, 16, 128


#: How much of its buckets' work a component's may be at most to be verified whole.
WHOLE = 1.0


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows for which, within so many hashes, a pair at the threshold meets with the wanted probability."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = most // rows
        need = next((b for b in range(1, bands + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if need:
            best = (need, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_words = Recent(_word, most=60_000)


def grams(text: str | None, n: int) -> np.ndarray:
    """The distinct n-grams of the text's words, as sorted 64-bit hashes; a text of fewer words is one gram, one without words none.

    Words are what white space separates, in lower case.
    """
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out + h[k : k + len(out)] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


@lru_cache(maxsize=4)
def _affine(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_030_211)
    return rng.integers(0, 1 << 32, (count, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (count, 1), np.uint32)


def band_hashes(gram: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature."""
    a, b = _affine(bands * rows)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    small = (gram >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 512):
        np.minimum(low, (a * small[at : at + 512] + b).min(axis=1), out=low)
    part = low.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
    return out.view(np.int64)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of one block: columns that many rows share by matrix products, rare ones by counting their pairs."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    count = count[shared]
    order = np.argsort(col, kind="stable")
    row, start = row[order], np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((m, m), np.float32)
    dense = np.flatnonzero(count > m // 10) if m > 64 else np.arange(len(count))
    for at in range(0, len(dense), 1024):
        part = dense[at : at + 1024]
        block = np.zeros((m, len(part)), np.float32)
        which = np.concatenate([row[start[c] : start[c + 1]] for c in part])
        block[which, np.repeat(np.arange(len(part)), count[part])] = 1
        out += block @ block.T
    if m > 64:
        flat = out.ravel()
        for k in np.unique(count[count <= m // 10]):
            cols = np.flatnonzero(count == k)
            step = max(1, 1_000_000 // (k * k))
            for at in range(0, len(cols), step):
                members = row[start[cols[at : at + step], None] + np.arange(k)]
                pairs, times = np.unique((members[:, :, None] * m + members[:, None, :]).ravel(), return_counts=True)
                flat[pairs] += times
    return out


def _components(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    root = np.arange(len(linked))
    todo = linked.any(axis=1)
    while todo.any():
        first = int(np.argmax(todo))
        seen = np.zeros(len(linked), bool)
        seen[first] = True
        front = seen
        while front.any():
            front = linked[front].any(axis=0) & ~seen
            seen |= front
        root[seen] = first
        todo &= ~seen
    return root


def _verify(threshold: float):
    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links among one block, or between two: each member's number of linked documents and its first linked relative.

        A group made of one band's bucket counts only links whose two classes share no earlier band, so that a pair that
        meets in many buckets counts once.
        """
        one_thread()
        rows = rows.sort_values("node")
        sets = [np.asarray(g, np.int64) for g in rows["grams"]]
        size = np.array([len(s) for s in sets], np.float32)
        both = _intersections(sets)
        linked = both >= np.float32(threshold) * (size[:, None] + size[None, :] - both) - np.float32(1e-3)
        np.fill_diagonal(linked, False)
        kind, _, one, other = key
        if one != other:
            blk = rows["blk"].to_numpy()
            linked &= blk[:, None] != blk[None, :]
        root = _components(linked)
        ids = rows["node"].to_numpy()
        counted = linked
        for k in range(kind - 1):
            hashes = np.array([bands[k] for bands in rows["bands"]])
            counted = counted & (hashes[:, None] != hashes[None, :])
        links = counted @ rows["copies"].to_numpy(np.float64)
        some = linked.any(axis=1)
        if len(rows) >= 64:
            release()
        return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "first": ids[root][some]})

    return verify


def _classes(docs: DataFrame, id_col: str, text_col: str, key_col: str, n: int, threshold: float, recall: float) -> DataFrame:
    """For each row of a written table: key, doc_id, class_id, n_links, copy_of, n_copies and kept (one row of each class)."""
    bands, rows = banding(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for keys, ids, texts in arrow_rows(batches, "key", "id", "text", most=500):
            sets = [grams(t, n) for t in texts]
            lo = np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            hi = np.array([_mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            band = [band_hashes(s, bands, rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(lo), pa.array(hi), pa.array(band, pa.list_(pa.int64()))], names=["key", "id", "n", "lo", "hi", "bands"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in arrow_rows(batches, "node", "text", most=500):
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([grams(t, n).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["node", "grams"])

    source = docs.select(F.col(key_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(source.mapInArrow(sign, "key long, id long, n long, lo long, hi long, bands array<long>"), "signed")
    total = signed.count()

    # one class for each set of n-grams; its node is the key of its first row: smallest id, null last
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("head")
    classes = signed.where("n > 0").groupBy("lo", "hi").agg(head, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.col("head.key")), "classes")

    member = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = member.groupBy("bucket").agg(F.min("node").alias("first"), F.min("band").alias("band"), F.count("*").alias("m"), F.sum(F.xxhash64("node") % (1 << 40)).alias("mark"))
    buckets = materialize(buckets.where("m > 1"), "buckets")
    every = int(buckets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    edges = join_hot(member.select("node", "bucket"), buckets.select("bucket", "first", "m"), ["bucket"], "m", every, how="inner")
    candidate = materialize(connected_components(edges, "node", "first"), "candidates")

    # a component is verified whole, or by its buckets (each set of members once) where that is less work
    buckets = buckets.join(buckets.groupBy("first", "m", "mark").agg(F.min("band").alias("band")), ["first", "m", "mark", "band"], "left_semi")
    by_bucket = materialize(buckets.join(candidate.withColumnRenamed("node", "first"), "first").select("bucket", "m", "component"), "by_bucket")
    sizes = candidate.groupBy("component").agg(F.count("*").alias("members"))
    plan = sizes.join(by_bucket.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("work")), "component")
    plan = materialize(plan.withColumn("whole", F.col("members") * F.col("members") <= WHOLE * F.col("work")), "plan")
    held = int(plan.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0])
    chosen = join_hot(candidate, plan, ["component"], "members", held, how="inner")
    whole = chosen.where("whole").select("node", F.lit(0).alias("kind"), F.col("component").alias("group"))
    parts = materialize(join_hot(by_bucket, plan.where("not whole").select("component", "members"), ["component"], "members", held, how="inner"), "parts")
    some = chosen.where("not whole").select("node").join(member, "node")
    some = join_hot(some, parts.select("bucket", "m"), ["bucket"], "m", every, how="inner").select("node", (F.col("band") + 1).cast("int").alias("kind"), F.col("bucket").alias("group"))
    groups = materialize(whole.unionByName(some).join(classes.select("node", "n"), "node"), "groups")
    blocks = groups.groupBy("kind", "group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS), F.least(F.ceil(F.count("*") / SPREAD_ROWS), F.lit(SPREAD))).alias("nb"), F.count("*").alias("m"))
    grouped = join_hot(groups, materialize(blocks, "blocks"), ["kind", "group"], "m", groups.count(), how="inner").withColumn("blk", F.pmod(F.xxhash64("node"), "nb"))
    grouped = grouped.join(classes.select("node", "copies", "bands"), "node").withColumn("bands", F.slice("bands", 1, F.greatest(F.col("kind") - 1, F.lit(0))))

    wanted = materialize(groups.select("node").distinct(), "wanted")
    sets = source.select(F.col("key").alias("node"), "text").join(wanted, "node").mapInArrow(full, "node long, grams array<long>")
    sets = materialize(sets, "sets").join(grouped, "node")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    sets = sets.select("node", "copies", "kind", "group", "bands", "blk", "grams", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    verified = materialize(sets.groupBy("kind", "group", "i", "j").applyInPandas(_verify(threshold), "node long, links long, first long"), "verified")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = materialize(connected_components(verified, "node", "first"), "found")
    linked = classes.join(found, "node").select("component", "head")
    heads = materialize(linked.groupBy("component").agg(F.min("head").alias("top"), F.count("*").alias("m")), "heads")
    top = join_hot(found, heads, ["component"], "m", total, how="inner").select("node", "top")
    classes = classes.join(top, "node", "left").join(links, "node", "left")
    classes = materialize(classes.select("lo", "hi", "head", "copies", F.coalesce("top", "head").alias("top"), F.coalesce("links", F.lit(0).cast("long")).alias("links")), "linked")
    joined = join_hot(signed.select("key", "id", "n", "lo", "hi").where("n > 0"), classes, ["lo", "hi"], "copies", total)
    one = F.lit(1).cast("long")
    return joined.select(
        "key", F.col("id").alias("doc_id"), F.col("top.id").alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("head.id").alias("copy_of"), F.col("copies").alias("n_copies"), (F.col("key") == F.col("top.key")).alias("kept")
    ).unionByName(signed.where("n = 0").select("key", F.col("id").alias("doc_id"), F.col("id").alias("class_id"), (one - 1).alias("n_links"), F.col("id").alias("copy_of"), one.alias("n_copies"), F.lit(True).alias("kept")))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, copy_of, n_copies.

    Two rows are linked if the Jaccard similarity of their texts' sets of word n-grams is at least the threshold.
    class_id is the smallest id reached over links, n_links the number of other rows linked, copies
    included; copy_of is the smallest id with the same set of n-grams, n_copies how many rows have that set.

    1. Every text becomes its n-gram set's 128-bit hash and its band hashes, with as many bands and rows as the
       wanted recall at the threshold needs. Rows with one set are one class from here on, so exact copies cost nothing;
       a class is known by the key of one of its rows, and ids play no part before the result.
    2. Band hashes with two classes or more tie each class to the first in its bucket: rows in proportion
       to the memberships, however full a bucket is. Their components hold all candidate pairs.
    3. A component is verified as one group if that is less work than verifying its buckets one by one, as with copies of
       one text; components that only chain are verified by bucket, buckets of the same members once. Classes in groups
       get their full sets, once for each group; a group of more than 128 classes or a million n-grams is split into
       blocks (of 2048 at most), and tasks verify one block or one pair of blocks. All pairs of a group are verified in memory
       by matrix products; only counts and a spanning forest come out, never pairs.
    4. Components of the verified forest are the classes' ids.

    Null, empty and blank texts have no n-grams: no links, each its own class. Texts of fewer than n words are
    one n-gram. Null ids and repeated ids are rows like any other: every row is linked by its own text, and null
    comes after all ids. An empty table gives no rows; other columns are ignored. Work on one group of mutually similar,
    different texts grows with the square of its size, in memory of fixed blocks. Building the result runs the steps.
    """
    keyed, key = row_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "keyed")
    return _classes(keyed, "id", "text", key, n, threshold, recall).drop("key", "kept")


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that with the smallest id, null after all, and of equal ids any one; columns as they are."""
    keyed, key = row_keys(docs, "keyed")
    gone = _classes(keyed, "doc_id", "text", key, 5, 0.8, 0.995).where(~F.col("kept")).select("key")
    return without_rows(keyed, key, gone, "gone")


#: The exact join, for small tables: all links, where banding may miss one in some hundreds at the very threshold.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS k FROM g GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS copy_of, count(*) OVER (PARTITION BY k) AS n_copies FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s a ON x = a.doc_id JOIN s b ON y = b.doc_id WHERE p.n >= 0.8 * (a.n + b.n - p.n) - 1e-9),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.at = e.a)
SELECT d.doc_id, (SELECT min(r.at) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links,
       coalesce(c.copy_of, d.doc_id) AS copy_of, coalesce(c.n_copies, 1) AS n_copies
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""
