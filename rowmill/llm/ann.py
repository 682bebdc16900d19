"""Nearest neighbours by inner product: low-dimensional stable projections, a kd-tree, and a chi-square stopping test.

The kd-tree's upper part is fitted on a bounded sample and deals all vectors to cells; each cell has its own lower part.
Queries go to their own cell first, then to the cells that the stopping test cannot rule out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.common import join_hot, materialize, one_thread


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of dimensions, where the distribution is a finite sum."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@lru_cache(maxsize=4)
def projection(width: int, dims: int, seed: int = 20_140_901) -> np.ndarray:
    """Gaussian (2-stable) directions: a projected squared distance is the true one times a chi-square variable."""
    return np.random.default_rng(seed).standard_normal((width + 1, dims))


def kd_leaves(points: np.ndarray, size: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree's leaves: the order of the points, each leaf's start, and the leaves' boxes. Nodes split at the median of their widest side."""
    order, starts = np.arange(len(points)), []
    stack = [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= size:
            starts.append(a)
            continue
        part = points[order[a:b]]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, side], mid)]
        stack += [(a + mid, b), (a, a + mid)]
    starts = np.array(sorted(starts), np.int64)
    ends = [*starts[1:], len(points)]
    low = np.array([points[order[a:b]].min(axis=0) for a, b in zip(starts, ends)])
    high = np.array([points[order[a:b]].max(axis=0) for a, b in zip(starts, ends)])
    return order, starts, low, high


@dataclass
class Cells:
    """The upper kd-tree: inner nodes split at a value of one side, left below; children are nodes or, negative, cells. Boxes are those of the cells' rows."""

    side: np.ndarray
    value: np.ndarray
    child: np.ndarray
    count: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @staticmethod
    def fit(points: np.ndarray, wanted: int) -> Cells:
        """Halves of the sample at the median of the widest side, until there are `wanted` cells or a part has no width."""
        side, value, child, cells = [], [], [], 0

        def grow(part: np.ndarray, leaves: int) -> int:
            nonlocal cells
            spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
            if leaves <= 1 or len(part) < 2 or spread.max() <= 0:
                cells += 1
                return -cells
            s = int(np.argmax(spread))
            v = float(np.median(part[:, s]))
            if not (part[:, s] < v).any():
                v = float(part[part[:, s] > v, s].min())
            node = len(side)
            side.append(s), value.append(v), child.append([0, 0])
            below = part[:, s] < v
            child[node] = [grow(part[below], leaves // 2), grow(part[~below], leaves - leaves // 2)]
            return node

        grow(points, wanted)
        return Cells(np.array(side, np.int64), np.array(value), np.array(child, np.int64).reshape(-1, 2), cells)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point, from 0."""
        at = np.zeros(len(points), np.int64) if len(self.side) else np.full(len(points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = points[inner, self.side[node]] >= self.value[node]
            at[inner] = self.child[node, right.astype(np.int64)]
        return -at - 1

    def distance2(self, point: np.ndarray) -> np.ndarray:
        """Squared distance to each cell's box; empty cells are infinitely far."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(axis=1)


def project(vectors: np.ndarray, norm2: float, dims: int) -> np.ndarray:
    """Projections after one more component that brings all vectors to one length, so that the largest inner product is the least distance."""
    extra = np.sqrt(np.maximum(norm2 - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, extra]) @ projection(vectors.shape[1], dims)


def build(vectors: np.ndarray, ids: list[np.ndarray], norm2: float, dims: int) -> bytes:
    """The lower kd-tree of one part of a cell, with the vectors as they came."""
    points = project(vectors.astype(np.float64), norm2, dims)
    order, starts, low, high = kd_leaves(points)
    return pickle.dumps((vectors[order], points[order], [ids[k] for k in order], starts, low, high, norm2))


def search(index: bytes, queries: np.ndarray, top: int, dims: int, sure: float, bounds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the ids and scores of the best rows found, best first, and how many vectors were verified.

    Projected neighbours come in the order of their projected distance, from the leaves whose boxes are nearest, and each is
    verified with its true inner product. The search stops at the projected distance within which a vector as
    near as the worst one held (or as the query's bound, a score that `top` rows already reach) lies with probability `sure`.
    Rows are verified in runs that double up to 1024, and each run is cut at the distance that the ones before it leave.
    """
    vectors, points, ids, starts, low, high, norm2 = pickle.loads(index)
    wide = vectors.astype(np.float64)
    sizes, first = np.diff(np.append(starts, len(vectors))), np.array([i[0] for i in ids])
    square = (points**2).sum(axis=1)
    gathered = np.empty((1024, wide.shape[1]))
    quantile = chi_square_quantile(sure, dims)
    scales = math.sqrt(norm2) / np.sqrt((queries**2).sum(axis=1))
    spots = np.column_stack([queries * scales[:, None], np.zeros(len(queries))]) @ projection(queries.shape[1], dims)
    for n, (q, spot, scale) in enumerate(zip(queries, spots, scales)):
        if n % 64 == 0:  # the projected distances of so many queries by one matrix product
            block = spots[n : n + 64]
            reach = (-2 * block) @ points.T
            reach += square
            reach += (block**2).sum(axis=1)[:, None]
        box = (np.maximum(np.maximum(low - spot, spot - high), 0) ** 2).sum(axis=1)
        visit = np.argsort(box, kind="stable")
        least = -np.inf if bounds is None else bounds[n]
        radius = np.inf if least == -np.inf else max(0.0, quantile * (2 * norm2 - 2 * scale * least)) + 1e-9 * norm2
        held, score, worst, verified, at, step, chunk = np.empty(0, np.int64), np.empty(0), -np.inf, 0, 0, 4, 64
        waiting, far = np.empty(0, np.int64), np.empty(0)
        while True:
            leaves = visit[at : at + step]
            leaves = leaves[box[leaves] <= radius]
            at, step = at + step, step * 4
            size = sizes[leaves]
            end = size.cumsum()
            rows = np.repeat(starts[leaves] - end + size, size) + np.arange(size.sum())
            waiting, far = np.concatenate([waiting, rows]), np.concatenate([far, reach[n % 64].take(rows)])
            edge = box[visit[at]] if at < len(visit) else np.inf  # nearer ones can only come from leaves seen
            ready = np.flatnonzero(far <= min(edge, radius))
            ready = ready[np.argsort(far[ready])]
            near, ready, k = far[ready], waiting[ready], 0
            while k < len(ready):
                some = ready[k : min(k + chunk, int(near.searchsorted(radius, "right")))]
                if not len(some):
                    break
                k, chunk = k + chunk, min(2 * chunk, len(gathered))  # the radius shrinks most at first
                verified += len(some)
                fresh = wide.take(some, axis=0, out=gathered[: len(some)], mode="clip") @ q
                good = fresh >= worst - 1e-9 * abs(worst) if len(held) >= top else slice(None)
                held, score = np.concatenate([held, some[good]]), np.concatenate([score, fresh[good]])
                if len(held) >= top:
                    worst = np.partition(score, len(score) - top)[len(score) - top]
                    keep = score >= worst - 1e-9 * abs(worst)  # all that tie with the last one
                    held, score = held[keep], score[keep]
                    radius = min(radius, max(0.0, quantile * (2 * norm2 - 2 * scale * worst)) + 1e-9 * norm2)
            if edge > radius or at >= len(visit):
                break
            left = far > edge
            waiting, far = waiting[left], far[left]
        exact = (wide[held] * q).sum(axis=1)
        best = np.lexsort((first[held], -exact))[:top]
        out_ids = np.concatenate([ids[held[k]] for k in best]) if len(best) else np.empty(0, np.int64)
        out_score = np.repeat(exact[best], [len(ids[held[k]]) for k in best])
        best = np.lexsort((out_ids, -out_score))[:top]
        yield out_ids[best], out_score[best], verified


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 16, sure: float = 0.92, shard_rows: int = 16_384, block_rows: int = 1024, fit_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for every row whose id `every` divides.

    Equal vectors are one entry of the index with their k+1 smallest ids (kept by a group limit before the
    shuffle), and equal queries are searched once. A kd-tree over the projections of at most fit_rows vectors (those of the smallest
    hashes) deals every vector to a cell of about shard_rows; a fuller cell is cut into parts. A query goes
    to its own cell, then to the 8 nearest others, then to the rest, each time only to cells whose box lies within the distance at which
    the stopping test would hold with the best rows so far. All rows are in the index, and no vector that can tie is left out
    of a leaf visited. Cells with many queries are copied, one copy for eight blocks of queries.

    Vectors that are null, empty, zero, of a length other than the most frequent one, or hold null or non-finite
    components take no part, nor do null ids. Rows that repeat an id and a vector are one. Ties go to smaller ids.
    With fewer than k candidates all are returned; an empty table gives no rows; other columns are ignored. Scores are in
    double precision on the vectors as they came. Building the result runs the steps.
    """
    kept_type = vectors.schema[vector_col].dataType
    store = np.float32 if isinstance(kept_type, T.ArrayType) and isinstance(kept_type.elementType, T.FloatType) else np.float64
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = v.where("id is not null and x is not null and size(x) > 0").where(~F.exists("x", bad) & F.exists("x", lambda c: c != 0))
    v = v.withColumn("x", F.transform("x", lambda c: c + F.lit(0.0)))  # no negative zeros
    common = v.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return vectors.sparkSession.createDataFrame([], schema)
    v = v.where(F.size("x") == common[0]["width"])

    top = k + 1
    first_ids = v.withColumn("nth", F.dense_rank().over(Window.partitionBy("x").orderBy("id"))).where(F.col("nth") <= top)
    distinct = materialize(first_ids.groupBy("x").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    count, norm2 = distinct.agg(F.count("*"), F.max(square)).first()

    asked = v.where(F.col("id") % every == 0)
    groups = materialize(asked.groupBy("x").agg(F.min("id").alias("q"), F.count("*").alias("m")), "queries")
    total = groups.agg(F.sum("m")).first()[0]
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)

    def spots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"y": list(project(np.stack(rows["x"].to_numpy()), norm2, dims))})

    wanted = math.ceil(count / shard_rows)
    sampled = []
    if wanted > 1:
        chosen = distinct.select(F.xxhash64(F.col("ids")[0]).alias("h"), F.col("ids")[0].alias("id"), "x").orderBy("h", "id").limit(fit_rows).select("x")
        sampled = [r["y"] for r in chosen.mapInPandas(spots, "y array<double>").collect()]
    cells = Cells.fit(np.array(sampled).reshape(-1, dims), min(wanted, max(1, len(sampled) // 8)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(cell=cells.of(project(np.stack(rows["x"].to_numpy()), norm2, dims)).astype(np.int32))

    dealt = materialize(distinct.mapInPandas(deal, "x array<double>, ids array<long>, cell int"), "dealt")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts"))  # a row for each cell, fit_rows / 8 at most
    parts = materialize(parts, "parts")

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["x"].to_numpy())
        data = build(x.astype(store), [np.asarray(i, np.int64) for i in rows["ids"]], norm2, dims)
        y = project(x, norm2, dims)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "part": [rows["part"].iloc[0]], "low": [y.min(axis=0)], "high": [y.max(axis=0)], "data": [data]})

    placed = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), "parts").cast("int"))
    indexed = materialize(placed.groupBy("cell", "part").applyInPandas(index, "cell int, part int, low array<double>, high array<double>, data binary"), "index")
    side = lambda f, c: F.array(*(f(F.col(c)[j]) for j in range(dims)))
    cells.low, cells.high = np.full((cells.count, dims), np.inf), np.full((cells.count, dims), np.inf)
    for r in indexed.groupBy("cell").agg(side(F.min, "low").alias("low"), side(F.max, "high").alias("high")).collect():
        cells.low[r["cell"]], cells.high[r["cell"]] = r["low"], r["high"]
    quantile = chi_square_quantile(sure, dims)

    def route(begin: int, end: int | None):
        """Each query's cells from one rank of distance to another, as far as the stopping test needs them."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                asked, cell = [], []
                for n, (x, bound) in enumerate(zip(rows["x"], rows["bound"])):
                    scale = math.sqrt(norm2) / math.sqrt(float((x * x).sum()))
                    spot = (np.append(x * scale, 0.0) @ projection(len(x), dims))[None]
                    far = cells.distance2(spot[0])
                    own = cells.of(spot)
                    far[own] = np.where(np.isfinite(far[own]), -1.0, np.inf)
                    order = np.argsort(far, kind="stable")[begin:end]
                    limit = quantile * (2 * norm2 - 2 * scale * bound) + 1e-9 * norm2 if bound is not None and bound == bound else np.inf
                    order = order[np.isfinite(far[order]) & (far[order] <= limit)]
                    asked += [n] * len(order)
                    cell.append(order)
                if asked:
                    yield rows.iloc[asked].assign(cell=np.concatenate(cell).astype(np.int32))

        return run

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        bounds = rows["bound"].astype(float).fillna(-np.inf).to_numpy()
        data = pickle.dumps((rows["q"].to_numpy(np.int64), np.stack(rows["x"].to_numpy()), bounds))
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "copy": [rows["copy"].iloc[0]], "asked": [data]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for rows in batches:
            for data, queries in zip(rows["data"], rows["asked"]):
                q, x, bounds = pickle.loads(queries)
                found = list(search(data, x, top, dims, sure, bounds))
                yield pd.DataFrame({"q": np.repeat(q, [len(f[0]) for f in found]), "id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    found, rounds = None, [(0, 1), (1, 9), (9, None)]
    best = groups.select("q", "x", F.lit(None).cast("double").alias("bound"))
    for begin, end in rounds:
        if begin and begin >= cells.count:
            break
        pairs = materialize(best.mapInPandas(route(begin, end), "q long, x array<double>, bound double, cell int"), "pairs")
        load = pairs.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).withColumn("copies", F.ceil(F.col("blocks") / 8).cast("int"))
        load = materialize(load, "load")
        asking = pairs.join(F.broadcast(load), "cell").withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).withColumn("copy", F.col("block") % F.col("copies"))
        asking = asking.groupBy("cell", "block").applyInPandas(block, "cell int, copy int, asked binary")
        copied = indexed.select("cell", "part", "data").join(F.broadcast(load), "cell").withColumn("copy", numbers("copies"))
        hits = copied.join(asking, ["cell", "copy"]).select("data", "asked").mapInPandas(answer, "q long, id long, score double")
        hits = hits if found is None else found.unionByName(hits)
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        found = materialize(hits.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth"), "found")
        bounds = found.groupBy("q").agg(F.when(F.count("*") >= top, F.min("score")).alias("bound"))
        best = groups.select("q", "x").join(bounds, "q", "left")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("nth", F.row_number().over(order)).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("best"))
    best = materialize(groups.join(best, "q").select("x", "m", "best"), "best")

    own = join_hot(asked.distinct(), best, ["x"], "m", total).where("best is not null")
    kept = own.select("id", F.slice(F.filter("best", lambda s: s["id"] != F.col("id")), 1, k).alias("best"))
    out = kept.select(F.col("id").alias("query_id"), F.posexplode("best").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
