"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows, materialize
from rowmill.llm.tokens import byte_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, node int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Every document's ids and the end id, cut only where longer than the capacity; the first piece takes the odd rest.

    nth counts the pieces of one length in one partition (node).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node, seen = byte_tokens(vocab).ids, TaskContext.get().partitionId(), {}
        end = int(end_id).to_bytes(4, "little")
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            out = []
            for doc, text in zip(ids, texts):
                data = encode(text or "") + end
                at, piece, n = 0, 0, len(data) // 4
                while at < n:
                    length = (n - at) % capacity or capacity
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    out.append((doc, piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), node, nth))
                    at, piece = at + length, piece + 1
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

    NAMES = [x.split()[0] for x in PIECES.split(", ")]
    TYPES = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest feasible combination of available lengths, as (length, times); of equal ones, that with the longest pieces.

    Subset sums are the bits of one integer: lengths are added from the shortest on, a length with many copies
    by doubling, and the sums before each length are kept, so that the walk back can take the longest first.
    """
    lengths, sums, before = sorted(counts), 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in lengths:
        before.append(sums)
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            sums |= (sums << (take * length)) & mask
            left, step = left - take, step * 2
    total, out = sums.bit_length() - 1, []
    for length, sums in zip(reversed(lengths), reversed(before)):
        times = min(counts[length], total // length)
        while times and not sums >> (total - times * length) & 1:
            times -= 1
        if times:
            out.append((length, times))
            total -= times * length
    return out


def _fill(counts: dict[int, int], capacity: int, anchored: bool) -> list[tuple[int, list[tuple[int, int]]]]:
    left = {k: n for k, n in counts.items() if n}
    out = []
    while left:
        if anchored:  # the longest piece left, and the fullest combination beside it
            longest = max(left)
            rest = {k: n - (k == longest) for k, n in left.items() if k <= capacity - longest and n > (k == longest)}
            best = dict(fullest(rest, capacity - longest)) if rest else {}
            best[longest] = best.get(longest, 0) + 1
        else:
            best = dict(fullest(left, capacity))
        combination = sorted(best.items(), reverse=True)
        bins = min(left[k] // n for k, n in combination)
        out.append((bins, combination))
        for k, n in combination:
            left[k] -= bins * n
            if not left[k]:
                del left[k]
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for a histogram of lengths: (number of bins alike, combination). Each combination fills bins for as long as its pieces last.

    Every bin is filled around the longest piece left; unless that reaches the least number that the total
    allows, bins are also filled without that rule, and the smaller number stays.
    """
    number = lambda x: sum(bins for bins, _ in x)
    best = _fill(counts, capacity, True)
    if number(best) > -(-sum(k * n for k, n in counts.items()) // capacity):
        best = min(best, _fill(counts, capacity, False), key=number)
    return best


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece a sequence and an offset. pieces: a materialised table with length, node and nth.

    Only the histogram of lengths, which has at most `capacity` rows whatever the input, reaches the driver.
    The bins made from it give each length runs of places; a piece's place is its rank among pieces of its
    length: the pieces of that length in earlier nodes, from a window over one row for each node, and nth.
    """
    by_node = pieces.groupBy("length", "node").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_node.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
    seen, sequence = dict.fromkeys(counts, 0), 0
    for bins, combination in minimum_bin_slack(counts, capacity):
        at = 0
        for length, times in combination:
            runs[length].append((seen[length], sequence, times, at))
            seen[length] += bins * times
            at += length * times
        sequence += bins
    tables = {k: np.array(v, np.int64).T for k, v in runs.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (col[n].to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                mine = length == k
                first, base, times, at = tables[int(k)]
                run = np.searchsorted(first, rank[mine], "right") - 1
                nth = rank[mine] - first[run]
                where[mine] = base[run] + nth // times[run]
                offset[mine] = at[run] + nth % times[run] * k
            yield pa.RecordBatch.from_arrays([*(col[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where), pa.array(offset)], names=[x.split()[0] for x in PLACED.split(", ")])

    earlier = Window.partitionBy("length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    base = by_node.select("length", "node", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "node"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(assign, PLACED)


def pack(docs: DataFrame, *, vocab: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents (doc_id, text) into few sequences of at most `capacity` tokens: one row for each piece.

    Null and empty texts are one end id. Rows that repeat are packed each; a null id stays null. Documents longer
    than the capacity are cut, the first piece being the shorter one. An empty table gives no rows. Other
    columns of docs are ignored. Equal lengths, however many, are one entry of the histogram.
    """
    return place(materialize(token_pieces(docs, vocab, capacity, end_id), "pieces"), capacity)
