"""Best-fit packing of token pieces with large-item matching.

Only a histogram of piece lengths, at most ``capacity`` numbers, decides: lengths
over a third of the capacity are at most two to a sequence and are paired greedily,
each with the largest that fits beside it; smaller ones, longest first, go where
the least room is left over. The result is a list of runs (length, ranks, sequences,
place); each piece finds its own run by its length and its rank among pieces of that
length, which it gets from its task's counter and the counts of the tasks before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import slices, written
from spindrift.llm.tokenizing import encoder, vocabulary

CAPACITY = 4096


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, pieces a sequence, place)."""
    left = {k: n for k, n in histogram.items() if n > 0}
    assert all(0 < k <= capacity for k in left)
    rank = dict.fromkeys(left, 0)
    runs, made = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> (first sequence, sequences)
    free: list[int] = []

    def open_(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in room:
                room[gap] = []
                insort(free, gap)
            room[gap].append((first, n))

    def put(size: int, n: int, first: int, each: int, at: int) -> None:
        runs.append((size, rank[size], n, first, each, at))
        rank[size] += n
        left[size] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for size in reversed(large):
        while left[size]:
            mate = bisect_left(large, capacity - size + 1) - 1
            while mate >= 0 and left[large[mate]] < 1 + (large[mate] == size):
                mate -= 1
            if mate < 0:
                n = left[size]
                put(size, n, made, 1, 0)
                open_(capacity - size, made, n)
            elif large[mate] == size:
                n = left[size] // 2
                put(size, 2 * n, made, 2, 0)
                open_(capacity - 2 * size, made, n)
            else:
                n, other = min(left[size], left[large[mate]]), large[mate]
                put(size, n, made, 1, 0)
                put(other, n, made, 1, size)
                open_(capacity - size - other, made, n)
            made += n
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(free, size)
            if k < len(free):
                gap = free[k]
                first, bins = room[gap].pop()
                if not room[gap]:
                    del room[gap], free[k]
            else:
                gap, first = capacity, made
                bins = -(-left[size] // (capacity // size))
                made += bins
            each = gap // size
            n = min(left[size], bins * each)
            full, rest = divmod(n, each)
            put(size, n, first, each, capacity - gap)
            open_(gap - each * size, first, full)
            if rest:
                open_(gap - rest * size, first + full, 1)
            open_(gap, first + full + (rest > 0), bins - full - (rest > 0))
    return runs


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary_path: str | None) -> DataFrame:
    """(part, rank, doc_id, piece, start, length, ids_crc32): each document's ids with
    end_id, cut after every ``capacity`` ids; rank counts equal lengths in a task."""
    vocabulary_path = vocabulary(vocabulary_path)
    names = ["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        enc, end = encoder(vocabulary_path), np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for did, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for o, v in zip(out, (part, seen.get(n, 0), did, k, at // 4, n, zlib.crc32(own)), strict=True):
                        o.append(v)
                    seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, vocabulary_path: str | None = None) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` ids.

    Returns, per piece, doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are the end id alone; repeated rows and null ids are packed
    like any other row; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, capacity, end_id, vocabulary_path), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(histogram, capacity), "size long, r0 long, n long, s0 long, each long, at long")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("part", "length", (F.sum("n").over(w) - F.col("n")).alias("before"))
    ranked = cut.join(before.hint("merge"), ["part", "length"]).withColumn("r", F.col("rank") + F.col("before"))
    # runs follow from the histogram alone: their number does not grow with the corpus
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("size")) & (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + F.col("n")))
    k = F.col("r") - F.col("r0")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("s0") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("at") + (k % F.col("each")) * F.col("length")).alias("offset"))
