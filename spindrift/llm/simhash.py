"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 32 segments of two bits map to their bit counts, a point of a grid
with sides 0..2. The Manhattan distance of two points is at most the fingerprints'
Hamming distance. Thermometer code (0, 1, 2 as 00, 01, 11) makes that distance a
bit count. With the segments in m blocks, points within distance 2 agree on at least
m - 2 of them, so a range join needs only the grid cells of the choices of m - 2
blocks; pairs are cut by the lower bound, then verified on all bits. m grows with the
logarithm of the number of fingerprints, so that cells keep their size at any scale.

A cell may still be crowded, where many texts are nearly the same. One of more than
``cell_limit`` fingerprints isn't paired: its members are joined through the
fingerprints that differ in one bit or none. Two fingerprints share such a neighbour
exactly if they differ in at most two bits, and a neighbour has at most 65 members,
whatever the cell's size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.llm.common import components, slices, written

SHINGLE, BITS, CELL_LIMIT = 3, 2, 32
_SLICE = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits; bit set if set in over half the shingles' XXH64 (seed 42)."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _SLICE):
        part = ws[at : min(n, at + _SLICE) + shingle - 1]
        if len(ws) < shingle:
            grams = [join(ws)]
        else:
            grams = map(join, zip(*(part[i : len(part) - shingle + 1 + i] for i in range(shingle)), strict=True))
        h = np.fromiter((digest(g, 42) for g in grams), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): signed 64-bit fingerprints of whole texts, and the columns ``carry``."""
    schema = StructType([*StructType().add("doc_id", "long").add("fp", "long").fields, *(docs.schema[c] for c in carry)])

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry).mapInArrow(run, schema)


def _embed(fp: Column) -> Column:
    odd = F.lit(0x5555555555555555)
    any_ = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(odd)
    both = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(odd)
    return any_.bitwiseOR(F.shiftleft(both, 1))


def grid_blocks(n: int, bits: int = BITS) -> int:
    """Blocks in which a random pair of n fingerprints meets in a cell at most one time
    in eight a fingerprint: a segment's bit count holds 1.5 bits of information."""
    return next((m for m in range(bits + 2, 17) if 1.5 * 32 * (m - bits) / m >= math.log2(max(n, 2)) + 3), 16)


def links(fps: DataFrame, bits: int = BITS, cell_limit: int = CELL_LIMIT, m: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all
    pairs within ``bits`` (0, 1 or 2) bits."""
    assert 0 <= bits <= 2
    m = m or grid_blocks(fps.count(), bits)
    points = fps.select("fp", _embed(F.col("fp")).alias("pt"))
    edges = [32 * i // m for i in range(m + 1)]
    masks = [sum(3 << 2 * k for k in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    chosen = list(combinations(range(m), m - bits))
    cells = F.array(*(F.struct(F.lit(n).alias("choice"), F.col("pt").bitwiseAND(signed(sum(masks[i] for i in c))).alias("part")) for n, c in enumerate(chosen)))
    grid = written(points.select("fp", "pt", F.inline(cells)), "grid")
    sizes = grid.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    member = grid.join(sizes, ["choice", "part"])
    few = member.where(F.col("n") <= cell_limit)
    x, y = few.select("choice", "part", F.col("fp").alias("a"), F.col("pt").alias("pa")), few.select("choice", "part", F.col("fp").alias("b"), F.col("pt").alias("pb"))
    pairs = x.join(y, ["choice", "part"]).where("a < b").where(F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= bits)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    # hot cells
    flips = [F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))]
    hot = member.where(F.col("n") > cell_limit).select("fp").distinct()
    if bits == 2:
        near = hot.select(F.col("fp").alias("a"), F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("via"))
        first = near.groupBy("via").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("via", "b")
        star = near.join(first, "via").where("a <> b").select("a", "b")
    else:
        near = hot.select(F.col("fp").alias("a"), F.explode(F.transform(F.array(*(flips[1:] if bits else [])).cast("array<bigint>"), lambda m: F.col("fp").bitwiseXOR(m))).alias("b"))
        star = near.join(hot.select(F.col("fp").alias("b")), "b").select("a", "b")
    return pairs.union(star)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, cell_limit: int = CELL_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups documents whose fingerprints are linked, directly or through others,
    by differing in at most ``bits`` bits.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    group), one row per input row, repeated rows included. Null, empty and blank
    texts have fingerprint zero, which links like any other; texts under ``shingle``
    words are one shingle; a null id is kept and gets its group's smallest id, null
    if there is none. Other columns are ignored; those in ``carry`` are returned as
    well, with group, a fingerprint that no other group has (ids may be shared).
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle, carry), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = links(distinct.select("fp"), bits, cell_limit)
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = rooted.join(least, "root").select("fp", "component_id", "root")
    more = [*carry, F.col("root").alias("group")] if carry else []
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)
