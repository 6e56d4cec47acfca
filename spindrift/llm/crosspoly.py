"""Embedding near-duplicates by cross-polytope hashing.

A hash is the nearest vertex of the cross-polytope after three rounds of random
signs and a fast Hadamard transform: the coordinate of largest size, with its sign.
A bucket key joins ``hashes`` of them; every table adds buckets in which one hash
takes its second-best vertex. A vector's best and second-best vertices are its codes,
which are made once; keys follow from them. All pairs of a bucket are compared exactly,
and each pair counts in the first bucket it shares, so that links can be summed without
being listed. Equal vectors are one point with a count.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import components, written

#: Vectors of a bucket that one task compares with as many others; more are split.
BLOCK = 1024
#: Vectors of a bucket up to which pairs are listed rather than multiplied.
SMALL = 48


def shape(vectors: int, dim: int) -> tuple[int, int]:
    """Hashes a key and tables: keys about as many as vectors, at two hashes least,
    and tables by the hashes alone. At cosine 0.9 and 50,000 vectors, 1 of 4000 simulated
    pairs was missed at 64 dimensions, 5 at 256 and 18 at 768."""
    hashes = max(2, math.ceil(math.log(max(vectors, 2)) / math.log(2 * max(dim, 2)) - 0.75))
    return hashes, 10 * 2 ** (hashes - 2)


@lru_cache(maxsize=4096)
def _signs(seed: int, table: int, hash_: int, d: int) -> np.ndarray:
    return np.random.default_rng([seed, table, hash_, d]).choice((-1.0, 1.0), (3, d))


def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            x = x.reshape(n, -1, 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
            h *= 2
        x = x.reshape(n, d) / math.sqrt(d)
    return x


def codes(x: np.ndarray, hashes: int, tables: int, seed: int = 7) -> np.ndarray:
    """(vectors, tables, 2, hashes): best and second-best vertices."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    rows = np.arange(n)
    out = np.zeros((n, tables, 2, hashes), dtype=np.uint32)
    for t in range(tables):
        for k in range(hashes):
            y = _rotate(wide, _signs(seed, t, k, d))
            size = np.abs(y)
            for which in (0, 1):
                at = size.argmax(axis=1)
                out[:, t, which, k] = 2 * at + (y[rows, at] < 0)
                size[rows, at] = -1
    return out


def code_keys(code: np.ndarray, dim: int) -> np.ndarray:
    """(vectors, tables, 1 + hashes) 64-bit keys of codes; first the plain one of each table."""
    n, tables, _, hashes = code.shape
    wide = code.astype(np.uint64)
    start = np.array([(t + 1) * 0x9E3779B97F4A7C15 + dim & (1 << 64) - 1 for t in range(tables)], dtype=np.uint64)
    out = np.empty((n, tables, 1 + hashes), dtype=np.uint64)
    for probe in range(1 + hashes):
        key = np.broadcast_to(start, (n, tables)).copy()
        for k in range(hashes):
            key = (key ^ wide[:, :, int(probe == k + 1), k]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
        out[:, :, probe] = key
    return out


def bucket_keys(x: np.ndarray, hashes: int, tables: int, seed: int = 7) -> np.ndarray:
    return code_keys(codes(x, hashes, tables, seed), x.shape[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(hashes: int, tables: int, single: bool):
    """(node, c, dim, packed, code): vectors and codes as bytes."""
    kind = np.float32 if single else np.float64

    def run(batches):
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = b.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                code = codes(_unit(x), hashes, tables).astype("<u2" if dim < 1 << 14 else "<u4")
                rows = x.astype(kind)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), pa.array(np.full(len(own), dim, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], names=["node", "c", "dim", "packed", "code"])

    return run, "node long, c long, dim int, packed binary, code binary"


def _arrays(dims: np.ndarray, column: pa.Array, kind: np.dtype) -> np.ndarray:
    """The numbers of a binary column whose rows have the same length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(dims), -1)


def _decoded(dim: int, column: pa.Array, hashes: int, tables: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if dim < 1 << 14 else "<u4").reshape(-1, tables, 2, hashes)


def _keys(hashes: int, tables: int):
    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                keys = code_keys(_decoded(dim, own.column(2), hashes, tables), dim).reshape(own.num_rows, -1)
                names = np.repeat(own.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys.ravel().view(np.int64))], names=["node", "key"])

    return run, "node long, key long"


def near_pairs(x: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group whose cosine is at least ``least``, one of them on the left and
    one on the right (a row may be on both sides); rows of a group stand together. Small
    groups are compared all at once, large ones each by a product of matrices."""
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(group)])))
    whole = np.logical_and.reduceat(left & right, cuts)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 23) // x.shape[1])  # products that are held at once
    for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL) & whole]).tolist():
        first = cuts[(sizes == m) & whole]
        a, b = np.triu_indices(m, 1)
        for at in range(0, len(first), max(1, step // len(a))):
            part = first[at : at + max(1, step // len(a)), None]
            i, j = (part + a).ravel(), (part + b).ravel()
            near = np.einsum("ij,ij->i", x[i], x[j]) >= least
            found.append((i[near], j[near]))
    for start, m in zip(cuts[(sizes > SMALL) | ~whole].tolist(), sizes[(sizes > SMALL) | ~whole].tolist(), strict=True):
        i, j = np.flatnonzero(left[start : start + m]) + start, np.flatnonzero(right[start : start + m]) + start
        near = x[i] @ x[j].T >= least
        if len(i) == m == len(j):
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        found.append((i[a], j[b]))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def first_shared(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first key that rows i and j share: the smallest of their first common table's."""
    none = np.uint64((1 << 64) - 1)
    first = np.full(len(i), none)
    for t in range(keys.shape[1]):
        todo = np.flatnonzero(first == none)
        if not len(todo):
            break
        a, b = keys[i[todo], t], keys[j[todo], t]
        for p in range(keys.shape[2]):
            mine = a[:, p]
            hit = (mine[:, None] == b).any(axis=1)
            first[todo[hit]] = np.minimum(first[todo[hit]], mine[hit])
    return first


def _compare(least: float, hashes: int, tables: int, single: bool):
    kind = np.dtype("<f4" if single else "<f8")

    def settle(dim: int, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Links and smallest linked nodes of whole groups of vectors of one length."""
        key, b1, b2, blk, node, c = (rows.column(k).to_numpy() for k in range(6))
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))))
        x = _unit(_arrays(node, rows.column(7), kind))
        i, j = near_pairs(x, group, blk == b1, blk == b2, least)
        if not len(i):
            return None
        on = np.unique(np.concatenate((i, j)))
        keys = code_keys(_decoded(dim, rows.column(8).take(pa.array(on)), hashes, tables), dim)
        a, b = np.searchsorted(on, i), np.searchsorted(on, j)
        ours = first_shared(keys, a, b) == key[i].view(np.uint64)
        i, j = i[ours], j[ours]
        if not len(i):
            return None
        links = np.bincount(i, c[j], len(node)) + np.bincount(j, c[i], len(node))
        root = node.copy()
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == root).all():
                break
            root = new
        on = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(root[on]), pa.array(links[on].astype(np.int64))], names=["node", "root", "links"])

    def wholes(batches):
        """Rows of whole groups; only the last group of a batch waits for the next."""
        held = None
        for b in batches:
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            marks = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield b.slice(0, cuts[-1])
            held = b.slice(cuts[-1]) if len(cuts) else b
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        for rows in wholes(batches):
            dims = rows.column(6).to_numpy()
            for dim in np.unique(dims).tolist():
                if (out := settle(dim, rows.filter(pa.array(dims == dim)))) is not None:
                    yield out

    return run, "node long, root long, links long"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, block: int = BLOCK, hashes: int | None = None, tables: int | None = None) -> DataFrame:
    """Links vectors whose cosine is at least ``least``.

    Returns vec_id, n_links, component_id, kept; one row per input row. Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing;
    vectors of unlike length don't link. Repeated rows link with each other. A null id
    gets its component's smallest id, and is not kept. Other columns are ignored.
    Buckets of any size are compared whole, in blocks.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("v"))
    finite = F.forall("v", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    good = F.coalesce(finite & F.exists("v", lambda v: v != 0), F.lit(False))
    src = src.withColumn("v", F.when(good, F.transform("v", lambda v: v + F.lit(0.0))))
    points = src.where("v is not null").groupBy("v").agg(F.count("*").alias("c"), F.min("vec_id").alias("rep"))
    points = written(points.select(F.monotonically_increasing_id().alias("node"), "v", "c", "rep"), "points")
    n, dim = points.agg(F.count("*"), F.max(F.size("v"))).first()
    own = shape(n, dim or 2)
    hashes, tables = hashes or own[0], tables or own[1]
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    run, ddl = _coded(hashes, tables, single)
    coded = written(points.select("node", "c", "v").mapInArrow(run, ddl), "coded")
    run, ddl = _keys(hashes, tables)
    members = coded.select("node", "dim", "code").mapInArrow(run, ddl)
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    member = member.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("blk", "o").alias("b1"), F.greatest("blk", "o").alias("b2"), "blk", "node")
    run, ddl = _compare(least, hashes, tables, single)
    rows = met.join(coded, "node").select("key", "b1", "b2", "blk", "node", "c", "dim", "packed", "code")
    found = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(run, ddl)
    found = written(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = points.select("node", "v", "c", "rep").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed.select("v", "root", "rep", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links")), "placed")
    least_id = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = placed.drop("rep").join(least_id, "root").select(F.col("v").alias("pv"), "n_links", "component_id")
    out = src.join(known, F.col("v") == F.col("pv"), "left")
    own_id = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
