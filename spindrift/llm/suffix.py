"""Exact substring deduplication over a sparse suffix array.

Every window of ``length`` bytes picks one anchor, the leftmost of its smallest
``gram``-byte hashes; equal windows pick it at the same place. So only suffixes
that start at anchors need order: about one in 185 bytes. Windows that share an
anchor make a segment. Equal segments collapse in an aggregation. What is left is
split by the bytes after the anchor and, a second time, by those before it: equal
windows agree on half a window on one side at least. Each part is sorted by a
deep-shallow sort (multikey quicksort to a shallow depth, then blind tries), on the
text right of the anchor and, reversed, left of it. Merging the right order's groups
from the longest common prefix down, with neighbours in the left order, finds for
each anchor how far equal windows reach without looking at all pairs. Parts too large
for one task are split further, by whole windows: those need no order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import written

#: Distinct segments of one part that one task sorts; larger parts are split by windows.
GROUP_LIMIT = 4096
_PIECE, _ROWS = 1 << 23, 50_000


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, out = max(n, 1 << 17), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes."""
    up, down = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_table()[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, key): windows that start from first to last have that anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(text) < length:
        return none, none, none, none
    found = []
    for at in range(0, len(text) - length + 1, _PIECE):
        data = np.frombuffer(text, dtype=np.uint8, count=min(_PIECE + length - 1, len(text) - at), offset=at)
        h = gram_hashes(data, gram)
        low = np.uint64((1 << 24) - 1)
        a = (_slide_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        last = np.concatenate((first[1:], [len(a)])) - 1
        found.append((a[first] + at, first + at, last + at, h[a[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _lcp(a: bytes, b: bytes, at: int = 0) -> int:
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    low, high = at, min(at + step, n)
    while high - low > 8:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while low < n and a[low] == b[low]:
        low += 1
    return low


def _blind(strings: list[bytes], group: list[int], out: list[int], lcps: list[int], depth: int) -> None:
    """Orders a group that shares ``depth`` bytes with a trie that keeps only the
    branching bytes; a string goes down blindly, then one comparison places it.
    A node is [depth, {byte or -1 at the end: child}], a leaf is a list of equal strings."""
    root: list = [group[0]]

    def inner(node: list) -> bool:
        return isinstance(node[-1], dict)

    for i in group[1:]:
        s, node = strings[i], root
        while inner(node):
            d = node[0]
            node = node[1].get(s[d] if d < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[0]]
        d = _lcp(s, other, depth)
        if d == len(s) == len(other):
            node.append(i)
            continue
        parent, node = None, root
        while inner(node) and node[0] < d:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        if inner(node) and node[0] == d:
            node[1][s[d] if d < len(s) else -1] = [i]
            continue
        new = [d, {(s[d] if d < len(s) else -1): [i], (other[d] if d < len(other) else -1): node}]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = new
    stack: list = [(root, None)]
    while stack:
        node, d = stack.pop()
        if inner(node):
            for k, (_, child) in enumerate(sorted(node[1].items(), reverse=True)):
                stack.append((child, node[0] if k < len(node[1]) - 1 else d))
        else:
            for k, i in enumerate(node):
                if out and len(out) > len(lcps):
                    lcps.append(d if k == 0 and d is not None else (len(strings[i]) if k else -1))
                out.append(i)


def deep_shallow_sort(strings: list[bytes], shallow: int = 64, step: int = 8) -> tuple[list[int], list[int]]:
    """Order of the strings and the longest common prefix of each with the next."""
    out: list[int] = []
    lcps: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if not group:
            continue
        if len(group) == 1 or depth >= shallow:
            before = len(out)
            if len(group) == 1:
                if out:
                    lcps.append(-1)
                out.append(group[0])
            else:
                _blind(strings, group, out, lcps, depth)
            if before:
                lcps[before - 1] = _lcp(strings[out[before - 1]], strings[out[before]])
            continue
        cut = {i: strings[i][depth : depth + step] for i in group}
        pivot = cut[group[len(group) // 2]]
        less, same, more = [], [], []
        for i in group:
            c = cut[i]
            (same if c == pivot else less if c < pivot else more).append(i)
        stack.append((more, depth))
        if len(pivot) < step:  # the strings end here, and are equal
            stack.append((same, shallow))
        else:
            stack.append((same, depth + step))
        stack.append((less, depth))
    return out, lcps


class _Ranks:
    """Ordered numbers in blocks, so that neither lookup nor insertion moves them all."""

    def __init__(self, first: int, size: int = 512):
        self.blocks, self.tops, self.n, self.size = [[first]], [first], 1, size

    def around(self, v: int) -> list[int]:
        """The largest number below v and the smallest above, where there are such."""
        b = min(bisect_left(self.tops, v), len(self.tops) - 1)
        own = self.blocks[b]
        at, out = bisect_left(own, v), []
        if at:
            out.append(own[at - 1])
        elif b:
            out.append(self.tops[b - 1])
        if at < len(own):
            out.append(own[at])
        return out

    def add(self, v: int) -> None:
        b = min(bisect_left(self.tops, v), len(self.tops) - 1)
        own = self.blocks[b]
        insort(own, v)
        self.n += 1
        if len(own) > self.size:
            self.blocks[b : b + 1] = [own[: len(own) // 2], own[len(own) // 2 :]]
            self.tops[b : b + 1] = [self.blocks[b][-1], own[-1]]
        else:
            self.tops[b] = own[-1]

    def __iter__(self):
        return (v for b in self.blocks for v in b)


def reaches(rights: list[bytes], lefts: list[bytes], length: int) -> tuple[list[int], list[int]]:
    """For strings around one anchor: how far left and right of it windows of
    ``length`` bytes reach that another string has too (0, 0: none)."""
    n = len(rights)
    best_l, best_r = [0] * n, [0] * n

    def meet(i: int, j: int, r: int) -> None:
        x = _lcp(lefts[i], lefts[j])
        if x + r >= length:
            for k in (i, j):
                best_l[k], best_r[k] = max(best_l[k], x), max(best_r[k], r)

    if n == 2:
        meet(0, 1, _lcp(*rights))
        return best_l, best_r
    order, lcps = deep_shallow_sort(rights)
    by_left, _ = deep_shallow_sort(lefts)
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sets = [_Ranks(rank[i]) for i in order]
    for k in sorted(range(n - 1), key=lambda k: -lcps[k]):
        x, y = top(k), top(k + 1)
        if sets[x].n < sets[y].n:
            x, y = y, x
        big, r = sets[x], lcps[k]
        small = list(sets[y])
        for v in small:
            for u in big.around(v):
                meet(by_left[u], by_left[v], r)
        for v in small:
            big.add(v)
        sets[y], up[y] = None, x
    return best_l, best_r


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _find_segments(length: int, gram: int):
    """Rows of distinct segments of each text; what a text itself repeats is merged to
    spans, which have no key."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("u", pa.binary()), ("after", pa.int64()), ("before", pa.int64())])
    half, low = length // 2, 1 << 63

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for did, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                a, lo, hi, key = segments(data, length, gram)
                digest, side = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
                seen: dict[bytes, tuple[int, int]] = {}
                again: list[tuple[int, int]] = []
                for at in range(0, len(a), _ROWS):  # a periodic text has an anchor at every place
                    own = slice(at, at + _ROWS)
                    for p, x, y, k in zip(a[own].tolist(), lo[own].tolist(), (hi[own] + length).tolist(), key[own].tolist(), strict=True):
                        u = digest(data[x:y])
                        if u in seen:
                            again += [seen[u], (x, y)]
                            continue
                        seen[u] = x, y
                        after = side(data[p : p + half]) - low if p + half <= y else None
                        before = side(data[p - half : p]) - low if p - half >= x else None
                        for o, v in zip(out, (did, th, p, x, y - length, k, u, after, before), strict=True):
                            o.append(v)
                    again = [(x, y) for x, y in merged(again)]
                    if len(out[0]) >= _ROWS:
                        yield _rows(schema, *out)
                        out = [[] for _ in schema]
                for x, y in again:
                    for o, v in zip(out, (did, th, None, x, y - length, None, None, None, None), strict=True):
                        o.append(v)
            if out[0]:
                yield _rows(schema, *out)

    return run, "did long, th long, a int, lo int, hi int, key long, u binary, after long, before long"


def _sort_groups(length: int):
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches):
        key, group = None, []

        def flush(out):
            if len(group) > 1:
                ls, rs = reaches([g[5][g[4] :] for g in group], [g[5][: g[4]][::-1] for g in group], length)
                for (did, th, a, c, _, _), x, y in zip(group, ls, rs, strict=True):
                    if y and c == 1:
                        for o, v in zip(out, (did, th, a - x, a + y), strict=True):
                            o.append(v)

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for *k, did, th, a, c, left, ctx in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if k != key:
                    flush(out)
                    key, group = k, []
                group.append((did, th, a, c, left, ctx))
            if out[0]:
                yield _rows(schema, *out)
        out = [[], [], [], []]
        flush(out)
        if out[0]:
            yield _rows(schema, *out)

    return run, "did long, th long, s int, e int"


def _hot(length: int):
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("h", pa.binary())])

    def run(batches):
        for batch in batches:
            for did, th, lo, ctx in zip(*(batch.column(c).to_pylist() for c in ("did", "th", "lo", "ctx")), strict=True):
                n = len(ctx) - length + 1
                yield _rows(schema, [did] * n, [th] * n, range(lo, lo + n), [xxhash.xxh3_128_digest(ctx[i : i + length]) for i in range(n)])

    return run, "did long, th long, s int, h binary"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 32, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(did, th, s, e): byte ranges whose every byte lies in a string of ``length``
    bytes that occurs elsewhere too. Ranges of a document may overlap. th is
    xxhash64 of the text; rows that are alike in id and text count as repeats."""
    src = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    run, ddl = _find_segments(length, gram)
    seg = written(src.where(F.octet_length("text") >= length).mapInArrow(run, ddl), "segments")
    inside = seg.where("u is null").select("did", "th", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    seg = seg.where("u is not null")
    alike = seg.groupBy("key", "u").agg(F.count("*").alias("c"), F.min(F.struct("did", "th", "a", "lo", "hi", "after", "before")).alias("rep"))
    alike = written(alike.select("key", "u", "c", "rep.*"), "alike")
    whole = seg.join(alike.where("c > 1").select("key", "u"), ["key", "u"]).select("did", "th", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    # parts: segments of an anchor that agree on half a window after it, or before it
    part = alike.select("key", F.explode(F.array(*(F.struct(F.lit(c == "after").alias("right"), F.col(c).alias("half")) for c in ("after", "before")))).alias("x")).select("key", "x.*")
    sizes = part.where("half is not null").groupBy("key", "right", "half").agg(F.count("*").alias("m")).where("m > 1")
    open_ = alike
    for c in ("after", "before"):
        own = sizes.where(F.col("right") == (c == "after")).select("key", F.col("half").alias(c), F.col("m").alias(f"m_{c}"))
        open_ = open_.join(own, ["key", c], "left")
    open_ = open_.where("m_after is not null or m_before is not null").drop("u")
    text = src.withColumnsRenamed({"did": "d", "th": "t"})
    ctx = open_.join(text, F.col("did").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    ctx = ctx.withColumn("ctx", F.expr(f"substring(cast(text as binary), lo + 1, hi - lo + {length})")).drop("text", "d", "t")
    # rows alike in id and text meet their representative twice; those have c > 1
    ctx = written(ctx, "contexts")
    run, ddl = _sort_groups(length)
    sides = F.array(*(F.struct(F.lit(c == "after").alias("right"), F.col(c).alias("half"), F.col(f"m_{c}").alias("m")) for c in ("after", "before")))
    parts = ctx.select("key", "did", "th", "a", "c", (F.col("a") - F.col("lo")).alias("left"), "ctx", F.explode(sides).alias("x")).where(F.col("x.m") <= group_limit)
    parts = parts.select("key", "x.right", "x.half", "did", "th", "a", "c", "left", "ctx")
    found = parts.repartition("key", "right", "half").sortWithinPartitions("key", "right", "half").mapInArrow(run, ddl)
    run, ddl = _hot(length)
    windows = ctx.where((F.col("m_after") > group_limit) | (F.col("m_before") > group_limit)).mapInArrow(run, ddl)
    twice = windows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    hot = windows.join(twice, "h").select("did", "th", "s", (F.col("s") + length).alias("e"))
    return inside.unionByName(whole).unionByName(found).unionByName(hot)


def _cut():
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for did, text, spans in zip(*(batch.column(c).to_pylist() for c in ("did", "text", "spans")), strict=True):
                data = (text or "").encode()
                kept, at, n = [], 0, 0
                for x in merged([(s["s"], s["e"]) for s in spans or ()]):
                    kept.append(data[at : x[0]])
                    at, n = x[1], n + 1
                kept = b"".join([*kept, data[at:]])
                for o, v in zip(out, (did, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    o.append(v)
            yield _rows(schema, *out)

    return run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 32, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which also starts
    elsewhere in the table, all judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining
    bytes; cuts may fall within a character). One row per input row. Null or empty
    text gives zeros and the hash of nothing; a null id is kept; rows that are alike
    repeat each other; texts under ``length`` bytes lose nothing; other columns of
    the input are ignored; an empty table gives an empty result.
    """
    found = repeated_spans(docs, id_col, text_col, length, gram, group_limit)
    spans = found.groupBy("did", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"did": "d", "th": "t"})
    src = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    run, ddl = _cut()
    return src.join(spans, F.col("did").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("did", "text", "spans").mapInArrow(run, ddl)
