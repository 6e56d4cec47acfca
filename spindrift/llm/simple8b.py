"""Simple-8b blocks of token ids.

A 64-bit word is a selector (upper 4 bits) and 60 bits of 1 to 60 equal fields, the
first id lowest. Ids of 15 bits and more would widen their word's fields; they
leave the escape value there and stand in a list of their own. A block is

    magic "S8B1", ids n, words w, escapes x (uint32 each), w words, x escapes (uint32)

all little-endian; the caller's table holds blocks with their offsets.
"""

from __future__ import annotations

import numpy as np

#: Fields in a word and bits of each, by selector - 2.
FIELDS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // FIELDS
ESCAPE_BITS = 15
ESCAPE = (1 << ESCAPE_BITS) - 1
MAGIC = 0x31423853


def _plan(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and selector of each word: as many ids as fit, from the left."""
    n = len(wide)
    wide = np.concatenate((wide, np.ones(FIELDS[0], dtype=wide.dtype)))  # past the last id, fields stay empty
    take = np.full(n, 60 // ESCAPE_BITS, dtype=np.int32)
    for fields, bits in zip(FIELDS[::-1], BITS[::-1], strict=True):
        if bits < ESCAPE_BITS:
            bad = np.zeros(n + fields + 1, dtype=np.int32)
            np.cumsum(wide[: n + fields] > bits, out=bad[1:])
            fits = bad[fields : n + fields] == bad[:n]
            if not fits.any():
                break  # nor do more fields of fewer bits
            take[fits] = fields
    step, starts, i = take.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, dtype=np.int64)
    return starts, take[starts]


def pack(ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    beyond = ids >= ESCAPE
    small = np.where(beyond, ESCAPE, ids).astype(np.uint64)
    wide = np.maximum(np.frexp(small.astype(np.float32))[1], 1)
    starts, takes = _plan(wide)
    words = np.zeros(len(starts), dtype=np.uint64)
    padded = np.concatenate((small, np.zeros(60, dtype=np.uint64)))
    for s, (fields, bits) in enumerate(zip(FIELDS, BITS, strict=True)):
        at = np.flatnonzero(takes == fields)
        if len(at):
            v = padded[starts[at][:, None] + np.arange(fields)] << (np.arange(fields, dtype=np.uint64) * np.uint64(bits))
            words[at] = np.bitwise_or.reduce(v, axis=1) | np.uint64((s + 2) << 60)
    escaped = ids[beyond]
    head = np.array([MAGIC, len(ids), len(words), len(escaped)], dtype="<u4")
    return head.tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u4").tobytes()


def unpack(block: bytes) -> np.ndarray:
    magic, n, w, x = np.frombuffer(block, "<u4", 4).tolist()
    if magic != MAGIC or len(block) != 16 + 8 * w + 4 * x:
        raise ValueError("not a whole Simple-8b block")
    words = np.frombuffer(block, "<u8", w, 16)
    kind = (words >> np.uint64(60)).astype(np.int64) - 2
    sizes = FIELDS[kind]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint32)
    for s, (fields, bits) in enumerate(zip(FIELDS, BITS, strict=True)):
        at = np.flatnonzero(kind == s)
        if len(at):
            v = words[at][:, None] >> (np.arange(fields, dtype=np.uint64) * np.uint64(bits))
            out[starts[at][:, None] + np.arange(fields)] = (v & np.uint64((1 << bits) - 1)).astype(np.uint32)
    out = out[:n]
    out[out == ESCAPE] = np.frombuffer(block, "<u4", x, 16 + 8 * w)
    return out
