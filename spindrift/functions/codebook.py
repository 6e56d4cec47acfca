"""Codebooks: Huffman codes from lengths, and vector lookups."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from spindrift.functions.bits import BitReader, BitWriter, EndOfPacket, ilog

SYNC = 0x564342
#: Values that one book may precompute; larger books make vectors when asked.
PRECOMPUTE = 1 << 20


class Invalid(ValueError):
    """A header or packet that breaks the format."""


def unpack_float(x: int) -> float:
    m = math.ldexp(x & 0x1FFFFF, (x >> 21 & 0x3FF) - 788)
    return float(np.float32(-m if x >> 31 else m))


def lookup1(entries: int, dims: int) -> int:
    if dims == 0:
        return 0
    r = int(entries ** (1 / dims)) + 1
    while r**dims > entries:
        r -= 1
    return r


def codewords(lengths: list[int]) -> list[int | None]:
    """The lowest free codeword of its length for each entry in turn; None where the
    length is 0. Raises Invalid unless the codes fill the tree; a single entry has length 1."""
    used = [n for n in lengths if n]
    if len(used) <= 1:
        if used and used[0] != 1:
            raise Invalid("a single codeword must have one bit")
        return [0 if n else None for n in lengths]
    free, out = {0: 0}, []  # left-aligned start of each free subtree -> its depth
    for n in lengths:
        if not n:
            out.append(None)
            continue
        start = min((s for s, d in free.items() if d <= n), default=None)
        if start is None:
            raise Invalid("more codewords than the tree holds")
        for depth in range(free.pop(start) + 1, n + 1):
            free[start + (1 << 32 - depth)] = depth
        out.append(start >> 32 - n)
    if free:
        raise Invalid("fewer codewords than the tree holds")
    return out


@dataclass(frozen=True)
class Lookup:
    kind: int
    minimum: int
    delta: int
    bits: int
    sequence: bool
    multiplicands: tuple[int, ...]


@dataclass(frozen=True)
class Codebook:
    dims: int
    lengths: tuple[int, ...]
    lookup: Lookup | None = None

    def __post_init__(self):
        if len(self.lengths) >= 1 << 24 or any(not 0 <= n <= 32 for n in self.lengths):
            raise Invalid("codebook too large")
        if self.lookup:
            want = lookup1(len(self.lengths), self.dims) if self.lookup.kind == 1 else len(self.lengths) * self.dims
            if len(self.lookup.multiplicands) != want or not self.dims:
                raise Invalid("wrong number of multiplicands")
        _ = self.codes

    @cached_property
    def codes(self) -> list[int | None]:
        return codewords(list(self.lengths))

    @cached_property
    def _by_bits(self) -> list[tuple[int, dict[int, int]]]:
        tables: dict[int, dict[int, int]] = {}
        for e, (n, c) in enumerate(zip(self.lengths, self.codes, strict=True)):
            if n:
                tables.setdefault(n, {})[int(f"{c:0{n}b}"[::-1], 2)] = e
        return sorted(tables.items())

    def decode(self, r: BitReader) -> int:
        """Next entry. A single-entry book takes one bit of either value; an empty one ends the packet."""
        tables = self._by_bits
        if len(tables) == 1 and len(tables[0][1]) == 1:
            r.skip(1)
            return next(iter(tables[0][1].values()))
        for n, table in tables:
            if (e := table.get(r.peek(n))) is not None:
                r.skip(n)
                return e
        r.ended = True
        raise EndOfPacket

    def encode(self, w: BitWriter, entry: int) -> None:
        w.codeword(self.codes[entry], self.lengths[entry])

    @cached_property
    def _vectors(self) -> np.ndarray | None:
        if len(self.lengths) * self.dims > PRECOMPUTE:
            return None
        return np.array([self._vector(e) for e in range(len(self.lengths))], dtype=np.float32)

    def _vector(self, entry: int) -> list[float]:
        k, out, last = self.lookup, [], np.float32(0)
        low, step = np.float32(unpack_float(k.minimum)), np.float32(unpack_float(k.delta))
        for d in range(self.dims):
            at = entry // len(k.multiplicands) ** d % len(k.multiplicands) if k.kind == 1 else entry * self.dims + d
            v = np.float32(k.multiplicands[at]) * step + low + last
            out.append(v)
            if k.sequence:
                last = v
        return out

    def vector(self, entry: int) -> np.ndarray:
        return np.array(self._vector(entry), np.float32) if self._vectors is None else self._vectors[entry]

    @classmethod
    def read(cls, r: BitReader) -> Codebook:
        if r.read(24) != SYNC:
            raise Invalid("codebook without its sync pattern")
        dims, entries = r.read(16), r.read(24)
        lengths: list[int] = []
        if r.flag():
            n = r.read(5) + 1
            while len(lengths) < entries:
                count = r.read(ilog(entries - len(lengths)))
                if count > entries - len(lengths) or n > 32:
                    raise Invalid("ordered lengths overflow")
                lengths += [n] * count
                n += 1
        else:
            sparse = r.flag()
            if entries * (1 if sparse else 5) > r.remaining():
                raise EndOfPacket
            lengths = [r.read(5) + 1 if not sparse or r.flag() else 0 for _ in range(entries)]
        kind = r.read(4)
        if kind > 2:
            raise Invalid(f"lookup type {kind}")
        lookup = None
        if kind:
            low, step, bits, seq = r.read(32), r.read(32), r.read(4) + 1, r.flag()
            n = lookup1(entries, dims) if kind == 1 else entries * dims
            if n * bits > r.remaining():
                raise EndOfPacket
            lookup = Lookup(kind, low, step, bits, seq, tuple(r.read(bits) for _ in range(n)))
        return cls(dims, tuple(lengths), lookup)

    def write(self, w: BitWriter) -> None:
        w.write(SYNC, 24)
        w.write(self.dims, 16)
        w.write(len(self.lengths), 24)
        ordered = all(self.lengths) and list(self.lengths) == sorted(self.lengths) and bool(self.lengths)
        w.write(ordered, 1)
        if ordered:
            n, done = self.lengths[0], 0
            w.write(n - 1, 5)
            while done < len(self.lengths):
                count = self.lengths.count(n)
                w.write(count, ilog(len(self.lengths) - done))
                done, n = done + count, n + 1
        else:
            sparse = not all(self.lengths)
            w.write(sparse, 1)
            for n in self.lengths:
                if sparse:
                    w.write(n > 0, 1)
                if n:
                    w.write(n - 1, 5)
        k = self.lookup
        w.write(k.kind if k else 0, 4)
        if k:
            w.write(k.minimum, 32)
            w.write(k.delta, 32)
            w.write(k.bits - 1, 4)
            w.write(k.sequence, 1)
            for m in k.multiplicands:
                w.write(m, k.bits)
