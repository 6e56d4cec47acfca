"""Headers and audio packets of the codec: parse, write, decode to windowed blocks."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

from spindrift.functions import mdct
from spindrift.functions.bits import BitReader, BitWriter, EndOfPacket, ilog
from spindrift.functions.codebook import Codebook, Invalid

#: Fixed values of the format.
MAGIC, RANGES = b"vorbis", (256, 128, 86, 64)
DB = 1.0649863e-07 ** ((255 - np.arange(256)) / 255)  # the format's table to 1e-5


def _common(packet: bytes, kind: int) -> bytes:
    if packet[:7] != bytes([kind]) + MAGIC:
        raise Invalid(f"not a header of type {kind}")
    return packet[7:]


@dataclass(frozen=True)
class Identification:
    channels: int
    rate: int
    bitrates: tuple[int, int, int]
    blocksizes: tuple[int, int]

    @classmethod
    def read(cls, packet: bytes) -> Identification:
        body = _common(packet, 1)
        if len(body) < 23:
            raise Invalid("identification cut short")
        version, channels, rate, high, mid, low, sizes, framing = struct.unpack_from("<IBIiiiBB", body)
        b0, b1 = sizes & 15, sizes >> 4
        if version or not channels or not rate or not 6 <= b0 <= b1 <= 13 or not framing & 1:
            raise Invalid("identification out of range")
        return cls(channels, rate, (high, mid, low), (1 << b0, 1 << b1))

    def write(self) -> bytes:
        a, b = (n.bit_length() - 1 for n in self.blocksizes)
        return b"\1" + MAGIC + struct.pack("<IBIiiiBB", 0, self.channels, self.rate, *self.bitrates, a | b << 4, 1)


@dataclass(frozen=True)
class Comments:
    vendor: str = ""
    comments: tuple[str, ...] = ()

    @classmethod
    def read(cls, packet: bytes, strict: bool = True) -> Comments:
        """Without strict, a damaged body gives no comments at all."""
        body, at = _common(packet, 3), 0
        try:

            def text() -> str:
                nonlocal at
                (n,) = struct.unpack_from("<I", body, at)
                if at + 4 + n > len(body):
                    raise Invalid("comment cut short")
                at += 4 + n
                return body[at - n : at].decode("utf-8", "replace")

            vendor = text()
            (count,) = struct.unpack_from("<I", body, at)
            at += 4
            if 4 * count > len(body) - at:
                raise Invalid("more comments than bytes")
            out = tuple(text() for _ in range(count))
            if at >= len(body) or not body[at] & 1:
                raise Invalid("comments without framing bit")
            return cls(vendor, out)
        except (Invalid, struct.error) as e:
            if strict:
                raise Invalid(str(e)) from None
            return cls()

    def write(self) -> bytes:
        texts = [t.encode() for t in (self.vendor, *self.comments)]
        packed = [struct.pack("<I", len(t)) + t for t in texts]
        return b"\3" + MAGIC + packed[0] + struct.pack("<I", len(self.comments)) + b"".join(packed[1:]) + b"\1"

    def get(self, name: str) -> list[str]:
        pairs = (c.partition("=") for c in self.comments)
        return [v for k, eq, v in pairs if eq and k.lower() == name.lower()]


@dataclass(frozen=True)
class Floor0:
    order: int
    rate: int
    map_size: int
    amplitude_bits: int
    amplitude_offset: int
    books: tuple[int, ...]

    @classmethod
    def read(cls, r: BitReader, books: list[Codebook]) -> Floor0:
        out = cls(r.read(8), r.read(16), r.read(16), r.read(6), r.read(8), tuple(r.read(8) for _ in range(r.read(4) + 1)))
        if not out.map_size or not out.order or any(b >= len(books) or not books[b].lookup for b in out.books):
            raise Invalid("floor 0 out of range")
        return out

    def write(self, w: BitWriter) -> None:
        for v, n in ((self.order, 8), (self.rate, 16), (self.map_size, 16), (self.amplitude_bits, 6), (self.amplitude_offset, 8), (len(self.books) - 1, 4), *((b, 8) for b in self.books)):
            w.write(v, n)

    def decode(self, r: BitReader, books: list[Codebook]) -> tuple[int, np.ndarray] | None:
        amplitude = r.read(self.amplitude_bits)
        if not amplitude:
            return None
        which = r.read(ilog(len(self.books)))
        if which >= len(self.books):
            raise Invalid("floor 0 book out of range")
        book, found, last = books[self.books[which]], [], 0.0
        while len(found) < self.order:
            found += (book.vector(book.decode(r)).astype(float) + last).tolist()
            last = found[-1]
        return amplitude, np.array(found[: self.order])

    def map(self, n: int) -> np.ndarray:
        def z(x):
            return 13.1 * np.arctan(0.00074 * x) + 2.24 * np.arctan(1.85e-8 * x * x) + 1e-4 * x

        return np.minimum(self.map_size - 1, np.floor(z(self.rate * np.arange(n) / (2.0 * n)) * (self.map_size / z(0.5 * self.rate)))).astype(int)

    def curve(self, frame: tuple[int, np.ndarray], n: int) -> np.ndarray:
        amplitude, c = frame
        points, back = np.unique(self.map(n), return_inverse=True)
        cw = np.cos(np.pi * points / self.map_size)
        t = 4.0 * (np.cos(c)[:, None] - cw) ** 2
        if self.order % 2:
            p, q = (1 - cw * cw) * t[1::2].prod(axis=0), 0.25 * t[0::2].prod(axis=0)
        else:
            p, q = (1 - cw) / 2 * t[1::2].prod(axis=0), (1 + cw) / 2 * t[0::2].prod(axis=0)
        with np.errstate(all="ignore"):
            top = (1 << self.amplitude_bits) - 1
            v = np.exp(0.11512925 * (amplitude * self.amplitude_offset / (top * np.sqrt(p + q)) - self.amplitude_offset)).astype(np.float32)
        return np.where(np.isfinite(v), v, 0)[back]


@dataclass(frozen=True)
class FloorClass:
    dims: int
    bits: int
    master: int
    books: tuple[int, ...]  # -1: none


@dataclass(frozen=True)
class Floor1:
    partitions: tuple[int, ...]
    classes: tuple[FloorClass, ...]
    multiplier: int
    range_bits: int
    xs: tuple[int, ...]

    @classmethod
    def read(cls, r: BitReader, books: list[Codebook]) -> Floor1:
        parts = tuple(r.read(4) for _ in range(r.read(5)))
        classes = []
        for _ in range(max(parts, default=-1) + 1):
            dims, bits = r.read(3) + 1, r.read(2)
            master = r.read(8) if bits else 0
            classes.append(FloorClass(dims, bits, master, tuple(r.read(8) - 1 for _ in range(1 << bits))))
        multiplier, bits = r.read(2) + 1, r.read(4)
        xs = (0, 1 << bits, *(r.read(bits) for p in parts for _ in range(classes[p].dims)))
        used = [b for c in classes for b in (*c.books, c.master if c.bits else -1)]
        if len(xs) > 65 or len(set(xs)) < len(xs) or any(b >= len(books) for b in used):
            raise Invalid("floor 1 out of range")
        return cls(parts, tuple(classes), multiplier, bits, xs)

    def write(self, w: BitWriter) -> None:
        w.write(len(self.partitions), 5)
        for p in self.partitions:
            w.write(p, 4)
        for c in self.classes:
            w.write(c.dims - 1, 3)
            w.write(c.bits, 2)
            if c.bits:
                w.write(c.master, 8)
            for b in c.books:
                w.write(b + 1, 8)
        w.write(self.multiplier - 1, 2)
        w.write(self.range_bits, 4)
        for x in self.xs[2:]:
            w.write(x, self.range_bits)

    @property
    def span(self) -> int:
        return RANGES[self.multiplier - 1]

    @cached_property
    def neighbors(self) -> list[tuple[int, int]]:
        """Of each post from the third, the nearest earlier ones below and above."""
        out = []
        for i in range(2, len(self.xs)):
            x, before = self.xs[i], range(i)
            out.append((max((j for j in before if self.xs[j] < x), key=lambda j: self.xs[j]), min((j for j in before if self.xs[j] > x), key=lambda j: self.xs[j])))
        return out

    def predict(self, ys: list[int], i: int) -> int:
        lo, hi = self.neighbors[i - 2]
        dy, dx = ys[hi] - ys[lo], self.xs[hi] - self.xs[lo]
        off = abs(dy) * (self.xs[i] - self.xs[lo]) // dx
        return ys[lo] - off if dy < 0 else ys[lo] + off

    def predicted(self, ys: np.ndarray, i: int) -> np.ndarray:
        """predict() of each row of values."""
        lo, hi = self.neighbors[i - 2]
        dy = ys[:, hi] - ys[:, lo]
        return ys[:, lo] + np.sign(dy) * (np.abs(dy) * (self.xs[i] - self.xs[lo]) // (self.xs[hi] - self.xs[lo]))

    def folded(self, targets: np.ndarray) -> np.ndarray:
        """fold() of each row of targets."""
        out = targets.copy()
        for i in range(2, targets.shape[1]):
            p, t = self.predicted(targets, i), targets[:, i]
            high, d = self.span - p, t - p
            v = np.where(d > 0, 2 * d, -2 * d - 1)
            far = np.where(high > p, d + p, high - 1 - d)
            out[:, i] = np.where(d == 0, 0, np.where(v < 2 * np.minimum(high, p), v, far))
        return out

    def unfolded(self, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """unfold() of each row of values."""
        out, used = ys.copy(), ys != 0
        used[:, :2] = True
        for i in range(2, ys.shape[1]):
            p, v = self.predicted(out, i), ys[:, i]
            high, on = self.span - p, v != 0
            for j in self.neighbors[i - 2]:
                used[:, j] |= on
            near = np.where(v % 2 == 1, p - (v + 1) // 2, p + v // 2)
            far = np.where(high > p, v, p - v + high - 1)
            out[:, i] = np.where(on, np.where(v >= 2 * np.minimum(high, p), far, near), p)
        return np.clip(out, 0, self.span - 1), used

    def curves(self, ys: np.ndarray, n: int) -> np.ndarray:
        """curve() of each row of values."""
        final, used = self.unfolded(ys)
        order = np.argsort(self.xs)
        xs, final, used = np.array(self.xs)[order], final[:, order] * self.multiplier, used[:, order]
        place, row = np.arange(len(xs)), np.arange(len(ys))[:, None]
        before = np.maximum.accumulate(np.where(used, place, 0), axis=1)
        after = np.minimum.accumulate(np.where(used, place, len(xs) - 1)[:, ::-1], axis=1)[:, ::-1]
        k = np.arange(min(n, int(xs[-1])))
        span = np.searchsorted(xs, k, side="right") - 1
        lo, hi = before[:, span], after[:, span + 1]
        y0, dy = final[row, lo], final[row, hi] - final[row, lo]
        out = np.empty((len(ys), n), dtype=np.int64)
        out[:, : len(k)] = y0 + np.sign(dy) * (np.abs(dy) * (k - xs[lo]) // (xs[hi] - xs[lo]))
        out[:, len(k) :] = final[:, -1:]
        return DB[np.clip(out, 0, 255)].astype(np.float32)

    def decode(self, r: BitReader, books: list[Codebook]) -> list[int] | None:
        if not r.flag():
            return None
        n = ilog(self.span - 1)
        ys = [r.read(n), r.read(n)]
        for p in self.partitions:
            c = self.classes[p]
            word = books[c.master].decode(r) if c.bits else 0
            for _ in range(c.dims):
                b = c.books[word & (1 << c.bits) - 1]
                word >>= c.bits
                ys.append(books[b].decode(r) if b >= 0 else 0)
        return ys

    def unfold(self, ys: list[int]) -> tuple[list[int], list[bool]]:
        """Final values of the posts, and which of them are corners of the curve."""
        out, used = ys[:2], [True, True] + [False] * (len(ys) - 2)
        for i in range(2, len(ys)):
            p, v = self.predict(out, i), ys[i]
            high, low = self.span - p, p
            if v == 0:
                out.append(p)
                continue
            used[i] = True
            for j in self.neighbors[i - 2]:
                used[j] = True
            if v >= 2 * min(high, low):
                out.append(v if high > low else p - v + high - 1)
            else:
                out.append(p - (v + 1) // 2 if v % 2 else p + v // 2)
        return [max(0, min(self.span - 1, v)) for v in out], used

    def fold(self, targets: list[int]) -> list[int]:
        """Values that unfold to the targets."""
        ys, out = targets[:2], targets[:2]
        for i in range(2, len(targets)):
            p, t = self.predict(ys, i), targets[i]
            high, d = self.span - p, t - p
            v = 2 * d if d > 0 else -2 * d - 1
            out.append(0 if d == 0 else v if v < 2 * min(high, p) else d + p if high > p else high - 1 - d)
            ys.append(t)
        return out

    def curve(self, ys: list[int], n: int) -> np.ndarray:
        final, used = self.unfold(ys)
        corners = sorted((x, y * self.multiplier) for x, y, u in zip(self.xs, final, used, strict=True) if u)
        out = np.empty(n, dtype=np.int64)
        for (x0, y0), (x1, y1) in zip(corners, corners[1:], strict=False):
            if x0 < n:
                k = np.arange(min(x1, n) - x0)
                out[x0 : min(x1, n)] = y0 + np.sign(y1 - y0) * (abs(y1 - y0) * k // (x1 - x0))
        out[min(corners[-1][0], n) :] = corners[-1][1]
        return DB[np.clip(out, 0, 255)].astype(np.float32)


@dataclass(frozen=True)
class Residue:
    kind: int
    begin: int
    end: int
    size: int
    classes: int
    classbook: int
    books: tuple[tuple[int, ...], ...]  # by class, eight passes, -1: none

    @classmethod
    def read(cls, r: BitReader, kind: int, books: list[Codebook]) -> Residue:
        begin, end, size, classes, book = r.read(24), r.read(24), r.read(24) + 1, r.read(6) + 1, r.read(8)
        cascade = []
        for _ in range(classes):
            low = r.read(3)
            cascade.append(low | (r.read(5) << 3 if r.flag() else 0))
        rows = tuple(tuple(r.read(8) if c >> k & 1 else -1 for k in range(8)) for c in cascade)
        out = cls(kind, begin, end, size, classes, book, rows)
        used = [b for row in rows for b in row if b >= 0]
        if begin > end or book >= len(books) or any(b >= len(books) or not books[b].lookup for b in used) or classes ** books[book].dims > len(books[book].lengths):
            raise Invalid("residue out of range")
        if any(size % books[b].dims for b in used):
            raise Invalid("residue partition doesn't hold whole vectors")
        return out

    def write(self, w: BitWriter) -> None:
        for v, n in ((self.begin, 24), (self.end, 24), (self.size - 1, 24), (self.classes - 1, 6), (self.classbook, 8)):
            w.write(v, n)
        for row in self.books:
            c = sum(1 << k for k, b in enumerate(row) if b >= 0)
            w.write(c & 7, 3)
            w.write(c > 7, 1)
            if c > 7:
                w.write(c >> 3, 5)
        for row in self.books:
            for b in row:
                if b >= 0:
                    w.write(b, 8)

    def decode(self, r: BitReader, books: list[Codebook], skip: list[bool], n: int) -> tuple[np.ndarray, bool]:
        """(channels x n, whole?): if the packet ends early, what was decoded so far."""
        ch = len(skip)
        if self.kind == 2:
            if all(skip):
                return np.zeros((ch, n), dtype=np.float32), True
            v, whole = self._decode(r, books, [False], n * ch)
            return v.reshape(n, ch).T.copy(), whole
        return self._decode(r, books, skip, n)

    def _decode(self, r: BitReader, books: list[Codebook], skip: list[bool], n: int) -> tuple[np.ndarray, bool]:
        out = np.zeros((len(skip), n), dtype=np.float32)
        begin = min(self.begin, n)
        parts = (min(self.end, n) - begin) // self.size
        active, book = [j for j, s in enumerate(skip) if not s], books[self.classbook]
        kinds: dict[int, list[int]] = {j: [] for j in active}
        try:
            for k in range(8):
                for first in range(0, parts, book.dims) if book.dims else ():
                    if k == 0:
                        for j in active:
                            word = book.decode(r)
                            kinds[j] += [word // self.classes ** (book.dims - 1 - i) % self.classes for i in range(book.dims)]
                    for p in range(first, min(first + book.dims, parts)):
                        for j in active:
                            b = self.books[kinds[j][p]][k]
                            if b >= 0:
                                self._add(r, books[b], out[j, begin + p * self.size : begin + (p + 1) * self.size])
        except EndOfPacket:
            return out, False
        return out, True

    def _add(self, r: BitReader, book: Codebook, part: np.ndarray) -> None:
        steps = self.size // book.dims
        for i in range(steps):
            at = slice(i, None, steps) if self.kind == 0 else slice(i * book.dims, (i + 1) * book.dims)
            part[at] += book.vector(book.decode(r))


@dataclass(frozen=True)
class Mapping:
    coupling: tuple[tuple[int, int], ...]
    mux: tuple[int, ...]
    floors: tuple[int, ...]
    residues: tuple[int, ...]


@dataclass(frozen=True)
class Setup:
    books: list[Codebook] = field(hash=False)
    floors: list[Floor0 | Floor1] = field(hash=False)
    residues: list[Residue] = field(hash=False)
    mappings: list[Mapping] = field(hash=False)
    modes: list[tuple[bool, int]] = field(hash=False)  # (long block, mapping)

    @classmethod
    def read(cls, packet: bytes, channels: int) -> Setup:
        r = BitReader(_common(packet, 5))
        try:
            books = [Codebook.read(r) for _ in range(r.read(8) + 1)]
            if any(r.read(16) for _ in range(r.read(6) + 1)):
                raise Invalid("time domain transform")
            floors = []
            for _ in range(r.read(6) + 1):
                kind = r.read(16)
                if kind > 1:
                    raise Invalid(f"floor type {kind}")
                floors.append((Floor1 if kind else Floor0).read(r, books))
            residues = []
            for _ in range(r.read(6) + 1):
                kind = r.read(16)
                if kind > 2:
                    raise Invalid(f"residue type {kind}")
                residues.append(Residue.read(r, kind, books))
            mappings = []
            for _ in range(r.read(6) + 1):
                if r.read(16):
                    raise Invalid("mapping type")
                submaps, bits = r.read(4) + 1 if r.flag() else 1, ilog(channels - 1)
                steps = tuple((r.read(bits), r.read(bits)) for _ in range(r.read(8) + 1)) if r.flag() else ()
                if r.read(2) or any(m == a or max(m, a) >= channels for m, a in steps):
                    raise Invalid("mapping out of range")
                mux = tuple(r.read(4) if submaps > 1 else 0 for _ in range(channels))
                subs = [(r.read(8), r.read(8), r.read(8))[1:] for _ in range(submaps)]
                if any(m >= submaps for m in mux) or any(f >= len(floors) or s >= len(residues) for f, s in subs):
                    raise Invalid("mapping out of range")
                mappings.append(Mapping(steps, mux, tuple(f for f, _ in subs), tuple(s for _, s in subs)))
            modes = []
            for _ in range(r.read(6) + 1):
                long_, window, transform, mapping = r.flag(), r.read(16), r.read(16), r.read(8)
                if window or transform or mapping >= len(mappings):
                    raise Invalid("mode out of range")
                modes.append((long_, mapping))
            if not r.flag():
                raise Invalid("setup without framing bit")
        except EndOfPacket:
            raise Invalid("setup cut short") from None
        return cls(books, floors, residues, mappings, modes)

    def write(self, channels: int) -> bytes:
        w = BitWriter()
        w.write(len(self.books) - 1, 8)
        for b in self.books:
            b.write(w)
        w.write(0, 22)
        w.write(len(self.floors) - 1, 6)
        for f in self.floors:
            w.write(isinstance(f, Floor1), 16)
            f.write(w)
        w.write(len(self.residues) - 1, 6)
        for x in self.residues:
            w.write(x.kind, 16)
            x.write(w)
        w.write(len(self.mappings) - 1, 6)
        for m in self.mappings:
            w.write(0, 16)
            w.write(len(m.floors) > 1, 1)
            if len(m.floors) > 1:
                w.write(len(m.floors) - 1, 4)
            w.write(bool(m.coupling), 1)
            if m.coupling:
                w.write(len(m.coupling) - 1, 8)
                for pair in m.coupling:
                    for c in pair:
                        w.write(c, ilog(channels - 1))
            w.write(0, 2)
            if len(m.floors) > 1:
                for x in m.mux:
                    w.write(x, 4)
            for f, s in zip(m.floors, m.residues, strict=True):
                for v in (0, f, s):
                    w.write(v, 8)
        w.write(len(self.modes) - 1, 6)
        for long_, mapping in self.modes:
            for v, n in ((long_, 1), (0, 32), (mapping, 8)):
                w.write(v, n)
        w.write(1, 1)
        return b"\5" + MAGIC + w.bytes()


@lru_cache(maxsize=32)
def headers(identification: bytes, setup: bytes) -> tuple[Identification, Setup]:
    ident = Identification.read(identification)
    return ident, Setup.read(setup, ident.channels)


def _decouple(m: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = np.where((m > 0) == (a > 0), m - a, m + a)
    return np.where(a > 0, m, other), np.where(a > 0, other, m)


def decode_packet(ident: Identification, setup: Setup, packet: bytes) -> np.ndarray | None:
    """Windowed time blocks (channels x block size), ready to overlap; None for a packet
    that isn't decodable audio. It needs nothing from other packets."""
    r, ch = BitReader(packet), ident.channels
    try:
        if r.flag():
            return None
        mode = r.read(ilog(len(setup.modes) - 1))
        if mode >= len(setup.modes):
            return None
        long_, which = setup.modes[mode]
        n = ident.blocksizes[long_]
        before, after = (r.flag(), r.flag()) if long_ else (False, False)
    except EndOfPacket:
        return None
    mapping, half = setup.mappings[which], n // 2
    out = np.zeros((ch, n), dtype=np.float32)
    try:
        floors = [setup.floors[mapping.floors[s]] for s in mapping.mux]
        frames = [f.decode(r, setup.books) for f in floors]
    except EndOfPacket:
        return out
    except Invalid:
        return None
    active = [f is not None for f in frames]
    for m, a in mapping.coupling:
        active[m] = active[a] = active[m] or active[a]
    spectra = np.zeros((ch, half), dtype=np.float32)
    for s, residue in enumerate(mapping.residues):
        own = [c for c in range(ch) if mapping.mux[c] == s]
        spectra[own], whole = setup.residues[residue].decode(r, setup.books, [not active[c] for c in own], half)
        if not whole:
            break
    for m, a in reversed(mapping.coupling):
        spectra[m], spectra[a] = _decouple(spectra[m], spectra[a])
    window = mdct.window(n, *(ident.blocksizes[x] if long_ else n for x in (before, after)))
    for c, (floor, frame) in enumerate(zip(floors, frames, strict=True)):
        if frame is not None and spectra[c].any():
            out[c] = mdct.inverse((spectra[c] * floor.curve(frame, half)).astype(np.float64)[None])[0] * window
    return out
