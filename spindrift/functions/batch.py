"""Audio packets of one stream's headers, decoded a batch at a time.

Bits and codes are read packet by packet, from a list of the 32 bits at every bit
position, with tables that give the entry and length of a code from its first bits.
What follows, from vectors to time blocks, is done for all packets of a kind at once.
The result is that of audio.decode_packet() for each packet.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from spindrift.functions import mdct
from spindrift.functions.audio import Floor1, Identification, Residue, Setup, _decouple, decode_packet, headers
from spindrift.functions.bits import EndOfPacket, ilog
from spindrift.functions.codebook import Codebook, Invalid  # noqa: F401

#: First bits of a code that a table is indexed by, and packets that are held at once.
FIRST, PACKETS = 10, 64


class _Table:
    """Entry and length by a code's first bits; length 0 for longer codes, found bit by bit."""

    def __init__(self, book: Codebook):
        used = [(e, n, int(f"{c:0{n}b}"[::-1], 2)) for e, (n, c) in enumerate(zip(book.lengths, book.codes, strict=True)) if n]
        if len(used) == 1:  # one bit of either value
            used = [(used[0][0], 1, 0), (used[0][0], 1, 1)]
        bits = min(FIRST, max((n for _, n, _ in used), default=1))
        self.mask, self.dims = (1 << bits) - 1, book.dims
        self.entries, self.lengths = [0] * (1 << bits), [0] * (1 << bits)
        self.long: list[tuple[int, dict[int, int]]] = []
        more: dict[int, dict[int, int]] = {}
        for e, n, c in used:
            if n <= bits:
                for i in range(c, 1 << bits, 1 << n):
                    self.entries[i], self.lengths[i] = e, n
            else:
                more.setdefault(n, {})[c] = e
        self.long = sorted(more.items())

    def find(self, x: int) -> tuple[int, int]:
        """Entry and length of the code that the 32 bits x begin with."""
        i = x & self.mask
        if self.lengths[i]:
            return self.entries[i], self.lengths[i]
        for n, codes in self.long:
            e = codes.get(x & (1 << n) - 1)
            if e is not None:
                return e, n
        raise EndOfPacket


class _Plan:
    """What a setup's packets need, made once."""

    def __init__(self, ident: Identification, setup: Setup):
        self.ident, self.setup = ident, setup
        self.tables = [_Table(b) for b in setup.books]
        self.modes = ilog(len(setup.modes) - 1)
        self.known = all(isinstance(f, Floor1) for f in setup.floors) and all(b.lookup is None or b._vectors is not None for b in setup.books) and all(setup.books[r.classbook].dims for r in setup.residues)
        self.words = [self._words(r) for r in setup.residues] if self.known else []

    def _words(self, r: Residue) -> list[tuple[int, ...]]:
        book = self.setup.books[r.classbook]
        return [tuple(w // r.classes ** (book.dims - 1 - i) % r.classes for i in range(book.dims)) for w in range(len(book.lengths))]

    def floor(self, w: list[int], pos: int, size: int, floor: Floor1) -> tuple[list[int] | None, int]:
        if pos + 1 > size:
            raise EndOfPacket
        if not w[pos] & 1:
            return None, pos + 1
        n, tables = ilog(floor.span - 1), self.tables
        pos += 1
        if pos + 2 * n > size:
            raise EndOfPacket
        ys = [w[pos] & (1 << n) - 1, w[pos + n] & (1 << n) - 1]
        pos += 2 * n
        for p in floor.partitions:
            c, word = floor.classes[p], 0
            if c.bits:
                word, n = tables[c.master].find(w[pos])
                pos += n
                if pos > size:
                    raise EndOfPacket
            for _ in range(c.dims):
                b = c.books[word & (1 << c.bits) - 1]
                word >>= c.bits
                if b < 0:
                    ys.append(0)
                    continue
                y, n = tables[b].find(w[pos])
                pos += n
                if pos > size:
                    raise EndOfPacket
                ys.append(y)
        return ys, pos

    def residue(self, w: list[int], pos: int, size: int, which: int, skip: list[bool], n: int) -> tuple[np.ndarray, int, bool]:
        """(channels x n, next bit, whole?): if the packet ends early, what came before."""
        r, ch = self.setup.residues[which], len(skip)
        if r.kind == 2:
            if all(skip):
                return np.zeros((ch, n), dtype=np.float32), pos, True
            v, pos, whole = self._vectors(w, pos, size, which, [False], n * ch)
            return v.reshape(n, ch).T, pos, whole
        return self._vectors(w, pos, size, which, skip, n)

    def _vectors(self, w: list[int], pos: int, size: int, which: int, skip: list[bool], n: int) -> tuple[np.ndarray, int, bool]:
        r, words = self.setup.residues[which], self.words[which]
        out = np.zeros((len(skip), n), dtype=np.float32)
        begin = min(r.begin, n)
        parts = (min(r.end, n) - begin) // r.size
        active = [j for j, s in enumerate(skip) if not s]
        group, classbook, rows = self.setup.books[r.classbook].dims, self.tables[r.classbook], r.books
        kinds: dict[int, list[int]] = {j: [] for j in active}
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        whole = True
        try:
            for k in range(8):
                if k and not any(row[k] >= 0 for row in rows):
                    continue
                for first in range(0, parts, group):
                    if k == 0:
                        for j in active:
                            e, bits = classbook.find(w[pos])
                            pos += bits
                            if pos > size:
                                raise EndOfPacket
                            kinds[j] += words[e]
                    for p in range(first, min(first + group, parts)):
                        for j in active:
                            b = rows[kinds[j][p]][k]
                            if b < 0:
                                continue
                            table = self.tables[b]
                            entries, lengths, mask = table.entries, table.lengths, table.mask
                            if (k, b) not in found:
                                found[k, b] = [], []
                            places, got = found[k, b]
                            places.append(j * parts + p)
                            for _ in range(r.size // table.dims):
                                x = w[pos]
                                bits = lengths[x & mask]
                                if bits:
                                    e = entries[x & mask]
                                else:
                                    e, bits = table.find(x)
                                pos += bits
                                if pos > size:
                                    raise EndOfPacket
                                got.append(e)
        except EndOfPacket:
            whole = False
        view = out[:, begin : begin + parts * r.size].reshape(len(skip) * parts, r.size) if len(skip) == 1 else np.zeros((len(skip) * parts, r.size), dtype=np.float32)
        for (_, b), (places, got) in found.items():
            dims = self.tables[b].dims
            steps = r.size // dims
            vectors = self.setup.books[b]._vectors[got]
            if len(got) < steps * len(places):  # the packet's end
                vectors = np.concatenate((vectors, np.zeros((steps * len(places) - len(got), dims), dtype=np.float32)))
            vectors = vectors.reshape(len(places), steps, dims)
            view[places] += (vectors.transpose(0, 2, 1) if r.kind == 0 else vectors).reshape(len(places), r.size)
        out[:, begin : begin + parts * r.size] = view.reshape(len(skip), parts * r.size)
        return out, pos, whole

    def read(self, w: list[int], size: int) -> tuple[int, bool, bool, list[list[int] | None], np.ndarray] | None:
        """(mode, long before, long after, floors, spectra) of a packet; None where it
        isn't audio. Without a whole floor, all is silent."""
        setup, ch = self.setup, self.ident.channels
        if size < 1 + self.modes or w[0] & 1:
            return None
        mode, pos = w[1] & (1 << self.modes) - 1, 1 + self.modes
        if mode >= len(setup.modes):
            return None
        long_, which = setup.modes[mode]
        before = after = False
        if long_:
            if pos + 2 > size:
                return None
            before, after, pos = bool(w[pos] & 1), bool(w[pos] & 2), pos + 2
        mapping, half = setup.mappings[which], self.ident.blocksizes[long_] // 2
        frames: list[list[int] | None] = []
        spectra = np.zeros((ch, half), dtype=np.float32)
        try:
            for s in mapping.mux:
                y, pos = self.floor(w, pos, size, setup.floors[mapping.floors[s]])
                frames.append(y)
        except EndOfPacket:
            return mode, before, after, [None] * ch, spectra
        active = [f is not None for f in frames]
        for m, a in mapping.coupling:
            active[m] = active[a] = active[m] or active[a]
        for s, residue in enumerate(mapping.residues):
            own = [c for c in range(ch) if mapping.mux[c] == s]
            spectra[own], pos, whole = self.residue(w, pos, size, residue, [not active[c] for c in own], half)
            if not whole:
                break
        return mode, before, after, frames, spectra

    def blocks(self, read: list[tuple]) -> list[np.ndarray]:
        """Windowed time blocks of packets of one mode."""
        setup, ch = self.setup, self.ident.channels
        long_, which = setup.modes[read[0][0]]
        n, mapping = self.ident.blocksizes[long_], setup.mappings[which]
        x = np.stack([r[4] for r in read])
        for m, a in reversed(mapping.coupling):
            x[:, m], x[:, a] = _decouple(x[:, m], x[:, a])
        out = np.zeros((len(read), ch, n), dtype=np.float32)
        windows = np.stack([mdct.window(n, *(self.ident.blocksizes[y] if long_ else n for y in r[1:3])) for r in read])
        for c in range(ch):
            on = [i for i, r in enumerate(read) if r[3][c] is not None and r[4][c].any() | x[i, c].any()]
            if on:
                curves = setup.floors[mapping.floors[mapping.mux[c]]].curves(np.array([read[i][3][c] for i in on]), n // 2)
                out[on, c] = mdct.inverse((x[on, c] * curves).astype(np.float64)) * windows[on]
        return list(out)


@lru_cache(maxsize=32)
def _plan(identification: bytes, setup: bytes) -> _Plan:
    return _Plan(*headers(identification, setup))


def windows32(packets: list[bytes]) -> list[list[int]]:
    """For each packet the 32 bits at each bit position, zeros past its end."""
    out = []
    for p in packets:
        b = np.frombuffer(p + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
        n = len(p) + 4
        v = b[:n].copy()
        for k in range(1, 5):
            v |= b[k : n + k] << np.uint64(8 * k) if k + n <= len(b) else np.pad(b[k:], (0, k + n - len(b))) << np.uint64(8 * k)
        out.append(((v[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).ravel().tolist())
    return out


def decode_packets(identification: bytes, setup: bytes, packets: list[bytes]) -> list[np.ndarray | None]:
    """audio.decode_packet() of each packet. Raises Invalid for headers that are none."""
    plan = _plan(identification, setup)
    if not plan.known:
        return [decode_packet(plan.ident, plan.setup, p) for p in packets]
    out: list[np.ndarray | None] = [None] * len(packets)
    for first in range(0, len(packets), PACKETS):
        own = packets[first : first + PACKETS]
        kinds: dict[int, list[tuple[int, tuple]]] = {}
        for i, (w, p) in enumerate(zip(windows32(own), own, strict=True), first):
            if (got := plan.read(w, 8 * len(p))) is not None:
                kinds.setdefault(got[0], []).append((i, got))
        for rows in kinds.values():
            for (i, _), block in zip(rows, plan.blocks([r for _, r in rows]), strict=True):
                out[i] = block
    return out
