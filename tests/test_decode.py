import math
import random

import numpy as np
import pytest

from spindrift.functions import audio
from spindrift.functions.bits import BitReader, BitWriter
from spindrift.functions.codebook import Codebook, Invalid, Lookup
from spindrift.operators.decode import decode
from spindrift.sources import ogg

ONE = 788 << 21 | 1
SIZES = (64, 256)


def setup_for(kind, coupled):
    books = [
        Codebook(1, (7,) * 128),  # floor values
        Codebook(2, (2, 2, 2, 2)),  # two classes, two partitions a word
        Codebook(2, (6,) * 64, Lookup(1, 1 << 31 | 786 << 21 | 16, ONE, 3, False, tuple(range(8)))),  # -4..3
    ]
    floors = [audio.Floor1((0, 0), (audio.FloorClass(2, 0, 0, (0,)),), 2, n.bit_length() - 2, tuple(n // 2 * k // 8 for k in (0, 8, 4, 2, 6, 1))) for n in SIZES]
    residues = [audio.Residue(kind, 0, n // 2 * (2 if kind == 2 else 1), 8, 2, 1, ((-1,) * 8, (2,) + (-1,) * 7)) for n in SIZES]
    maps = [audio.Mapping(((0, 1),) if coupled else (), (0, 0), (k,), (k,)) for k in (0, 1)]
    return audio.Setup(books, floors, residues, maps, [(False, 0), (True, 1)])


def vector(setup, entry):
    return [float(entry % 8 - 4), float(entry // 8 - 4)]


def write_packet(setup, r, long_, before, after, kind):
    """A random packet and what its channels' residues and floors are."""
    w, half = BitWriter(), SIZES[long_] // 2
    w.write(0, 1)
    w.write(long_, 1)
    if long_:
        w.write(before, 1)
        w.write(after, 1)
    floor, ys = setup.floors[long_], []
    for c in range(2):
        on = r.random() < 0.85
        w.write(on, 1)
        if on:
            target = [r.randrange(128) for _ in floor.xs]
            y = floor.fold(target)
            assert floor.unfold(y)[0] == target
            for v in y[:2]:
                w.write(v, 7)
            for v in y[2:]:
                setup.books[0].encode(w, v)
            ys.append(y)
        else:
            ys.append(None)
    used = [y is not None for y in ys]
    if setup.mappings[0].coupling:
        used = [any(used)] * 2
    flat = np.zeros((2, half))
    lanes = [0] if kind == 2 and any(used) else [] if kind == 2 else [c for c in (0, 1) if used[c]]
    n = half * 2 if kind == 2 else half
    data = {c: np.zeros(n) for c in lanes}
    for first in range(0, n // 8, 2):
        words = {}
        for c in lanes:
            words[c] = [r.randrange(2), r.randrange(2)]
            setup.books[1].encode(w, words[c][0] * 2 + words[c][1])
        for p in (first, first + 1):
            for c in lanes:
                if words[c][p - first]:
                    for i in range(4):
                        e = r.randrange(64)
                        setup.books[2].encode(w, e)
                        at = [p * 8 + i, p * 8 + i + 4] if kind == 0 else [p * 8 + 2 * i, p * 8 + 2 * i + 1]
                        data[c][at] += vector(setup, e)
    for c in lanes:
        if kind == 2:
            flat = data[c].reshape(half, 2).T.copy()
        else:
            flat[c] = data[c]
    return w.bytes(), flat, ys


def slow_block(setup, flat, ys, long_, before, after):
    n, half = SIZES[long_], SIZES[long_] // 2
    s = flat.copy()
    if setup.mappings[0].coupling:
        for k in range(half):
            m, a = flat[0][k], flat[1][k]
            s[:, k] = ((m, m - a) if a > 0 else (m + a, m)) if m > 0 else ((m, m + a) if a > 0 else (m - a, m))
    out = np.zeros((2, n))
    size = lambda long_side: SIZES[1] if long_ and long_side else SIZES[0] if long_ else n
    slope = lambda k, m: math.sin(math.pi / 2 * math.sin((k + 0.5) / m * math.pi / 2) ** 2)
    for c in range(2):
        if ys[c] is None:
            continue
        floor = setup.floors[long_]
        final, on = floor.unfold(ys[c])
        pts = sorted((x, 2 * y) for x, y, u in zip(floor.xs, final, on, strict=True) if u)
        curve = []
        for x in range(half):
            (x0, y0), (x1, y1) = [(a, b) for a, b in zip(pts, pts[1:], strict=False) if a[0] <= x < b[0]][0]
            step = abs(y1 - y0) * (x - x0) // (x1 - x0)
            curve.append(audio.DB[y0 + (step if y1 > y0 else -step)])
        x = s[c] * np.array(curve)
        i, k = np.arange(n)[:, None], np.arange(half)[None]
        y = np.cos(2 * np.pi / n * (i + 0.5 + n / 4) * (k + 0.5)) @ x
        a, b = size(before), size(after)
        for j in range(n):
            u, d = j - (n // 4 - a // 4), n * 3 // 4 + b // 4 - 1 - j
            g = (0 if u < 0 else 1 if u >= a // 2 else slope(u, a // 2)) if j < half else (0 if d < 0 else 1 if d >= b // 2 else slope(d, b // 2))
            out[c, j] = y[j] * g
    return out


@pytest.mark.parametrize(("kind", "coupled"), [(0, False), (1, True), (2, True)])
def test_stream_equals_definition(spark, tmp_path, kind, coupled):
    r = random.Random(kind)
    setup, ident = setup_for(kind, coupled), audio.Identification(2, 8000, (0, 0, 0), SIZES)
    sizes = [1, 1, 0, 0, 1, 0, 1, 1]
    packets, want, prev, ends = [], [], None, []
    for i, long_ in enumerate(sizes):
        before, after = (sizes[i - 1] if i else 1), (sizes[i + 1] if i + 1 < len(sizes) else 1)
        data, flat, ys = write_packet(setup, r, long_, before, after, kind)
        block = slow_block(setup, flat, ys, long_, before, after)
        if prev is not None:
            m, n = prev.shape[1], block.shape[1]
            total = m // 4 + n // 4
            o = np.zeros((2, total))
            for k in range(total):
                if m // 2 + k < m:
                    o[:, k] += prev[:, m // 2 + k]
                if 0 <= k + n // 4 - m // 4 < n:
                    o[:, k] += block[:, k + n // 4 - m // 4]
            want.append(o)
        prev = block
        ends.append(sum(x.shape[1] for x in want))
        packets.append(data)
        if i == 3:
            packets.append(b"\1 not audio")
            ends.append(ends[-1])
    pcm, short, early = np.concatenate(want, axis=1), 37, 21
    comments = audio.Comments("v", ("A=b", "a=c", "x"))
    assert audio.Comments.read(comments.write()) == comments and comments.get("a") == ["b", "c"]
    heads = [ident.write(), comments.write(), setup.write(2)]
    assert len(heads[0]) == 30 and audio.Setup.read(heads[2], 2) == setup and audio.Identification.read(heads[0]) == ident
    items = [(heads[0], 0, True), (heads[1], 0, False), (heads[2], 0, True)]
    items += [(d, e - early - (short if i == len(packets) - 1 else 0), i % 3 == 2 and i < len(packets) - 1) for i, (d, e) in enumerate(zip(packets, ends, strict=True))]
    (tmp_path / "a.ogg").write_bytes(b"".join(p.to_bytes() for p in ogg.write_pages(items, 9)))
    found = ogg.packets_of(ogg.ogg_pages(spark, str(tmp_path), "FAILFAST"), strict=True)
    rows = decode(found).orderBy("chan", "position").collect()
    for c in range(2):
        own = [x for x in rows if x.chan == c]
        assert own[0].position == 0 and {x.rate for x in own} == {8000}
        for x, y in zip(own, own[1:], strict=False):
            assert x.position + len(x.samples) == y.position
        got = np.concatenate([x.samples for x in own])
        assert len(got) == pcm.shape[1] - early - short
        assert np.abs(got - pcm[c, early : early + len(got)]).max() < 1e-4


def test_damaged_packets_and_headers_never_crash():
    r = random.Random(8)
    setup, ident = setup_for(2, True), audio.Identification(2, 8000, (0, 0, 0), SIZES)
    good = [write_packet(setup, r, 1, 1, 1, 2)[0] for _ in range(5)]
    for _ in range(150):
        x = bytearray(r.choice(good))
        for _ in range(r.randint(1, 6)):
            x[r.randrange(len(x))] ^= 1 << r.randrange(8)
        out = audio.decode_packet(ident, setup, bytes(x[: r.randint(0, len(x))]))
        assert out is None or np.isfinite(out).all()
    raw = setup.write(2)
    for _ in range(150):
        x = bytearray(raw[: r.randint(1, len(raw))])
        x[r.randrange(len(x))] ^= 1 << r.randrange(8)
        try:
            audio.Setup.read(bytes(x), 2)
        except Invalid:
            pass


def test_floor_0():
    book = Codebook(2, (2, 2, 2, 2), Lookup(2, 0, 785 << 21 | 1, 4, False, (2, 4, 3, 9, 5, 6, 1, 1)))
    f = audio.Floor0(3, 8000, 64, 6, 100, (0,))
    w = BitWriter()
    f.write(w)
    assert audio.Floor0.read(BitReader(w.bytes()), [book]) == f
    w = BitWriter()
    w.write(63, 6)
    w.write(0, 1)  # the only book
    book.encode(w, 0)
    book.encode(w, 2)
    amplitude, c = f.decode(BitReader(w.bytes()), [book])
    assert amplitude == 63 and c.tolist() == [0.25, 0.5, 0.5 + 0.625]
    cw = math.cos(math.pi * f.map(32)[20] / 64)
    p = (1 - cw * cw) * 4 * (math.cos(c[1]) - cw) ** 2
    q = 0.25 * 4 * (math.cos(c[0]) - cw) ** 2 * 4 * (math.cos(c[2]) - cw) ** 2
    assert f.curve((63, c), 32)[20] == pytest.approx(math.exp(0.11512925 * (100 / math.sqrt(p + q) - 100)), rel=1e-5)
    assert f.decode(BitReader(b"\0"), [book]) is None
