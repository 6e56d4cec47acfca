import numpy as np
import pyarrow as pa
import pytest

from spindrift.functions import audio, batch, encoder, synthetic
from spindrift.sources import ogg


def test_noise_recurrence():
    seed, want = synthetic.LCG_SEED, []
    for _ in range(50):
        seed = (seed * synthetic.LCG_FACTOR + synthetic.LCG_STEP) % 2**64
        want.append(seed)
    assert synthetic.lcg(50).tolist() == want
    x = synthetic.tones(8000, 6, 0.5)
    assert x.shape == (6, 4000) and x.dtype == np.float32 and not x[:, 1601:2000].any() and x[5, :100].any()
    assert synthetic.tones(8000, 1, 0.0).shape == (1, 0)


def test_damage_is_one_of_four_kinds():
    data, seen = bytes(range(256)) * 4, set()
    for i in range(60):
        kind, out = synthetic.damaged(data, 42 + i)
        seen.add(kind)
        n = len(out) - len(data)
        assert {"flip": n == 0, "cut": n < 0, "insert": 0 <= n <= 256, "remove": -256 <= n <= 0}[kind]
        assert synthetic.damaged(data, 42 + i) == (kind, out)
        assert synthetic.damaged(b"", 42 + i)[0] == kind
    assert len(seen) == 4


def blocks(x, config):
    enc = encoder.Encoder(config)
    rows = [(encoder.cut(x, c, encoder.BLOCKSIZES[k]), k, b, a) for c, k, b, a in encoder.plan(x)]
    return enc, rows, enc.blocks(rows)


@pytest.mark.parametrize("channels", [1, 2, 6])
def test_batches_give_what_single_packets_give(channels):
    """Whole, cut and damaged packets, alone and in batches."""
    enc, rows, data = blocks(synthetic.tones(22050, channels, 0.4), encoder.Config(22050, channels, 5))
    assert data == [enc.block(*r) for r in rows]
    heads = enc.headers()
    own = audio.headers(heads[0], heads[2])
    r = np.random.default_rng(channels)
    packets = list(data)
    for _ in range(60):
        p = bytearray(data[r.integers(len(data))])
        if r.random() < 0.5:
            p = p[: r.integers(0, len(p) + 1)]
        elif p:
            p[r.integers(len(p))] ^= 1 << r.integers(8)
        packets.append(bytes(p))
    packets += [b"", b"\1", b"\0"]
    with np.errstate(all="ignore"):
        want, got = [audio.decode_packet(*own, p) for p in packets], batch.decode_packets(heads[0], heads[2], packets)
    for a, b in zip(want, got, strict=True):
        assert (a is None) == (b is None)
        assert a is None or np.array_equal(a, b)


def test_damaged_files_decode_or_fail():
    """Any damage gives an error or finite samples."""
    enc, _, data = blocks(synthetic.tones(8000, 1, 0.3), encoder.Config(8000, 1, 3))
    packets = [(h, 0, k != 1) for k, h in enumerate(enc.headers())] + [(d, 100 * k, False) for k, d in enumerate(data)]
    whole = b"".join(p.to_bytes() for p in ogg.write_pages(packets, 1))
    for i in range(60):
        _, hurt = synthetic.damaged(whole, 7 + i)
        found = [p.data for p in ogg.read_packets(ogg.read_pages(hurt))]
        try:
            with np.errstate(all="ignore"):
                out = batch.decode_packets(found[0], found[2], found[3:]) if len(found) > 3 else []
        except (batch.Invalid, ogg.Damaged):
            continue
        assert all(x is None or np.isfinite(x).all() for x in out)


def test_floors_of_rows_equal_single_ones():
    r = np.random.default_rng(3)
    for half in (128, 1024):
        f = encoder.floor_for(half)
        goal = r.integers(0, f.span, (40, len(f.xs)))
        assert [f.fold(y.tolist()) for y in goal] == f.folded(goal).tolist()
        raw = np.where(r.random(goal.shape) < 0.5, 0, goal)
        assert all(np.array_equal(a, f.curve(y.tolist(), half)) for a, y in zip(f.curves(raw, half), raw, strict=True))


def test_lattices_reach_every_value():
    assert encoder.CLASS_LIMITS == sorted(encoder.CLASS_LIMITS) and encoder.CLASS_LIMITS[-1] >= 2 * encoder.MAX_VALUE
    for dims, top, _ in encoder.LATTICES:
        assert (2 * top + 1) ** dims <= encoder.ENTRIES and encoder.PARTITION % dims == 0


def test_damage_holds_few_texts_at_once(spark, monkeypatch):
    """Large batches are taken in parts: few bytes leave at once, and no batch outlives its end."""
    from spindrift.operators import synthetic as operators

    texts = [bytes([k % 251]) * n for k, n in enumerate([1 << 20] * 20 + [9 << 20] + [0, 5] * 600)]
    taken, df = {}, spark.createDataFrame([(1, b"")], "source long, content binary")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.update(run=run) or self)
    operators.damaged(df)
    monkeypatch.undo()
    left = []

    def batches():
        for at in range(0, len(texts), 700):
            left.append(pa.total_allocated_bytes())
            own = texts[at : at + 700]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(own)), pa.int64()), pa.array(own, pa.binary())], names=["source", "content"])

    got, before = [], pa.total_allocated_bytes()
    for b in taken["run"](batches()):
        assert b.num_rows <= 500 and (b.num_rows == 1 or b.nbytes < 5 << 20)
        got += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        del b
    assert [(k, *synthetic.damaged(d, 0x9E3779B97F4A7C15 ^ k)) for k, d in enumerate(texts)] == got
    assert max(left) - before < 1 << 20
