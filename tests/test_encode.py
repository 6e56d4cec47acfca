import numpy as np
import pytest

from spindrift.functions import encoder as E
from spindrift.functions.audio import Setup
from spindrift.operators.decode import decode
from spindrift.operators.encode import encode, ogg_files
from spindrift.sources import ogg

RATE = 22050


def tone(channels, n):
    t, r = np.arange(n) / RATE, np.random.default_rng(3)
    x = np.array([sum(np.sin(2 * np.pi * 220 * (1 + c / 4) * h * t) / h for h in range(1, 8)) * 0.18 * (0.5 + 0.5 * abs(np.sin(2 * np.pi * 0.7 * t))) for c in range(channels)])
    x[:, n // 2 : n // 2 + 200] += 0.3 * r.normal(size=(channels, len(t[n // 2 : n // 2 + 200])))
    return (x + 0.002 * r.normal(size=x.shape)).astype(np.float32)


def frame(spark, signals):
    rows = [(f"s{i}", i + 1, [c.tolist() for c in x]) for i, x in enumerate(signals)]
    return spark.createDataFrame(rows, "source string, serial long, samples array<array<float>>")


def back(spark, files):
    rows = decode(ogg.packets_of(ogg.pages_of(files, strict=True), strict=True)).collect()
    out = {}
    for key in sorted({(r.source, r.chan) for r in rows}):
        own = sorted((r for r in rows if (r.source, r.chan) == key), key=lambda r: r.position)
        assert [r.position for r in own] == np.cumsum([0, *(len(r.samples) for r in own)])[:-1].tolist()
        out[key] = np.concatenate([r.samples for r in own])
    return out


def snr(x, y):
    return 10 * np.log10((x.astype(float) ** 2).sum() / ((x - y).astype(float) ** 2).sum())


def test_quality_ladder(spark):
    x, seen, sizes = tone(2, 12000), [], []
    for q in (-1, 4, 10):
        files = ogg_files(frame(spark, [x]), E.Config(RATE, 2, q)).cache()
        sizes.append(len(files.first().content))
        y = back(spark, files)
        assert all(len(v) == 12000 for v in y.values())
        seen.append(min(snr(x[c], y["s0", c]) for c in range(2)))
    assert seen[0] > 3 and seen[2] > 18 and seen == sorted(seen) and sizes == sorted(sizes)


@pytest.mark.parametrize("channels", [1, 6])
def test_layouts_and_short_inputs(spark, channels):
    signals = [tone(channels, n) for n in (1, 255, 1000, 2049, 5000)]
    y = back(spark, ogg_files(frame(spark, signals), E.Config(RATE, channels, 5)))
    for i, x in enumerate(signals):
        for c in range(channels):
            assert len(y[f"s{i}", c]) == x.shape[1]
    assert snr(signals[4][0], y["s4", 0]) > 6


def test_empty_and_silent(spark):
    files = ogg_files(frame(spark, [np.zeros((2, 0), np.float32), np.zeros((2, 3000), np.float32)]), E.Config(RATE))
    y = back(spark, files)
    assert set(y) == {("s1", 0), ("s1", 1)} and len(y["s1", 0]) == 3000 and not y["s1", 0].any()
    assert files.count() == 2


def test_tables_and_config():
    enc = E.Encoder(E.Config(44100, 6, 3))
    assert Setup.read(enc.headers()[2], 6) == enc.setup
    for lengths in (E.code_lengths([2.0**-k for k in range(60)], 12), E.code_lengths([1.0] * 5)):
        assert sum(2.0**-n for n in lengths) == 1 and max(lengths) <= 12
    for bad in ({"channels": 9}, {"rate": 7999}, {"quality": float("nan")}, {"quality": 11}):
        with pytest.raises(ValueError):
            E.Config(**bad)


def test_attack_makes_short_blocks():
    x = np.zeros((1, 20000), np.float32)
    assert all(b[1] for b in E.plan(x))
    x[0, 10000:10200] = np.random.default_rng(1).normal(size=200)
    blocks = E.plan(x)
    assert any(not b[1] and abs(b[0] - 10000) < 512 for b in blocks)
    for a, b in zip(blocks, blocks[1:], strict=False):
        assert a[3] == b[1] and b[2] == a[1] and b[0] - a[0] == E.BLOCKSIZES[a[1]] // 4 + E.BLOCKSIZES[b[1]] // 4


def test_packets_are_the_same_however_they_are_dealt(spark):
    df = frame(spark, [tone(1, 6000)])
    rows = lambda d: sorted((r.packet, r.granule, bytes(r.data)) for r in encode(d, E.Config(RATE, 1, 2)).collect())
    assert rows(df) == rows(df.repartition(3))
