import numpy as np
import pytest

from spindrift.functions import encoder
from spindrift.operators.encode import encode
from spindrift.sources import ogg
from spindrift.streaming.encode import CHUNKS, stream_encode
from spindrift.streaming.packets import stream_packets


def test_stream_equals_batch(spark, tmp_path):
    sizes = [0, 300, 70000, 5, 255, 9000]
    raw = b"".join(p.to_bytes() for p in ogg.write_pages([(bytes([i]) * n, i, False) for i, n in enumerate(sizes)], 3, 1000))
    pages = list(ogg.read_pages(raw))
    names = [c.split()[0] for c in ogg.PAGES.split(", ")]
    rows = [("f", k, p.offset, p.flags, p.granule, p.serial, p.sequence, list(p.lacing), p.body, 0, 0) for k, p in enumerate(pages)]
    folder = tmp_path / "in"
    for at in range(0, len(rows), 2):  # two pages a micro-batch, by file time
        spark.createDataFrame(rows[at : at + 2], ogg.PAGES).select(*names).coalesce(1).write.mode("append").parquet(str(folder / f"b{at:05d}"))
    live = spark.readStream.schema(ogg.PAGES).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    out = str(tmp_path / "out")
    q = stream_packets(live).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(240)
    assert q.exception() is None
    key = lambda d: sorted((r.packet, r.granule, r.bos, r.eos, bytes(r.data), r.lost) for r in d.collect())
    batch = ogg.packets_of(spark.createDataFrame(rows, ogg.PAGES))
    got = key(spark.read.parquet(out))
    assert got == key(batch)
    assert [len(r[4]) for r in got] == sizes


@pytest.mark.parametrize("channels", [1, 2])
def test_pushed_chunks_give_the_packets_of_whole_signals(channels):
    r = np.random.default_rng(channels)
    enc = encoder.Encoder(encoder.Config(22050, channels, 3))
    for total in (0, 1, 63, 64, 65, 700, 2176, 9001):
        x = (0.02 * r.normal(size=(channels, total))).astype(np.float32)
        x[:, total // 2 : total // 2 + 90] *= 40
        whole = [(k + 3, min(c, total), enc.block(encoder.cut(x, c, encoder.BLOCKSIZES[n]), n, b, a)) for k, (c, n, b, a) in enumerate(encoder.plan(x))]
        for size in (1, 50, 640, 10_000):
            if size == 1 and total > 700:
                continue
            live, got = encoder.Push(enc), []
            for at in range(0, total, size):
                got += live.push(x[:, at : at + size])
                live = encoder.Push.load(enc, *live.state())
                assert live.samples.shape[1] <= 5000 + size
            got += live.finish()
            assert got == whole, (total, size)
            with pytest.raises(ValueError, match="ended"):
                live.push(x)
    with pytest.raises(ValueError, match="channels"):
        encoder.Push(enc).push(np.zeros((channels + 1, 5)))


def test_streamed_encode_equals_batch(spark, tmp_path):
    r = np.random.default_rng(7)
    x = {s: (0.1 * r.normal(size=(2, n))).astype(np.float32) for s, n in (("a", 9000), ("b", 2500))}
    folder = tmp_path / "in"
    cuts = {s: np.array_split(v, 3, axis=1) for s, v in x.items()}
    for k in range(3):
        rows = [(s, 5, k, k == 2, cuts[s][k].tolist()) for s in x]
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.parquet(str(folder / f"b{k}"))
    live = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    out, config = str(tmp_path / "out"), encoder.Config(44100, 2, 4)
    q = stream_encode(live, config).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination(240)
    assert q.exception() is None
    key = lambda d: sorted((p.source, p.packet, p.granule, p.flush, bytes(p.data)) for p in d.collect())
    want = encode(spark.createDataFrame([(s, 5, v.tolist()) for s, v in x.items()], "source string, serial long, samples array<array<float>>"), config)
    assert key(spark.read.parquet(out)) == key(want)
