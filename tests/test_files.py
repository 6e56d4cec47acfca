import numpy as np
import pytest

from spindrift.functions.encoder import Config
from spindrift.operators.decode import decode
from spindrift.operators.encode import encode
from spindrift.operators.files import decode_files, read_ogg, write_ogg
from spindrift.sources import ogg
from spindrift.sources.sink import file_name, write_files
from spindrift.streaming.audio import Live, stream_pcm


def tone(n, k):
    return (0.3 * np.sin(np.arange(n) * 0.05 * (k + 1))).astype(np.float32)


@pytest.fixture(scope="module")
def coded(spark):
    """Whole files by number of channels and length."""
    out = {}
    for ch, rows in {1: [("a", 7, 6000), ("b", 9, 3500)], 2: [("c", 8, 3000)]}.items():
        streams = spark.createDataFrame([(s, q, [tone(n, k).tolist() for k in range(ch)]) for s, q, n in rows], "source string, serial long, samples array<array<float>>")
        for r in encode(streams, Config(8000, ch, 5.0)).collect():
            out.setdefault((r.source, r.serial), []).append((r.packet, bytes(r.data), r.granule, r.flush))
    return {s: b"".join(p.to_bytes() for p in ogg.write_pages([x[1:] for x in sorted(packets)], q, 700)) for (s, q), packets in out.items()}


def whole(rows, source, chan=0):
    own = sorted((r for r in rows if r.source == source and r.chan == chan), key=lambda r: r["at"])
    at = 0
    for r in own:
        assert r["at"] == at
        at += len(r.samples)
    return np.concatenate([r.samples for r in own])


def test_chained_links(spark, coded):
    noise = b"".join(p.to_bytes() for p in ogg.write_pages([(b"other", 0, True), (b"data" * 9, 5, False)], 55))
    files = [("one", coded["a"]), ("two", coded["a"] + coded["b"]), ("same", coded["b"] + coded["b"]), ("mixed", noise + coded["b"] + noise), ("none", noise), ("empty", b""), ("null", None)]
    rows = decode_files(spark.createDataFrame(files, "source string, content binary")).collect()
    one, b = whole(rows, "one"), whole(rows, "mixed")
    assert (len(one), len(b)) == (6000, 3500)
    assert np.array_equal(whole(rows, "two"), np.concatenate((one, b)))
    assert np.array_equal(whole(rows, "same"), np.concatenate((b, b)))
    assert {r.source for r in rows} == {"one", "two", "same", "mixed"}
    assert {(r.link, r.serial) for r in rows if r.source == "two"} == {(0, 7), (1, 9)}
    with pytest.raises(Exception, match="differ in rate or channels"):
        decode_files(spark.createDataFrame([("x", coded["a"] + coded["c"])], "source string, content binary")).collect()


def test_interleaved_stream_is_skipped(spark, coded):
    a, b = list(ogg.read_pages(coded["a"])), list(ogg.read_pages(coded["b"]))
    turns = [p for pair in zip(a, b, strict=False) for p in pair] + a[len(b) :] + b[len(a) :]
    rows = decode_files(spark.createDataFrame([("x", b"".join(p.to_bytes() for p in turns))], "source string, content binary")).collect()
    assert {r.serial for r in rows} == {7} and len(whole(rows, "x")) == 6000


def test_files_are_written_and_read(spark, tmp_path):
    streams = spark.createDataFrame([("a b", 3, [tone(2500, 0).tolist()]), ("d/e", 4, [tone(900, 1).tolist()]), ("zero", 5, [[]])], "source string, serial long, samples array<array<float>>").repartition(2)
    write_ogg(streams, str(tmp_path / "out"), Config(8000, 1, 5.0))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"a b.ogg", "d%2Fe.ogg", "zero.ogg"}
    rows = read_ogg(spark, str(tmp_path / "out"), "FAILFAST").collect()
    assert sorted(len(whole(rows, s)) for s in {r.source for r in rows}) == [900, 2500]
    files = lambda *names: spark.createDataFrame([(n, b"x") for n in names], "source string, content binary")
    write_files(files("new"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 4
    write_files(files("new", "_hidden"), str(tmp_path / "out"), "overwrite")
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"new.ogg", file_name("_hidden", ".ogg")}
    with pytest.raises(Exception, match="same source"):
        write_files(files("k", "k"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_stream_of_pcm_equals_batch(spark, coded, tmp_path):
    names = [c.split()[0] for c in ogg.PAGES.split(", ")]
    rows = [(s, k, p.offset, p.flags, p.granule, p.serial, p.sequence, list(p.lacing), p.body, 0, 0) for s in ("a", "c") for k, p in enumerate(ogg.read_pages(coded[s]))]
    rows.sort(key=lambda r: r[1])
    assert len(names) == len(rows[0])
    step = -(-len(rows) // 4)
    for at in range(0, len(rows), step):
        spark.createDataFrame(rows[at : at + step], ogg.PAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{at:05d}"))
    live = spark.readStream.schema(ogg.PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream_pcm(live).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(240) and q.exception() is None
    key = lambda d: sorted((r.source, r.chan, r.packet, r.position, len(r.samples), r.samples) for r in d.collect())
    got, want = key(spark.read.parquet(str(tmp_path / "out"))), key(decode(ogg.packets_of(spark.createDataFrame(rows, ogg.PAGES))))
    assert [g[:5] for g in got] == [w[:5] for w in want] and len(got) > 10
    assert max(np.abs(np.array(g[5]) - np.array(w[5])).max() for g, w in zip(got, want, strict=True)) < 1e-6


def test_state_of_a_stream_comes_back(coded):
    whole_, cut, out, back = Live(), Live(), [], []
    for p in ogg.read_packets(ogg.read_pages(coded["c"])):
        out += [(c, n, at, x.tolist()) for c, n, at, x in whole_.push(p.data, p.granule, p.eos, True)]
        back += [(c, n, at, x.tolist()) for c, n, at, x in cut.push(p.data, p.granule, p.eos, True)]
        cut = Live.load(*cut.state())
    assert out == back and sum(len(x[3]) for x in out) == 6000
