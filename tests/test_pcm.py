import numpy as np

from spindrift.functions.encoder import Config
from spindrift.operators.encode import ogg_files
from spindrift.sources import ogg, pcm


def test_headers_and_raw_samples(spark, tmp_path):
    x = np.array([[0, 16384, -32768], [1, -1, 32767]], dtype="<i2")
    raw = spark.createDataFrame([("a", x.T.tobytes() + b"\0"), ("b", b""), ("c", None)], "source string, content binary")
    got = {r.source: r.samples for r in pcm.raw_pcm(raw, 2).collect()}
    assert np.array_equal(np.array(got["a"]) * 32768, x) and got["b"] == got["c"] == [[], []]
    streams = spark.createDataFrame([("s", 5, [[0.1] * 600])], "source string, serial long, samples array<array<float>>")
    config = Config(8000, 1, 3.0, ("TITLE=x", "title=é"))
    content = bytes(ogg_files(streams, config).first().content)
    (tmp_path / "a.ogg").write_bytes(content)
    (tmp_path / "b.ogg").write_bytes(b"nothing")
    rows = {r.source[-5:]: r for r in pcm.ogg_headers(spark, str(tmp_path)).collect()}
    a = rows["a.ogg"]
    assert (a.serial, a.channels, a.rate, a.blocksizes, a.comments, a.error) == (5, 1, 8000, [256, 2048], ["TITLE=x", "title=é"], None)
    assert rows["b.ogg"].error and rows["b.ogg"].rate is None
    heads = [p.data for p in ogg.read_packets(ogg.read_pages(content))][:3]
    laced = spark.createDataFrame([("l", ogg.xiph_lace(heads)), ("m", b"\2")], "source string, content binary")
    rows = {r.source: r for r in pcm.headers_of(laced, laced=True).collect()}
    assert rows["l"].rate == 8000 and rows["m"].error


def test_fnv():
    assert pcm.fnv1a(b"") == 0xCBF29CE484222325 and pcm.fnv1a(b"a") == 0xAF63DC4C8601EC8C
