import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import mdct
from spindrift.functions import scalar as S
from spindrift.operators import floors
from spindrift.operators import signals as G


def basis(n):
    i, k = np.arange(n)[:, None], np.arange(n // 2)[None]
    return np.cos(2 * np.pi / n * (i + 0.5 + n / 4) * (k + 0.5))


@pytest.mark.parametrize("n", [64, 128, 256, 512, 2048])
def test_mdct_equals_its_definition(n):
    r = np.random.default_rng(n)
    x, s = r.normal(size=(3, n)), r.normal(size=(3, n // 2))
    assert np.abs(mdct.forward(x) - 4 / n * x @ basis(n)).max() < 1e-9
    assert np.abs(mdct.inverse(s) - s @ basis(n).T).max() < 1e-8


def test_lapped_blocks_give_the_signal_back():
    n = 256
    x = np.random.default_rng(1).normal(size=n * 5)
    w, out = mdct.window(n, n, n), np.zeros(n * 5)
    for at in range(0, n * 4 + 1, n // 2):
        out[at : at + n] += mdct.inverse(mdct.forward((x[at : at + n] * w)[None]))[0] * w
    assert np.abs(out - x)[n // 2 : -n // 2].max() < 1e-9


@pytest.mark.parametrize(("n", "left", "right"), [(256, 256, 256), (2048, 256, 2048), (2048, 2048, 256)])
def test_windows_are_power_complementary(n, left, right):
    w = mdct.window(n, left, right)
    rise = w[n // 4 - left // 4 : n // 4 + left // 4]
    assert np.abs(rise**2 + rise[::-1] ** 2 - 1).max() < 1e-12


def test_exhaustive_coupling_splitting_and_floor_values(spark):
    pairs = spark.range(81 * 81).select((F.col("id") % 81 - 40).alias("l"), (F.floor(F.col("id") / 81) - 40).alias("r"))
    c = S.couple(F.col("l"), F.col("r"))
    back = pairs.withColumn("c", c).withColumn("b", S.decouple(F.col("c.m"), F.col("c.a")))
    assert back.where("b.l <> l or b.r <> r").count() == 0
    q = spark.range(-15592, 15593).withColumn("s", S.split(F.col("id"), F.lit(3)))
    assert q.where((F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x) != F.col("id")) | (F.abs(F.col("s")[2]) > 16) | (F.abs(F.col("s")[1]) > 231)).count() == 0
    for span in S.RANGES:
        t = spark.range(span * span).select((F.col("id") % span).cast("int").alias("t"), F.floor(F.col("id") / span).cast("int").alias("p"))
        v = t.withColumn("v", floors.encode_value(F.col("t"), F.col("p"), F.lit(span)))
        assert v.where((floors.decode_value(F.col("v"), F.col("p"), F.lit(span)) != F.col("t")) | (F.col("v") < 0) | (F.col("v") >= span)).count() == 0


def test_golden_values(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    points = [((0, 10, 10, 20, 5), 15), ((0, 10, 3, 20, 1), 13), ((0, 20, 3, 10, 1), 17), ((0, 7, 8, 7, 3), 7)]
    for args, want in points:
        assert get(S.render_point(*map(F.lit, args))) == want
    for (m, a), want in [((3, 1), (3, 2)), ((3, -1), (2, 3)), ((-3, 1), (-3, -2)), ((-3, -1), (-2, -3)), ((0, 0), (0, 0))]:
        assert tuple(get(S.decouple(F.lit(m), F.lit(a)))) == want
    assert get(S.ogg_crc(F.lit(b"123456789"))) == 0x89A1897F and get(S.ogg_crc(F.lit(b""))) == 0
    assert get(S.float32_unpack(F.lit(786 << 21 | 1))) == 0.25
    assert get(S.inverse_db(F.lit(255))) == 1.0
    posts = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 128, 64, 32, 96, 16, 48, 80, 112])], "g string, i int, v int")
    got = {r.i: (r.low, r.high) for r in floors.neighbors(posts, "g").collect()}
    assert [got[i] for i in range(2, 9)] == [(0, 1), (0, 2), (2, 1), (0, 3), (3, 2), (2, 4), (4, 1)]
    line = spark.createDataFrame([("a", 0, 20), ("a", 64, 40 - 2), ("a", 64 + 64, 40)], "g string, x int, y int")
    assert floors.curve(line, ["g"], 140).count() == 140


@pytest.mark.parametrize("run", [4, 1 << 16])
def test_running_sums_by_runs(spark, run):
    rows = [(k, i, i * 3 % 7) for k in ("a", None) for i in range(23)] + [("b", 5, 1)]
    df = spark.createDataFrame(rows, "key string, i long, v long").repartition(3)
    got = {(r.key, r.i): (r.n, r.total) for r in G.running(df, ["key"], ["i"], {"n": F.lit(1), "total": F.col("v")}, run).collect()}
    for k, i, _ in rows:
        before = [v for kk, j, v in rows if kk == k and j < i]
        assert got[k, i] == (len(before), sum(before))


def test_overlap_of_any_sizes(spark):
    r = np.random.default_rng(8)
    sizes = [64, 64, 256, 64, 256, 256, 1024, 64]
    x = [r.normal(size=n) for n in sizes]
    df = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "s string, k long, x array<double>")
    got = {row.k: row.samples for row in G.overlap_add(df, ["s"], "k", "x").collect()}
    assert sorted(got) == list(range(1, len(sizes)))
    for k, y in got.items():
        p, n = sizes[k - 1], sizes[k]
        shift, want = n // 4 - p // 4, []
        for i in range(p // 4 + n // 4):
            a = x[k - 1][p // 2 + i] if p // 2 + i < p else 0
            b = x[k][i + shift] if 0 <= i + shift < n else 0
            want.append(a + b)
        assert np.allclose(y, want, atol=1e-12)
