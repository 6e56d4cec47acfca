import numpy as np
import pytest

from spindrift.llm import crosspoly


def pairs_at(cos, n, dim, seed):
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cos * a + (1 - cos**2) ** 0.5 * b


@pytest.mark.parametrize(("n", "dim"), [(50_000, 64), (10_000_000, 64), (50_000, 768)])
def test_recall_at_the_threshold(n, dim):
    a, b = pairs_at(0.9, 400, dim, 1)
    hashes, tables = crosspoly.shape(n, dim)
    ka, kb = (crosspoly.bucket_keys(x, hashes, tables).reshape(len(x), -1) for x in (a, b))
    found = np.array([len(np.intersect1d(x, y)) > 0 for x, y in zip(ka, kb, strict=True)])
    assert found.mean() >= 0.98


@pytest.mark.parametrize("block", [1024, 3])
def test_equals_brute_force(spark, block):
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 16))
    x = np.concatenate((x, x[:40] + 0.1 * r.normal(size=(40, 16)), np.repeat(x[:1], 12, axis=0) + 0.05 * r.normal(size=(12, 16)), x[:5], 3 * x[5:8]))
    rows = [(i + 3, [float(v) for v in y], "c") for i, y in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(1000 + i, v, "c") for i, v in enumerate(bad)] + [(1100, [1.0, 2.0], "c"), (1101, [2.0, 4.0], "c"), (1102, [-0.0, 1.0], "c"), (1103, [0.0, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string").repartition(3)
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in crosspoly.near_duplicates(df, block=block).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i < 1000 or i >= 1100}
    up = {i: i for i, _, _ in rows}
    count = dict.fromkeys(up, 0)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9:
                count[a] += 1
                count[b] += 1
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    assert got == {i: (count[i], top(i), top(i) == i) for i in up}
    assert max(count.values()) > 10


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {tuple(x) for x in crosspoly.near_duplicates(df).collect()}
    assert got == {(None, 1, 4, False), (4, 1, 4, True), (9, 0, 9, True)}
    assert crosspoly.near_duplicates(df.limit(0)).collect() == []
