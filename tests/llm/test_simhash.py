import random
import re

import pytest
import xxhash

from spindrift.llm import simhash
from spindrift.llm.common import components


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least_reachable(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("limit", [32, 1])
def test_groups_equal_brute_force(spark, limit):
    r = random.Random(5)
    texts = [" ".join(r.choice("aa bb cc É é dd".split()) for _ in range(r.randint(0, 9))) for _ in range(60)]
    long_ = ["w%d" % r.randrange(1000) for _ in range(900)]
    for i in range(25):
        ws = list(long_)
        ws[r.randrange(900)] = f"new{i}"
        texts.append(" ".join(ws))
    texts += [None, "", " \t\n", "\x1fx y\x85z w", "AA bb CC", texts[3]]
    df = spark.createDataFrame([(i + 10, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp long, n long").repartition(3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_groups(df, cell_limit=limit).collect()}
    fps = {i + 10: slow_fingerprint(t) for i, t in enumerate(texts)}
    least = least_reachable(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert len({v for v in least.values()}) < len(set(fps.values()))
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


@pytest.mark.parametrize("limit", [32, 1])
@pytest.mark.parametrize(("bits", "m"), [(0, None), (1, None), (2, None), (2, 7), (1, 16)])
def test_links_of_close_fingerprints(spark, limit, bits, m):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(4)] + [0]
    fps = set(base)
    for b in base:
        for _ in range(30):
            fps.add(b ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4))))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    got = {x.node: x.root for x in components(simhash.links(df, bits, limit, m)).collect()}
    nodes = [sign(x) for x in fps]
    least = least_reachable(nodes, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= bits)
    assert {n: got.get(n, n) for n in nodes} == least


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "x y")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.simhash_groups(df).collect()), key=str)
    assert got == [(7, 7), (None, 7), (None, None)]
    assert simhash.simhash_groups(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}


def test_blocks_grow_with_the_number_of_fingerprints():
    sizes = [simhash.grid_blocks(n) for n in (0, 10, 10**5, 10**7, 10**9, 10**11)]
    assert sizes == sorted(sizes) and sizes[2] == 4 and 4 < sizes[-1] <= 16
    assert simhash.grid_blocks(10**9, 0) >= 2


def test_very_long_texts(spark, monkeypatch):
    """Texts of several slices of shingles, alike but for a word at the end."""
    monkeypatch.setattr(simhash, "_SLICE", 1000)
    ws = [f"w{i * 7919 % 3001}" for i in range(5500)]
    texts = [" ".join(ws), " ".join([*ws[:-1], "other"]), " ".join(ws[::-1])]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    got = {x.doc_id: x.component_id for x in simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert got == least_reachable([0, 1, 2], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
