import hashlib
import random

import pytest

from spindrift.llm import suffix

SCHEMA = "doc_id long, text string, s string, th string"


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone, strict=True):
        kept = bytes(c for c, x in zip(t, g, strict=True) if not x)
        out.append((len(t), sum(g), sum(x and not (i and g[i - 1]) for i, x in enumerate(g)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 5)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(5)]
    docs = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        docs.append(r.choice(["", " ", "x"]).join(parts))
    return docs + docs[:3] + ["ab" * 200, "Aich " * 50, None, "", "é" * 100]


@pytest.mark.parametrize("limit", [suffix.GROUP_LIMIT, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, limit):
    docs = corpus(seed)
    rows = [(i if i != 5 else None, t, "clash", "clash") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_substrings(df, length=60, gram=8, group_limit=limit).collect()}
    want = brute([(t or "").encode() for t in docs], 60)
    assert len(got) == len(docs)
    assert sum(x[1] for x in want) > 0
    for i, w in enumerate(want):
        assert got[i if i != 5 else None] == w, i


def test_repeated_rows_and_empty(spark):
    t = "q" * 30 + "".join(random.Random(3).choice("abc") for _ in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (2, "zz")], "doc_id long, text string")
    got = sorted(r[:4] for r in suffix.dedup_substrings(df, length=40, gram=8).collect())
    assert got == [(1, 80, 80, 1), (1, 80, 80, 1), (2, 2, 0, 0)]
    assert suffix.dedup_substrings(df.limit(0), length=40, gram=8).collect() == []


def test_sort_gives_order_and_prefixes():
    r = random.Random(4)
    base = bytes(r.choice(b"ab") for _ in range(300))
    strings = [base[: r.randint(0, 300)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 5))) for _ in range(300)]
    order, lcps = suffix.deep_shallow_sort(strings, shallow=16)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(299):
        a, b = strings[order[k]], strings[order[k + 1]]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcps[k] == n


def test_long_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_ROWS", 100)
    df = spark.createDataFrame([(1, "ab" * 3000), (2, "x")], "doc_id long, text string")
    assert sorted(r[:4] for r in suffix.dedup_substrings(df, length=40, gram=8).collect()) == [(1, 6000, 6000, 1), (2, 1, 0, 0)]
