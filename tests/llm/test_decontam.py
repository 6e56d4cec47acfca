import hashlib
import random
import re

import pytest

from spindrift.llm.decontam import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, length):
    out = []
    for did, text in docs:
        ws, hit, found = split(text), set(), set()
        for iid, t in items:
            iw = split(t)
            n = min(length, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if n and tuple(ws[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    if iid is not None:
                        found.add(str(iid))
        out.append((did, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("set_limit", [50_000, 0])
@pytest.mark.parametrize(("length", "gram", "seed"), [(10, 5, 1), (6, 3, 2), (4, 4, 3)])
def test_equals_brute_force(spark, length, gram, seed, set_limit):
    r = random.Random(seed)
    word = lambda: r.choice("the of Éa éa a b c dd 12 x9 ÉÀ ǅa".split())
    items = [(i if i % 7 else None, " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 30])))) for i in range(25)] + [(50, None), (51, "..."), (3, "Zz yy xx ww vv uu tt ss rr qq pp")]
    docs = []
    for i in range(60):
        parts = [(r.choice(items)[1] or "") if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 6))]
        t = r.choice([" ", ".\n", "-"]).join(parts)
        docs.append((i, t.upper() if i % 9 == 0 and t.isascii() else t))
    docs += [(100, None), (101, ""), (102, "ZZ yy.xx ww vv uu tt ss rr qq PP"), (5, docs[5][1]), (None, docs[7][1])]
    a = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, uid int, h int").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    key = lambda x: tuple(str(v) for v in x)
    got = sorted((tuple(x)[:6] for x in decontaminate(a, b, length=length, gram=gram, set_limit=set_limit).collect()), key=key)
    assert got == sorted(brute(docs, items, length), key=key)
    assert any(x[5] for x in got)


def test_empty_tables(spark):
    a = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [x[:4] for x in decontaminate(a, b).collect()] == [(1, 3, 0, 0)]
    assert decontaminate(a.limit(0), b).collect() == []


@pytest.mark.parametrize("set_limit", [50_000, 0])
def test_very_long_text(spark, set_limit):
    """60,000 words with an item at either end, and items of four, five and ten words."""
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    items = [(1, item), (2, "one two three four five"), (3, "six seven eight nine")]
    text = item + " " + " ".join(f"w{i * 7919 % 5003}" for i in range(60_000)) + " one two three four five " + item
    docs = [(1, text), (2, "one two three four six seven eight nine ten"), (3, "two three four five six")]
    got = sorted(tuple(x)[:6] for x in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), set_limit=set_limit).collect())
    assert got == sorted(brute(docs[1:], items, 10) + [(1, 60_025, 25, 2, hashlib.sha256(b"1,2").hexdigest(), True)])
