import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from spindrift.llm import langid
from spindrift.llm.queries import op9_naive_bayes_language

EN, DE = "the quick brown fox and the dog ", "der schnelle braune Fuchs und über Hünde "
SF = "/root/testdata/sf0.01"
MASK = (1 << 32) - 1
MIX = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1]


def bucket(gram):
    h = len(gram) * MIX[4] & MASK
    for i, c in enumerate(gram):
        h = (h ^ ord(c)) * MIX[i % 4] & MASK
        h ^= h >> 15
    return (h * MIX[0] & MASK) >> 17


def slow_counts(text):
    t = text.lower()
    return Counter(bucket(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))


def slow_bayes(rows):
    """Plain multinomial naive Bayes: lang and posterior of every (id, text, lang)."""
    seen, docs = {}, Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            seen.setdefault(lang, Counter()).update(slow_counts(text))
            docs[lang] += 1
    total, size = sum(docs.values()), {x: sum(c.values()) for x, c in seen.items()}
    for i, text, _ in rows:
        if not seen or text is None or not any(c.isalpha() for c in text):
            yield i, "und", 0.0
            continue
        s = {x: math.log(docs[x] / total) for x in seen}
        for b, n in slow_counts(text).items():
            for x in seen:
                s[x] += n * math.log((seen[x][b] + 0.5) / (size[x] + 0.5 * 32768))
        best = min(s, key=lambda x: (-s[x], x))
        yield i, best, 1 / sum(math.exp(v - s[best]) for v in s.values())


def frame(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "123 !!", "de", 1), (102, "the dog", None, 1), (None, "der Fuchs", "de", 1), (3, EN, "en", 1), (104, "", "de", 1), (105, EN * 60000, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int").repartition(3)


def test_cases(spark):
    got = [tuple(x) for x in langid.identify(frame(spark)).collect()]
    assert len(got) == 67
    for did, held, lang, score in got:
        assert held == (did is not None and zlib.crc32(str(did).encode()) % 4 == 2)
        assert 0 <= score <= 1
        if did in (100, 101, 104):
            assert (lang, score) == ("und", 0)
        elif did is not None and did < 60:
            assert lang == ("en" if did % 2 else "de")
    by = {x[0]: x[2] for x in got}
    assert by[102] == "en" and by[105] == "en" and by[None] == "de"
    assert langid.identify(frame(spark).limit(0)).collect() == []


@pytest.mark.parametrize("chunk, short", [(1 << 18, 1 << 12), (40, 10)])
def test_equals_plain_naive_bayes(spark, monkeypatch, chunk, short):
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    monkeypatch.setattr(langid, "_SHORT", short)
    r = np.random.default_rng(1)
    words = {x: ["".join(chr(97 + c % 26) for c in r.integers(k, k + 18, r.integers(1, 9))) for _ in range(60)] for k, x in enumerate(("aa", "bb", "cc"))}
    words["bb"] += ["straße", "ÉTÉ", "日本"]
    rows = []
    for i in range(90):
        lang = ("aa", "bb", "cc")[i % 3]
        mixed = [w for x in words for w in words[x]] if i % 7 == 0 else words[lang]
        rows.append((i if i != 17 else None, " ".join(r.choice(mixed, r.integers(0, 30))), lang if i % 11 else None))
    rows += [(900, None, "aa"), (901, "7 7", "bb"), (902, "", "cc")]
    blocks = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), block=2)
    assert [b[0] for b in blocks] == [["aa", "bb"], ["cc"]]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)).collect()}
    for i, lang, score in slow_bayes(rows):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9, i


def test_blocks_of_languages_give_the_same(spark):
    df = frame(spark).selectExpr("doc_id", "text", "case when doc_id % 4 = 0 then 'fr' when doc_id % 4 = 1 then 'it' else lang end as lang")
    one, many = (sorted((x.doc_id or -1, x.lang_pred, round(x.score, 9)) for x in langid.predict(df, langid.fit(df, block=b)).collect()) for b in (256, 1))
    assert one == many and len(langid.fit(df, block=1)) == 4


def test_held_out_accuracy(spark):
    """At least 99 % of the held-out labelled documents, none of which was learned from."""
    got = {x.doc_id: x for x in op9_naive_bayes_language(spark, SF).collect()}
    rows = duckdb.sql(f"select doc_id, lang, text from read_parquet('{SF}/documents.parquet') where lang is not null and text is not null").fetchall()
    held = [(got[i].lang_pred, lang) for i, lang, text in rows if zlib.crc32(str(i).encode()) % 4 == 2 and any(c.isalpha() for c in text)]
    assert len(held) > 200
    assert sum(a == b for a, b in held) >= 0.99 * len(held)


def test_nothing_to_learn(spark):
    df = frame(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {x.lang_pred for x in langid.identify(df).collect()} == {"und"}


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "àbc déf ghi" * 50
    want = slow_counts(text)
    for short, size in ((1 << 12, 1 << 20), (0, 1 << 20), (0, 7)):
        monkeypatch.setattr(langid, "_SHORT", short)
        monkeypatch.setattr(langid, "_SLICE", size)
        ends, cols, data = langid.sparse(["", text])
        assert ends.tolist() == [0, len(cols)]
        sums = np.bincount(cols, data, langid.BUCKETS)
        assert {i: int(sums[i]) for i in np.flatnonzero(sums)} == want
        assert sums.sum() == 3 * len(text) - 3


def test_many_languages(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03d}") for i in range(600)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert [len(b[0]) for b in model] == [256, 256, 88]
    assert all(x.lang_pred == x.lang for x in langid.predict(df, model).collect())
