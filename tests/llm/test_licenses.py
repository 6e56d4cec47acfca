import random
import re

from spindrift.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def longest_chain(points):
    """Most points that ascend in both, by comparing all of them."""
    points = sorted(points)
    best = []
    for i, (p, q) in enumerate(points):
        best.append(1 + max((best[j] for j in range(i) if points[j][0] < p and points[j][1] < q), default=0))
    return max(best)


def brute(text, share=0.8, drift=3):
    ws = words_of(text)
    places, labels, top = [], set(), 0.0
    for n, (label, phrase) in enumerate([*licenses.BASE, *licenses.NOTICES]):
        ts, base = phrase.split(), n < len(licenses.BASE)
        k = min(2 if base else licenses.GRAM, len(ts))
        votes = [(p, q) for q in range(len(ts) - k + 1) for p in range(len(ws) - k + 1) if ws[p : p + k] == ts[q : q + k]]
        best = max((longest_chain([v for v in votes if abs(v[0] - v[1] - d) <= drift]) for d in {p - q for p, q in votes}), default=0)
        top = max(top, best / (len(ts) - k + 1))
        if base:
            places += [(p, label) for p in range(len(ws)) if ws[p : p + len(ts)] == ts]
        elif best / (len(ts) - k + 1) >= share:
            labels.add(label)
    at = [p for p, _ in places]
    own = {x for _, x in places}
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), top


def corpus():
    r = random.Random(1)
    vocab = "gnu general public license apache cc by mit the É nc".split()
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 40))) for _ in range(80)]
    texts += [None, "", "GNU-General\nPublic LICENSE", "CC BY-NC 4.0 and cc by"]
    for _, t in licenses.NOTICES:
        ws = t.split()
        for _ in range(3):
            kept = [w for w in ws if r.random() > 0.03]
            at = r.randrange(len(kept) + 1)
            texts.append(" ".join(["x"] * r.randint(0, 9) + kept[:at] + ["put", "in"][: r.randint(0, 2)] + kept[at:] + r.sample(ws, len(ws) // 3)))
        texts.append(" ".join(ws[::-1]))
    return texts


def test_all_columns_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i if i else None, t, "z", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "z", 1, 2)], "doc_id long, text string, label string, t int, uid int").repartition(3)
    got = {}
    for x in licenses.scan(df).collect():
        assert got.setdefault(x.doc_id, x) == x
        assert set(x.labels.split(",")) - {""} == {s.label for s in x.spans}
        assert all(0 <= s.first <= s.last < x.n_words and s.score >= 0.8 for s in x.spans)
    labelled = 0
    for i, t in enumerate(texts):
        x, want = got[i if i else None], brute(t)
        assert tuple(x)[1:7] == want[:6], t
        assert abs(x.score - want[6]) < 1e-12, t
        labelled += bool(x.labels) and not x.base_labels
    assert labelled > 30
    assert licenses.scan(df.limit(0)).collect() == []


def test_spans_are_verified(spark):
    """A notice in another order, or of pairs from all over the text, is no notice."""
    proprietary = dict((x, t) for x, t in licenses.NOTICES)["proprietary"].split()
    pairs = lambda ws: " ".join(w for i in range(len(ws) - 2, -1, -1) for w in ws[i : i + 2])
    mit = words_of(MIT)
    texts = [pairs(proprietary), pairs(mit), MIT, "x " * 50 + MIT.replace(" free", " and free") + " y" * 9, " z ".join(" ".join(mit[i : i + 4]) for i in range(0, len(mit), 2)), " ".join(proprietary)]
    rows = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(6)] == ["", "", "mit", "mit", "", "proprietary"]
    assert rows[2].score == 1 and (rows[2].spans[0].first, rows[2].spans[0].last) == (0, len(mit) - 1)
    assert rows[3].spans[0].first == 50 and 0.8 <= rows[3].score < 1


def test_very_long_text(spark):
    """20,000 places of two base phrases and as many words between."""
    text = "the apache license and cc by " * 20_000
    x = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (x.n_words, x.n_base, x.first_word, x.last_word) == (120_000, 40_000, 1, 119_998)
    assert x.labels == x.base_labels == "apache,cc-by" and len(x.spans) == 40_000
