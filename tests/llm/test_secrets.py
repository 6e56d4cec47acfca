import base64
import hashlib
import math
import random
import re
import string
import uuid
from itertools import pairwise

from pyspark.sql import functions as F

from spindrift.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def corpus():
    r = random.Random(2)
    bits = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "é😀", "AKIA", "ABCD1234EFGH5678", "abcdef0123456789", "deadbeef", "xyz", ".", "-", "\n", "token=password=abcdefghijkl", "K", "ſecret"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(200)]
    return [*texts, None, "", "abcdef0123456789 é " * 700, "token: secret: abcdefghijklmnop"]


def test_base_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)] + [(None, texts[7], 1, "c")], "doc_id long, text string, base int, cand string").repartition(3)
    rows = secrets.scan(df).collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        text = texts[x.doc_id if x.doc_id is not None else 7] or ""
        want = base(text)
        assert [(s["s"], s["k"], s["e"]) for s in x["all"] if s["k"] < 3] == want, text
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(x.spans.split(",")) | {""}
    assert secrets.scan(df.limit(0)).collect() == []


def alphabet(v):
    core = re.sub("[-_/+]", "", v)
    digit, lower, upper = (re.search(x, core) for x in ("[0-9]", "[a-z]", "[A-Z]"))
    if not digit or not (lower or upper):
        return None
    if lower and upper:
        return 64, v.replace("-", "+").replace("_", "/"), secrets.BASE64
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", core):
        return 16, core.lower(), "0123456789abcdef"
    if re.fullmatch("[A-Z2-7]+", core):
        return 32, core, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return 36, core.lower(), "abcdefghijklmnopqrstuvwxyz0123456789"


def kind(c):
    return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3


RANDOM_CHANGES = {16: 1 - (36 + 100) / 256, 32: 1 - (26**2 + 6**2) / 32**2, 36: 1 - (26**2 + 10**2) / 36**2, 64: 1 - (2 * 26**2 + 10**2 + 2**2) / 64**2}


def slow_battery(v):
    """chi-squared, runs and serial correlation, each with the logistic normal tail."""
    size, text, letters = alphabet(v)
    tail = lambda z: 1 / (1 + math.exp(max(-700, min(700, 1.5976 * z + 0.07056 * z**3))))
    n, at = len(text), [letters.index(c) for c in text]
    chi = sum((text.count(c) - n / size) ** 2 / (n / size) for c in letters)
    p_chi = tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    often, changes = RANDOM_CHANGES[size], sum(kind(a) != kind(b) for a, b in pairwise(text))
    p_runs = 2 * tail(abs(changes - (n - 1) * often) / math.sqrt((n - 1) * often * (1 - often)))
    mu = sum(at) / n
    sq = sum((x - mu) ** 2 for x in at)
    p_corr = 2 * tail(abs(sum((x - mu) * (y - mu) for x, y in pairwise(at)) / sq + 1 / n) * math.sqrt(n)) if sq else 0
    return min(1, 3 * min(p_chi, p_runs, p_corr))


def slow_structure(v):
    size, text, _ = alphabet(v)
    prose = [0.85 * x / sum(secrets.PROSE) + 0.15 / 26 for x in secrets.PROSE]
    found = [string.ascii_lowercase.index(c) for c in text.lower() if c.isalpha()]
    if size == 16:
        return sum(prose[:6]) ** len(found)
    weight = [math.log(1 / 26 / p) for p in prose]
    mean = sum(p * w for p, w in zip(prose, weight, strict=True))
    var = sum(p * (w - mean) ** 2 for p, w in zip(prose, weight, strict=True))
    r, s, n = RANDOM_CHANGES[size], secrets.CHANGES[size], len(text) - 1
    a, b, changes = math.log(r / s), math.log((1 - r) / (1 - s)), sum(kind(x) != kind(y) for x, y in pairwise(text))
    total = sum(weight[i] for i in found) + changes * a + (n - changes) * b
    z = (total - len(found) * mean - n * (s * a + (1 - s) * b)) / math.sqrt(len(found) * var + n * s * (1 - s) * (a - b) ** 2)
    return 0.5 * math.exp(-z * z / 2) if z > 0 else 1 - 0.5 * math.exp(-z * z / 2)


def slow_random(texts, q=0.05, alpha=0.01):
    """All random spans: candidates less base spans, tested, then controlled in each class."""
    tests = {}
    for i, text in enumerate(texts):
        spans = base(text or "")
        for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", text or ""):
            at = m.start()
            for s, _, e in [x for x in spans if x[0] < m.end() and m.start() < x[2]] + [(m.end(), 9, m.end())]:
                v = text[at:s] if s > at else ""
                if len(v) >= 24 and alphabet(v):
                    p = 1.0 if slow_battery(v) < alpha else slow_structure(v)
                    step = min(120, math.floor(-10 * math.log10(max(p, 1e-13))))
                    tests.setdefault((alphabet(v)[0], int(math.log2(len(v)))), []).append((step, i, at, s))
                at = max(at, e)
    out = set()
    for rows in tests.values():
        steps = [x[0] for x in rows]
        ok = [t for t in steps if len(rows) * 10 ** (-t / 10) <= q * sum(x >= t for x in steps)]
        out |= {x[1:] for x in rows if ok and x[0] >= min(ok)}
    return out


def mixed(seed=3):
    """Keys of several alphabets, paths, identifiers, and keys beside base spans."""
    r = random.Random(seed)
    names = "js users api lib article img static src main test resources node modules build config data index home assets public vendor local share python packages view controller model service factory manager request response user list map value stream buffer file client server session token cache event parser render update create load".split()
    pick = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    texts = {"key": [], "path": [], "name": [], "other": []}
    for _ in range(300):
        texts["key"].append("k " + base64.b64encode(r.randbytes(r.choice([24, 32, 36, 48]))).decode().rstrip("=") + " z")
        parts = []
        while len("/".join(parts)) < 26:
            w = r.choice(names)
            parts.append(r.choice([w, w.capitalize(), w + str(r.randint(0, 99)), str(r.randint(1990, 2030)), w]))
        texts["path"].append("see /" + "/".join(parts) + " and")
        name = r.choice(names)
        while len(name) < 24:
            name += r.choice(names).capitalize()
        texts["name"].append(f"call {name}{r.randint(0, 99)}()")
    for _ in range(30):
        texts["other"] += [f"t {pick(40, string.ascii_lowercase + string.digits)} .", f"{r.randbytes(16).hex()}/{pick(43, secrets.BASE64)} .", f"B {pick(32, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')} .", str(uuid.UUID(bytes=r.randbytes(16))).upper()]
    return texts


def test_random_spans_equal_brute_force(spark):
    groups = mixed()
    texts = [t for g in groups.values() for t in g] + corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(x.doc_id, s["s"], s["e"]) for x in secrets.scan(df).collect() for s in x["all"] if s["k"] == 3}
    assert got == slow_random(texts)
    docs, at, first = {i for i, _, _ in got}, {}, 0
    for k, g in groups.items():
        at[k] = len(docs & set(range(first, first + len(g)))) / len(g)
        first += len(g)
    assert at["key"] >= 0.95 and at["path"] <= 0.01 and at["name"] <= 0.01, at
    assert at["other"] >= 0.7, at


def test_structure_alone_is_left_alone(spark):
    """With no key among them, paths and identifiers stay unreported, however many."""
    groups = mixed(8)
    df = spark.createDataFrame(list(enumerate(groups["path"] + groups["name"])), "doc_id long, text string")
    assert sum("random" in x.spans for x in secrets.scan(df).collect()) <= 3


def test_very_long_text(spark):
    key = base64.b64encode(random.Random(9).randbytes(36)).decode()
    text = ("é password = " + "abcdefghijkl" + " word") * 20_000 + " " + key
    x = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert x.n_assign == 20_000 and x["all"][-1]["k"] == 3 and x["all"][-1]["e"] == len(text)


def test_redaction(spark):
    texts = [t or "" for t in corpus()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = secrets.scan(df, carry=True).select("row.*", "all").withColumn("clean", secrets.redacted(F.col("text"), F.col("all"), "#"))
    for x in out.collect():
        want, at = "", 0
        for s in sorted(tuple(y) for y in x["all"]):
            if s[0] >= at:
                want += x.text[at : s[0]] + "#"
            at = max(at, s[2])
        assert x.clean == want + x.text[at:]
