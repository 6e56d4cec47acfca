"""Secret scan, in DataFrame operations only.

Base matches come from patterns. Further candidates are what base matches leave of
long runs over the letters of base64. Each gets the alphabet its characters suggest
(hex, base32, one case with digits, base64) and a battery of tests of the hypothesis
that it is random in that alphabet: chi-squared uniformity over all its letters, runs
of upper case, lower case, digits and signs, and serial correlation. What the battery
rejects is structure. What it keeps may only be too short to reject, so it is tested
against structure too: a p-value that words, paths or identifiers, with the letter
frequencies of prose and runs that seldom change kind, look so random. A
false-discovery control (Benjamini-Hochberg) of these p-values within each alphabet
and length class, since power depends on length, decides which are reported as random;
so at most about a share ``q`` of what is reported is structure. It needs only counts
of p-values in fixed steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.llm.words import let

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # as [0-9a-f]+ of 16 and more: a run is matched whole or not at all
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"  # LEAST and more
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST = 24
#: Frequency of a to z in English prose, in percent.
PROSE = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
#: How often neighbours differ in kind, by alphabet, in structure at most. Share of
#: structure's letters that are as frequent as any other (names, abbreviations).
CHANGES, EVEN = {32: 0.25, 36: 0.25, 64: 0.4}, 0.15
_BLOCK, _STEPS = 256, 120
_SPANS = "array<struct<s:int,k:int,e:int>>"
_CANDS = "array<struct<s:int,e:int,size:int,len:int,step:int>>"


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e, v>> of the leftmost matches whose group has at least ``least``
    characters, in code points. The texts between matches give their places; these are
    summed in blocks, so that very many matches don't cost their square."""
    m, v = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))

    def of(x: Column) -> Column:
        each = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["m"])), x["m"], lambda g, t: F.struct(F.length(g).alias("gap"), F.length(t).alias("len")))
        n = F.size(x["m"])

        def blocked(each: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(each, b * _BLOCK + 1, F.lit(_BLOCK)))

            def starts(blocks: Column) -> Column:
                sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, y: a + y["gap"] + y["len"]))
                offsets = F.aggregate(sums, F.array(F.lit(0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
                run = lambda b, o: F.aggregate(b, F.struct(o.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, y: F.struct((a["at"] + y["gap"] + y["len"]).alias("at"), F.concat(a["out"], F.array(a["at"] + y["gap"])).alias("out")), lambda a: a["out"])
                return F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), run))

            return let(blocks, starts)

        s = let(each, blocked)
        whole = F.zip_with(F.arrays_zip(s.alias("s"), x["m"].alias("m")), x["v"], lambda a, t: F.struct(a["s"].alias("s"), (a["s"] + F.length(a["m"])).alias("e"), t.alias("v")))
        return F.filter(whole, lambda y: F.length(y["v"]) >= least)

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    found = let(F.struct(m.alias("m"), v.alias("v"), F.split(text, pattern, -1).alias("gaps")), of)
    return F.when(text.rlike(pattern), found).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to about 1e-4 (logistic approximation)."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z))))


def _core(v: Column) -> Column:
    """The candidate without what only separates groups of letters."""
    return F.regexp_replace(v, "[-_/+]", "")


def _alphabet(v: Column) -> Column:
    """Size of the alphabet that the characters suggest; null if none. Alphabets of one
    case leave signs out."""
    core = _core(v)
    digit, lower, upper = (core.rlike(x) for x in ("[0-9]", "[a-z]", "[A-Z]"))
    one = F.when(core.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(core.rlike("^[A-Z2-7]+$"), 32).otherwise(36)
    return F.when(digit & lower & upper, 64).when(digit & (lower | upper), one)


def _letters(v: Column, size: Column) -> tuple[Column, Column]:
    """The candidate's letters as one string of the alphabet's, and that alphabet."""
    text = F.when(size == 64, F.translate(v, "-_", "+/")).when(size == 32, _core(v)).otherwise(F.lower(_core(v)))
    return text, F.when(size == 16, F.lit("0123456789abcdef")).when(size == 32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).when(size == 36, F.lit("abcdefghijklmnopqrstuvwxyz0123456789")).otherwise(F.lit(BASE64))


def _kind(c: Column) -> Column:
    return F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def _change(size: int) -> float:
    """How often neighbours differ in kind in a random string."""
    parts = {16: (6, 10), 32: (26, 6), 36: (26, 10), 64: (26, 26, 10, 2)}[size]
    return 1 - sum((p / size) ** 2 for p in parts)


def _by_size(size: Column, of: Callable[[int], float]) -> Column:
    return F.when(size == 16, of(16)).when(size == 32, of(32)).when(size == 36, of(36)).otherwise(of(64))


def p_value(v: Column, size: Column) -> Column:
    """The smallest of three p-values, times three, that v is random over its alphabet."""
    text, letters = _letters(v, size)
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def of(x: Column) -> Column:
        n = F.size(x).cast("double")
        counts = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.size(F.filter(x, lambda y: y["at"] == k)).cast("double"))
        # Pearson's sum over all letters, by its exact mean and variance
        chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * size / n - n
        z = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        p_chi = _upper_tail(z)
        turns = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        changes = F.size(F.filter(turns, lambda t: t["a"]["kind"] != t["b"]["kind"]))
        often = _by_size(size, _change)
        p_runs = 2 * _upper_tail(F.abs(changes - (n - 1) * often) / F.sqrt((n - 1) * often * (1 - often)))
        mu = F.aggregate(x, F.lit(0.0), lambda s, c: s + c["at"]) / n
        sq = F.aggregate(x, F.lit(0.0), lambda s, c: s + (c["at"] - mu) * (c["at"] - mu))
        co = F.aggregate(turns, F.lit(0.0), lambda s, t: s + (t["a"]["at"] - mu) * (t["b"]["at"] - mu))
        p_corr = F.when(sq > 0, 2 * _upper_tail(F.abs(co / F.greatest(sq, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_corr))

    return let(F.transform(chars, lambda c: F.struct((F.position(c, letters) - 1).alias("at"), _kind(c).alias("kind"))), of)


def p_structure(v: Column, size: Column) -> Column:
    """A bound of the probability that structured text looks as random as v does.

    Letters of structure follow prose, its neighbours change kind in at most CHANGES of
    all places; the log-likelihood of a random string over that of structure is held
    against its mean and variance under structure, by the normal tail's exponential
    bound. In hex it is the chance that no letter lies past f."""
    even = [(1 - EVEN) * x / sum(PROSE) + EVEN / 26 for x in PROSE]
    weight = [math.log(1 / 26 / x) for x in even]
    mean = sum(p * w for p, w in zip(even, weight, strict=True))
    var = sum(p * w * w for p, w in zip(even, weight, strict=True)) - mean * mean
    abc = F.lit("abcdefghijklmnopqrstuvwxyz")
    text = _letters(v, size)[0]
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    gain, loss = (lambda k: math.log(_change(k) / CHANGES[k])), (lambda k: math.log((1 - _change(k)) / (1 - CHANGES[k])))
    rate = _by_size(size, lambda k: CHANGES.get(k, 0.25))
    a, b = (_by_size(size, lambda k, f=f: f(k) if k in CHANGES else 0.0) for f in (gain, loss))

    def of(x: Column) -> Column:
        letters = F.filter(F.transform(x, lambda c: F.position(F.lower(c), abc)), lambda i: i > 0)
        table = F.array(*map(F.lit, weight))

        def scored(y: Column) -> Column:
            n, turns = F.size(y).cast("double"), F.size(x).cast("double") - 1
            changes = F.size(F.filter(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda c, d: _kind(c) != _kind(d)), lambda t: t)).cast("double")
            total = F.aggregate(y, F.lit(0.0), lambda s, i: s + F.element_at(table, i)) + changes * a + (turns - changes) * b
            spread = n * var + turns * rate * (1 - rate) * (a - b) * (a - b)
            z = (total - n * mean - turns * (rate * a + (1 - rate) * b)) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
            tail = 0.5 * F.exp(-F.least(z * z, F.lit(1400.0)) / 2)
            return F.when(size == 16, F.exp(n * math.log(sum(even[:6])))).otherwise(F.when(z > 0, tail).otherwise(1 - tail))

        return let(letters, scored)

    return let(chars, of)


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _pieces(x: Column, base: Column, least: int) -> Column:
    """What the base spans leave of candidate x, in pieces of ``least`` and more characters."""
    over = F.filter(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(x["s"].alias("at"), none.alias("out"))

    def cut(a: Column, b: Column) -> Column:
        free = F.struct(a["at"].alias("s"), b["s"].alias("e"))
        return F.struct(F.greatest(a["at"], b["e"]).alias("at"), F.when(b["s"] - a["at"] >= least, F.concat(a["out"], F.array(free))).otherwise(a["out"]).alias("out"))

    def last(a: Column) -> Column:
        return F.when(x["e"] - a["at"] >= least, F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), x["e"].alias("e"))))).otherwise(a["out"])

    cuts = F.aggregate(over, start, cut, last)
    return F.transform(cuts, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.substring(x["v"], c["s"] - x["s"] + 1, c["e"] - c["s"]).alias("v")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05, alpha: float = 0.01, carry: bool = False) -> DataFrame:
    """Finds secrets in whole texts.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of kind:start:end, by
    start, then kind, comma-joined; code points, end exclusive), spans (the same text
    with the method's spans, of kind random, which overlap no base span), all
    (array of the spans) and, with ``carry``, row (the input row). One row per input
    row, repeated rows each on their own. Null and empty texts have no spans; a null
    id is kept; other columns don't matter. A candidate whose battery p-value is under
    ``alpha`` is structure; ``q`` is the share of structure among what is reported. A
    candidate without a digit, or without a letter, is not tested and not reported.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [(ASSIGN, 2, 12), (ACCESS, 0, 18), (HEX, 0, 16)]
    base = F.concat(*(_of_kind(matches(text, p, g, n), k) for k, (p, g, n) in enumerate(kinds)))
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), *([F.struct("*").alias("row")] if carry else []), F.array_sort(base).alias("base"), matches(text, CANDIDATE, 0, LEAST).alias("more"))

    def tested(base: Column, more: Column) -> Column:
        free = F.flatten(F.transform(more, lambda x: _pieces(x, base, LEAST)))
        sized = F.filter(F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), _alphabet(x["v"]).alias("size"))), lambda x: x["size"].isNotNull())
        step = lambda p: F.least(F.lit(_STEPS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-13))))).cast("int")
        p = lambda x: F.when(p_value(x["v"], x["size"]) < alpha, F.lit(1.0)).otherwise(p_structure(x["v"], x["size"]))
        return F.transform(sized, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["size"].alias("size"), F.floor(F.log2((x["e"] - x["s"]).cast("double"))).cast("int").alias("len"), step(p(x)).alias("step")))

    src = written(src.select("*", F.when(F.size("more") > 0, tested(F.col("base"), F.col("more"))).otherwise(F.array().cast(_CANDS)).alias("cand")).drop("more"), "secrets")
    # false-discovery control: the first step from which q times the share of p-values covers the step's bound
    counts = src.select(F.inline("cand")).groupBy("size", "len", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("size", "len")
    tail = counts.withColumn("below", F.sum("n").over(w.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", F.sum("n").over(w))
    cut = tail.where(F.col("m") * F.pow(F.lit(10.0), -F.col("step") / 10) <= q * F.col("below")).groupBy("size", "len").agg(F.min("step").alias("cut"))
    cuts = {(r["size"], r["len"]): r["cut"] for r in cut.collect()}  # at most one for each alphabet and power of two

    def discovered(x: Column) -> Column:
        found = F.lit(False)
        for (size, n), step in cuts.items():
            found = found | ((x["size"] == size) & (x["len"] == n) & (x["step"] >= step))
        return found

    random = F.filter("cand", discovered)
    random = _of_kind(random, 3)
    label = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(label, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    out = src.withColumn("all", F.array_sort(F.concat("base", random)).cast(_SPANS))
    n = [F.size(F.array_remove(F.col("base.k"), k)).cast("long") for k in range(3)]
    n = [(F.size("base") - n[k]).alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *n, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("all")).alias("spans"), "all", *(["row"] if carry else []))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], more).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
