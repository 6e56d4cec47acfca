"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides keep the smallest hash of ``gram`` words in each window of ``length``
words, so any shared window shares a kept hash. Fingerprints join on the hash; a
join pair is extended word by word on both sides and counts if the run reaches
``length`` words. An item shorter than that is one window; its fingerprint is the
hash of all its words, which is looked up at every place of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.llm.words import gram_hashes, let, upto, words

#: Up to so many distinct benchmark fingerprints become a set in the scan. With more,
#: hashes alone are joined first, and only places that are left get their words.
SET_LIMIT = 50_000
_PLACES = "array<struct<p:int,dh:bigint,dk:int,dshort:boolean>>"


def _kept(h: Column, i: Column, w: int) -> Column:
    """Whether position i (from 1) holds the smallest of some w consecutive hashes."""
    starts = upto(F.greatest(F.lit(1), i - (w - 1)), F.least(i, F.size(h) - (w - 1)))
    return F.exists(starts, lambda s: F.element_at(h, i) <= F.array_min(F.slice(h, s, w)))


def _around(ws: Column, i: Column, k: Column, side: Column) -> list[Column]:
    """Words i..i+k-1 (from 1), up to ``side`` words before, nearest first, and after."""
    before = F.least(i - 1, side)
    left = F.when(before > 0, F.reverse(F.slice(ws, i - before, before))).otherwise(F.array().cast("array<string>"))
    return [F.slice(ws, i, k).alias("mid"), left.alias("left"), F.slice(ws, i + k, side).alias("right")]


def _same(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(equal, lambda e: F.when(F.array_contains(e, False), F.array_position(e, False) - 1).otherwise(F.size(e)).cast("int"))


def benchmark_fingerprints(items: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """(h, k, short, item_id, mid, left, right): the kept hashes of all items with the words
    around them; short is an item of fewer than ``length`` words, which is one window."""
    src = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("ws"))
    src = src.where(F.size("ws") > 0)
    side = length - gram
    hashes = gram_hashes(F.col("ws"), gram)
    long_ = let(hashes, lambda h: F.transform(F.filter(upto(F.lit(1), F.size(h)), lambda i: _kept(h, i, side + 1)), lambda i: F.struct(F.element_at(h, i).alias("h"), F.lit(gram).alias("k"), F.lit(False).alias("short"), *_around(F.col("ws"), i, F.lit(gram), F.lit(side)))))
    none = F.array().cast("array<string>")
    short = F.array(F.struct(F.xxhash64("ws").alias("h"), F.size("ws").alias("k"), F.lit(True).alias("short"), F.col("ws").alias("mid"), none.alias("left"), none.alias("right")))
    rows = src.select("item_id", F.inline(F.when(F.size("ws") >= length, long_).otherwise(short)))
    return rows.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", length: int = 10, gram: int = 5, set_limit: int = SET_LIMIT) -> DataFrame:
    """Marks the words of each document that lie in any occurrence of a window of
    ``length`` consecutive words of an item (of all words of a shorter item).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (ids
    as sorted strings), hits (array of first and last word, from 0), one row per
    input row, repeated rows each on their own. Null texts have no words; items
    without words match nothing; an item whose id is null marks words but is not
    listed; items that share an id count once; an empty benchmark marks nothing.
    Extra columns of either table are ignored.
    """
    assert 0 < gram <= length
    marks = benchmark_fingerprints(items, item_id_col, item_text_col, length, gram)
    side = length - gram
    kinds = sorted({(r.k, r.short) for r in marks.select("k", "short").distinct().collect()})  # at most ``length`` and one
    found = marks.select("k", "short", "h").distinct()
    known: dict[tuple[int, bool], list[int]] | None = {x: [] for x in kinds}
    rows = found.limit(set_limit + 1).collect()
    for r in rows:
        known[r.k, r.short].append(r.h)
    if len(rows) > set_limit:
        known = None

    def places(ws: Column) -> Column:
        """Where a fingerprint of the benchmark may stand, those in the set if there is one."""

        def of(k: int, short: bool):
            def at(h: Column) -> Column:
                on = upto(F.lit(1), F.size(h))
                if known is not None:
                    on = F.filter(on, lambda i: F.element_at(h, i).isin(known[k, short]))
                if not short:
                    on = F.filter(on, lambda i: _kept(h, i, side + 1))
                return F.transform(on, lambda i: F.struct((i - 1).alias("p"), F.element_at(h, i).alias("dh"), F.lit(k).alias("dk"), F.lit(short).alias("dshort")))

            return at

        parts = [let(gram_hashes(ws, k), of(k, short)).cast(_PLACES) for k, short in kinds]
        return F.concat(*parts) if parts else F.array().cast(_PLACES)

    def with_words(ws: Column, at: Column) -> Column:
        return F.transform(at, lambda x: F.struct(x["p"].alias("p"), x["dh"].alias("dh"), x["dk"].alias("dk"), x["dshort"].alias("dshort"), *[c.alias(f"d{n}") for c, n in zip(_around(ws, x["p"] + 1, x["dk"], F.when(x["dshort"], 0).otherwise(side)), ("mid", "left", "right"), strict=True)]))

    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_words = lambda ws: F.size(ws).cast("long").alias("n_words")
    if known is None:
        src = written(src, "documents")
        at = src.select("uid", F.inline(let(words(F.col("text")), places)))
        at = at.join(found, (F.col("dh") == F.col("h")) & (F.col("dk") == F.col("k")) & (F.col("dshort") == F.col("short")), "left_semi")
        at = at.groupBy("uid").agg(F.collect_list(F.struct("p", "dh", "dk", "dshort")).alias("at"))
        src = src.join(at, "uid", "left").withColumn("at", F.coalesce("at", F.array().cast(_PLACES)))
        own = let(words(F.col("text")), lambda ws: F.struct(n_words(ws), with_words(ws, F.col("at")).alias("c")))
    else:
        own = let(words(F.col("text")), lambda ws: F.struct(n_words(ws), let(places(ws), lambda at: with_words(ws, at)).alias("c")))
    rows = src.select("uid", "doc_id", own.alias("x")).select("uid", "doc_id", F.col("x.n_words").alias("n_words"), F.explode_outer("x.c").alias("c")).select("uid", "doc_id", "n_words", "c.*")
    both = rows.join(marks, (F.col("dh") == F.col("h")) & (F.col("dk") == F.col("k")) & (F.col("dshort") == F.col("short")) & (F.col("dmid") == F.col("mid")), "left")
    both = both.withColumn("l", F.when(F.col("h").isNotNull(), _same(F.col("left"), F.col("dleft")))).withColumn("r", F.when(F.col("h").isNotNull(), _same(F.col("right"), F.col("dright"))))
    whole = F.col("short") | (F.col("l") + F.col("k") + F.col("r") >= length)
    hit = F.struct((F.col("p") - F.col("l")).alias("first"), (F.col("p") + F.col("k") + F.col("r") - 1).alias("last"))
    out = both.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(whole, hit))).alias("hits"),
        F.array_sort(F.collect_set(F.when(whole, F.col("item_id")))).alias("items"),
    )
    # spans in order of their first word: each adds what lies beyond the furthest last word so far
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    covered = F.aggregate("hits", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"] - 1))).alias("n"), F.greatest(a["end"], x["last"]).alias("end")), lambda a: a["n"])
    out = out.withColumn("n_hit", covered.cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "hits")
