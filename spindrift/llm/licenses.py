"""License scan by diagonal voting.

All rolling word k-grams of a document join those of the license templates (pairs for
base phrases, triples for notices); a match votes for the diagonal (place in the
document less place in the template). A base phrase stands where its diagonal has all
its votes. For notices, each diagonal is merged with its neighbours, so that words left
out or put in don't break a match, and every merged span is verified: only votes that
stand in the same order in the document and in the template count, and the share of the
template's k-grams among them is the span's score. Each vote compares the words
themselves, not only hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.llm.words import gram_hashes, let, upto, words

BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Texts of public licenses, clause by clause, as they are usually cited.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]
GRAM = 3
_VOTES = "array<struct<p:int,dh:bigint,mid:array<string>>>"
_SPANS = "array<struct<label:string,first:int,last:int,score:double>>"


def aligned(points: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Of (place in the document, place in the template): the most that ascend in both,
    and the first and last document place of such a chain."""
    tails: list[int] = []  # smallest last template place of a chain of each length
    ends: list[int] = []
    back: list[int] = []
    points = sorted(points, key=lambda x: (x[0], -x[1]))  # one of a document place at most
    for i, (_, q) in enumerate(points):
        at = bisect_left(tails, q)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(q)
            ends.append(i)
        else:
            tails[at], ends[at] = q, i
    last = first = ends[-1]
    while back[first] >= 0:
        first = back[first]
    return len(tails), points[first][0], points[last][0]


def _verify() -> Callable:
    """Adds found, lo and hi to rows of (..., near): the aligned votes around each diagonal."""

    def run(batches):
        for b in batches:
            got = [aligned([(x["diag"] + q, q) for x in near for q in x["qs"]]) for near in b.column(b.num_columns - 1).to_pylist()]
            found, lo, hi = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=[*b.schema.names[:-1], "found", "lo", "hi"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, share: float = 0.8, drift: int = 3) -> DataFrame:
    """Finds license phrases and notices in whole texts.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, from 0; null without any),
    base_labels, labels (with those of notices of which at least ``share`` stands in
    order, at most ``drift`` words put in or left out on either side of a diagonal),
    score (the largest share of any template, 0 without any) and spans (label, first
    and last word, score of the places that gave labels). One row per input row,
    repeated rows each on their own. Null and empty texts have no words; of a phrase
    that stands twice both places count; of equally good neighbouring diagonals the
    first gives the span; a null id is kept; other columns are ignored.
    """
    spark = docs.sparkSession
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows = [(i, label, i < len(base), min(2 if i < len(base) else GRAM, len(t.split())), t.split()) for i, (label, t) in enumerate([*base, *notices])]
    assert all(len(r[4]) > 1 for r in rows), "a template needs two words"
    templates = spark.createDataFrame(rows, "t int, label string, is_base boolean, k int, ws array<string>")
    sizes = sorted({r[3] for r in rows})
    hashes = F.coalesce(*(F.when(F.col("k") == k, gram_hashes(F.col("ws"), k)) for k in sizes))
    grams = templates.select("t", "label", "is_base", "k", (F.size("ws") - F.col("k") + 1).alias("grams"), "ws", F.posexplode(hashes).alias("q", "h"))
    grams = grams.select("t", "label", "is_base", "k", "grams", "q", "h", F.expr("slice(ws, q + 1, k)").alias("tmid"))
    known = {k: [r.h for r in grams.where(F.col("k") == k).select("h").distinct().collect()] for k in sizes}  # a few per template

    def votes(ws: Column) -> Column:
        def of(k: int) -> Callable[[Column], Column]:
            def at(h: Column) -> Column:
                on = F.filter(upto(F.lit(1), F.size(h)), lambda i: F.element_at(h, i).isin(known[k]))
                return F.transform(on, lambda i: F.struct((i - 1).alias("p"), F.element_at(h, i).alias("dh"), F.slice(ws, i, k).alias("mid")))

            return at

        return F.concat(*(let(gram_hashes(ws, k), of(k)).cast(_VOTES) for k in sizes))

    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), let(words(F.col(text_col)), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), votes(ws).alias("c"))).alias("x"))
    src = written(src.select("uid", "doc_id", "x.n_words", "x.c"), "votes")
    vote = src.where(F.size("c") > 0).select("uid", F.inline("c")).join(F.broadcast(grams), (F.col("dh") == F.col("h")) & (F.col("mid") == F.col("tmid")))
    diagonal = vote.groupBy("uid", "t", "label", "is_base", "grams", "k", (F.col("p") - F.col("q")).alias("diag")).agg(F.collect_set("q").alias("qs"))
    w = Window.partitionBy("uid", "t").orderBy("diag")
    near = F.collect_list(F.struct("diag", "qs")).over(w.rangeBetween(-drift, drift))
    place = F.col("is_base") & (F.size("qs") == F.col("grams"))
    merged = diagonal.select("uid", "t", "label", "is_base", "grams", "k", "diag", place.alias("place"), near.alias("near"))
    ddl = "uid long, t int, label string, is_base boolean, grams int, k int, diag int, place boolean, found int, lo int, hi int"
    span = merged.mapInArrow(_verify(), ddl).withColumn("score", F.col("found") / F.col("grams"))
    before, after = F.max("found").over(w.rangeBetween(-drift, -1)), F.max("found").over(w.rangeBetween(1, drift))
    top = (F.col("found") > F.coalesce(before, F.lit(0))) & (F.col("found") >= F.coalesce(after, F.lit(0)))
    named = F.when(F.col("is_base"), F.col("place")).otherwise((F.col("score") >= share) & top)
    span = span.withColumn("named", named)
    found = span.groupBy("uid").agg(
        F.count_if("place").alias("n_base"),
        F.min(F.when(F.col("place"), F.col("diag"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("place"), F.col("diag"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("place"), F.col("label"))).alias("b"),
        F.collect_set(F.when(F.col("named"), F.col("label"))).alias("m"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("label", F.when(F.col("place"), F.col("diag")).otherwise(F.col("lo")).alias("first"), F.when(F.col("place"), F.col("diag") + F.col("grams")).otherwise(F.col("hi") + F.col("k") - 1).alias("last"), "score")))).cast(_SPANS).alias("spans"),
    )
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    none = F.array().cast(_SPANS)
    return src.drop("c").join(found, "uid", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", text("b").alias("base_labels"), text("m").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"))
