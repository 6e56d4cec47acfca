"""Language identification: multinomial naive Bayes over hashed character n-grams.

The texts of an Arrow batch become one sparse matrix (compressed rows: buckets and
counts), and one product with the broadcast log-probability matrix scores them all.
Languages come in blocks of bounded width, so that any number of them can be learned:
each block is one broadcast matrix, and the posterior is joined over the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.llm.common import slices

BUCKETS, ORDERS, BLOCK_LANGS = 1 << 15, (1, 2, 3), 256
UNKNOWN = "und"
#: A model of one nameless language, for tables without labels: any text with a letter is in it.
ANY = [(["mul"], np.zeros((BUCKETS, 1)), np.zeros(1))]
Model = list[tuple[list[str], np.ndarray, np.ndarray]]
#: Characters that are hashed at once, that a matrix of several texts has at most, and of texts kept gram by gram.
_SLICE, _CHUNK, _SHORT = 1 << 20, 1 << 18, 1 << 12
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def _grams(c: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of each n consecutive code points."""
    shift = np.uint32(32 - buckets.bit_length() + 1)
    k = max(len(c) - n + 1, 0)
    h = np.full(k, n, dtype=np.uint32) * _MIX[4]
    for i in range(n):
        h = (h ^ c[i : i + k]) * _MIX[i % 4]
        h ^= h >> np.uint32(15)
    return (h * _MIX[0]) >> shift


def sparse(texts: list[str], buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-grams of each whole lower-cased text as compressed rows: (ends of
    the rows, buckets, counts). A bucket may have several entries in a row; texts longer
    than ``_SHORT`` have one each."""
    wide, cols, data = max(orders), [], []
    for text in texts:
        text = text.lower()
        if len(text) <= _SHORT:
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            cols.append(np.concatenate([_grams(c, n, buckets) for n in orders]))
            data.append(np.ones(len(cols[-1])))
            continue
        sums = np.zeros(buckets, dtype=np.int64)
        for at in range(0, len(text), _SLICE):
            c = np.frombuffer(text[at : at + _SLICE + wide - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            own = min(_SLICE, len(text) - at)  # grams that start in this slice
            for n in orders:
                sums += np.bincount(_grams(c[: own + n - 1], n, buckets), minlength=buckets)
        cols.append(np.flatnonzero(sums).astype(np.uint32))
        data.append(sums[cols[-1]].astype(np.float64))
    ends = np.cumsum([len(x) for x in cols], dtype=np.int64)
    return ends, np.concatenate(cols), np.concatenate(data)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Rows first..last of together at most ``_CHUNK`` characters, or one longer row."""
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > _CHUNK:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """crc32 of the id as text, modulo folds; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS, block: int = BLOCK_LANGS, alpha: float = 0.5) -> Model:
    """The model of all rows with a language and a text: blocks of at most ``block``
    languages by name, each with log probabilities (buckets x languages) and log priors.

    Each task adds up its own counts and hands them on whenever it holds a block's worth,
    so its memory has a bound whatever the number of languages; the sums are grouped by
    language and bucket. The driver holds the model, ``buckets`` numbers a language."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for lang, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for b in slices(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                x = sums.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                for first, last in _chunks(own):
                    _, cols, data = sparse(own[first:last], buckets)
                    x[:buckets] += np.bincount(cols, data, buckets).astype(np.int64)
                x[buckets] += len(own)
                if len(sums) >= block:
                    yield from out()
        yield from out()

    src = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    total = src.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = total.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).selectExpr("lang", "x.bucket as bucket", "x.n as n")
    model: Model = []
    names, tables = [], []
    docs_of: list[float] = []

    def close() -> None:
        if names:
            order = sorted(range(len(names)), key=names.__getitem__)
            model.append(([names[i] for i in order], np.stack([tables[i] for i in order], axis=1), np.array([docs_of[i] for i in order])))
            names.clear()
            tables.clear()
            docs_of.clear()

    for r in rows.orderBy("lang").toLocalIterator():
        x = np.zeros(buckets + 1)
        x[np.array(r["bucket"], dtype=np.int64)] = r["n"]
        names.append(r["lang"])
        tables.append(np.log((x[:buckets] + alpha) / (x[:buckets].sum() + alpha * buckets)))
        docs_of.append(x[buckets])
        if len(names) == block:
            close()
    close()
    every = sum(n.sum() for _, _, n in model)
    return [(langs, likely, np.log(n / every)) for langs, likely, n in model]


def scores(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, the first by name in a tie, and its posterior:
    a sparse matrix of the texts times the log probabilities, block by block."""
    ends, cols, data = sparse(texts, len(model[0][1]))
    starts = np.concatenate(([0], ends[:-1]))
    full = np.flatnonzero(ends > starts)
    best, name, total = np.full(len(texts), -np.inf), [""] * len(texts), np.zeros(len(texts))
    for langs, likely, prior in model:
        s = np.zeros((len(texts), len(langs)))
        if len(full):
            for k in range(len(langs)):  # column by column: no products of entries and languages are held
                s[full, k] = np.add.reduceat(data * likely[cols, k], starts[full])
        s += prior
        at = s.argmax(axis=1)
        top = s[np.arange(len(texts)), at]
        new = np.maximum(best, top)
        total = total * np.exp(best - new) + np.exp(s - new[:, None]).sum(axis=1)
        for k in np.flatnonzero(top > best):
            name[k] = langs[at[k]]
        best = new
    return name, 1 / total


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the prediction and its score to all columns of docs, under ``names``; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *StructType().add(names[0], "string").add(names[1], "double").fields])

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            known = [k for k, t in enumerate(texts) if shared.value and t is not None and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            own = [texts[k] for k in known]
            for first, last in _chunks(own):
                found, score[known[first:last]] = scores(own[first:last], shared.value)
                for k, x in zip(known[first:last], found, strict=True):
                    lang[k] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the labelled rows that are not held out and predicts all rows.

    Returns doc_id, held_out, lang_pred, score (0 to 1, the posterior). One row per
    input row, repeated rows included. ``und`` with score 0 if the text is null, has no
    letter, or nothing could be learned. Ties go to the first language by name. A null
    id is not held out; rows with a null language are predicted but not learned from;
    other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    model = fit(src.where(~F.col("held_out")))
    return predict(src.select("doc_id", "held_out", "text"), model).drop("text")
