"""The stages against brute force, each on its own input, and the whole."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontam import brute as brute_hits
from test_secrets import base as base_spans
from test_simhash import least_reachable, slow_fingerprint

from spindrift.llm.tokenizing import encoder, vocabulary

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90_000, None, "en", "s", 0), (90_001, "12 34", "en", "s", 5), (90_002, "key abcdef0123456789 é token = abcdefghijklmnop", None, None, None)], docs.schema)
    docs = docs.unionByName(more)
    cols, steps = docs.columns, dict(pipeline.STAGES)
    spoken = steps["language ID"](spark, docs, SF)
    kept = rows(spoken)
    assert spoken.columns == cols
    assert set(rows(docs)) - set(kept) == {90_000, 90_001}
    single = steps["SimHash near-dedup"](spark, spoken, SF)
    fps = {i: slow_fingerprint(r.text) for i, r in kept.items()}
    least = least_reachable(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert single.columns == cols
    assert set(rows(single)) == {i for i in least if least[i] == i} < set(kept)
    clean = steps["benchmark decontamination"](spark, single, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {x[0] for x in brute_hits([(i, r.text) for i, r in rows(single).items()], items, 10) if x[5]}
    assert clean.columns == cols
    assert hit and set(rows(clean)) == set(rows(single)) - hit
    safe = steps["secret scans"](spark, clean, SF)
    assert safe.columns == cols
    before, after = rows(clean), rows(safe)
    assert set(before) == set(after)
    for i, r in after.items():
        spans = base_spans(before[i].text)
        assert not base_spans(r.text)
        if spans:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
    assert after[90_002].text == "key [SECRET] é [SECRET]"
    assert sum(before[i].text == after[i].text for i in before) > 0.8 * len(before)
    packed = steps["best-fit packing"](spark, safe, SF).collect()
    ids = encoder(vocabulary()).ids
    assert sum(r.length for r in packed) == sum(len(np.frombuffer(ids(r.text), "<u4")) + 1 for r in after.values())
    assert {r.doc_id for r in packed} == set(after)


def test_run_applies_all(spark):
    got = pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns)
    assert 0 < got.select("doc_id").distinct().count() < 200


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_stages_decide_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 12)
    a, b, c = ("river stone %s walks under seven old bridges" % w for w in ("amber", "cobalt", "violet"))
    data = [(None, leak, 1), (None, a, 2), (None, b, 3), (5, leak, 4), (5, c, 5), (6, a, 6)]
    df = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in data], docs.schema)
    clean = dict(pipeline.STAGES)["benchmark decontamination"](spark, df, SF)
    assert clean.columns == docs.columns
    assert sorted(r.n_chars for r in clean.collect()) == [2, 3, 5, 6]
    # texts a, b and c are groups of their own: id 5 has c twice and b, id 3 has b, and null has c
    data = [(5, c, 1), (5, c, 1), (5, b, 2), (3, b, 3), (3, a, 4), (7, a, 5), (None, c, 6)]
    df = spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in data], docs.schema).repartition(3)
    single = dict(pipeline.STAGES)["SimHash near-dedup"](spark, df, SF)
    assert single.columns == docs.columns
    assert sorted(r.n_chars for r in single.collect()) == [1, 3, 4, 6]


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_without_a_model(spark, lang):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)  # all labelled rows held out
    data = [(held, "ein Fuchs", lang, "s", 1), (held, "12 34", lang, "s", 2), (held, None, lang, "s", 3), (None, "é", None, "s", 4)]
    got = dict(pipeline.STAGES)["language ID"](spark, spark.createDataFrame(data, docs.schema), SF)
    assert sorted(r.n_chars for r in got.collect()) == [1, 4]


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside may be names of columns, and repeated rows are judged alike."""
    extra = ["lang_pred", "score", "kept", "kept_id", "text_key", "hit", "spans", "fp", "row", "uid", "group", "Score_"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id < 9"))
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(i))
    plain = docs.drop(*extra)
    cols = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        got, want = stage(spark, docs, SF), stage(spark, plain, SF)
        assert got.columns == cols, name
        assert sorted(map(str, got.drop(*extra).collect())) == sorted(map(str, want.collect())), name
        assert all(r[x] == i for r in got.select(*extra).distinct().collect() for i, x in enumerate(extra)), name
    packed = dict(pipeline.STAGES)["best-fit packing"]
    rows = lambda d: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed(spark, d, SF).collect())
    assert rows(docs) == rows(plain)


def test_stages_take_long_texts(spark):
    """A text of two million characters, between two short ones, through all stages."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long_ = " ".join(f"word{i % 5003} of{i % 71}" for i in range(150_000))
    docs = spark.createDataFrame([(1, "a short text here", "en", "s", 17), (2, long_, "en", "s", len(long_)), (3, None, None, None, None), (4, "", "en", "s", 0)], schema)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert {r.doc_id for r in docs.collect()} == {1, 2}
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {1, 2} and max(r.piece for r in packed) > 50


def test_near_dedup_moves_few_texts(spark):
    """Only texts with copies are shuffled; ids that share a bit with one of theirs still stay."""
    r = random.Random(5)
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    texts = [" ".join("%016x" % r.getrandbits(64) for _ in range(1200)) for _ in range(300)]
    data = [*enumerate(texts), *((1000 + i, texts[i]) for i in range(9)), (7, texts[7]), (8, texts[50]), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(data)], schema).repartition(3).cache()
    docs.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.range(8, numPartitions=2).repartition(3).count()
    before = _stages(store)
    got = dict(pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).select("doc_id", "text", "n_chars").collect()
    # text 50 is kept as document 8, the smallest id of its group, and not as 50
    want = [(i, t) for i, t in enumerate(texts) if i != 50] + [(8, texts[50]), (None, texts[3])]
    assert sorted(((x.doc_id or -1, x.text) for x in got)) == sorted((i or -1, t) for i, t in want)
    moved = sum(v for k, v in _stages(store).items() if k not in before)
    assert moved < 0.3 * sum(len(t) for _, t in data)
    docs.unpersist()


def _stages(store):
    """Bytes that each stage so far has shuffled."""
    out, k, gap = {}, 0, 0
    while gap < 50:
        try:
            out[k], gap = store.lastStageAttempt(k).shuffleWriteBytes(), 0
        except Exception:
            gap += 1
        k += 1
    return out
