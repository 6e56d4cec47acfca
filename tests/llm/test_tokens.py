import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import packing, simple8b, tokens
from spindrift.llm.tokenizing import Encoder, encoder, vocabulary

BITS = ["The", "don't", "'S", "''s", "!'s", "é", "ß", "À", "²3", "\n", " ", "\t", "\x85", "\xa0", "\x1c", "İ", "Σ", "ς", "é", "中文", "<|endoftext|>", "<|", "|>", " ", "😀", "...", "x1y22", "'LL", "\x00", "_", "\xad", "ª"]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_encoder_equals_the_library():
    enc, slow = Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    assert enc.known
    for t in texts(1, 3000):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)
    other = Encoder(vocabulary().replace("word_bpe_49k", "byte_bpe_50k"))
    assert not other.known
    assert np.frombuffer(other.ids("A b"), "<u4").tolist() == other.tokenizer.encode("A b", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 40000), st.integers(32766, 32769), st.integers(0, 2**32 - 1)), max_size=300))
def test_blocks_round_trip(ids):
    block = simple8b.pack(np.array(ids, dtype=np.uint32))
    assert simple8b.unpack(block).tolist() == ids
    assert len(block) <= 16 + 12 * len(ids)
    if ids:
        with pytest.raises(ValueError, match="whole"):
            simple8b.unpack(block[:-1])


def rows():
    ts = [*texts(2, 150), None, "", "word " * 30000, "a " * 4095, "a " * 4096]
    return [(i * 7 % 1009, t, 1, 2) for i, t in enumerate(ts)] + [(None, "x", 1, 2), (21, ts[3], 1, 2)]


def want_ids(text, end):
    return np.frombuffer(encoder(vocabulary()).ids(text), "<u4").tolist() + [end]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, part int, start long").repartition(3)
    got = sorted((tuple(r) for r in tokens.token_table(df).collect()), key=lambda r: r[1])
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in data)
    assert [r[0] for r in got] == sorted((r[0] for r in data), key=lambda x: -1 if x is None else x)
    by, at = defaultdict(list), 0
    for d, t, *_ in data:
        ids = want_ids(t, 2)
        by[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d, start, n, crc in got:
        assert start == at
        at += n
        by[d].remove((n, crc))
    assert tokens.token_table(df.limit(0)).collect() == []


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, rank int, length long").repartition(3)
    got = packing.pack(df, capacity=capacity).collect()
    want = []
    for d, t, *_ in data:
        ids = want_ids(t, 1)
        want += [(d, k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= max(1.05 * total / capacity + 1, 1)
    assert packing.pack(df.limit(0), capacity=capacity).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=20))
def test_plan_places_all_and_overfills_none(histogram):
    bins, placed = defaultdict(int), defaultdict(int)
    for size, r0, n, s0, each, at in packing.plan(histogram, 30):
        assert r0 == placed[size]
        placed[size] += n
        for k in range(n):
            s = s0 + k // each
            assert bins[s] == at + (k % each) * size
            bins[s] += size
    assert {k: n for k, n in histogram.items() if n} == dict(placed)
    assert all(v <= 30 for v in bins.values())
    items = sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True)
    first_fit = []
    for x in items:
        for i, v in enumerate(first_fit):
            if v + x <= 30:
                first_fit[i] += x
                break
        else:
            first_fit.append(x)
    assert len(bins) <= len(first_fit) * 1.25 + 1


def test_checksums_join():
    r = random.Random(6)
    for _ in range(200):
        a, b = r.randbytes(r.randint(0, 99)), r.randbytes(r.choice([0, 1, 7, 5000]))
        assert tokens.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_blocks_are_bounded(spark, monkeypatch, tmp_path):
    """Documents of many blocks, one of them ending where a block does."""
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    ids = [len(want_ids(t, 2)) for t in ("a " * 1000, "b " * 49, "")]
    df = spark.createDataFrame([(1, "a " * 1000), (2, "b " * 49), (3, None), (3, "c")], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/t"
    tokens.write_tokens(df, path)
    blocks = spark.read.schema(tokens.BLOCKS).parquet(path).collect()
    assert sum(sum(b.counts) for b in blocks) == sum(ids) + 2
    assert all(sum(b.counts) <= 50 for b in blocks) and max(b.carried for b in blocks) >= 900
    rows = {(r.doc_id, r.n_tokens): r for r in tokens.read_tokens(spark, path, with_ids=True).collect()}
    for d, t in ((1, "a " * 1000), (2, "b " * 49), (3, None), (3, "c")):
        want = want_ids(t or "", 2)
        r = rows[d, len(want)]
        assert r.ids == want and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
