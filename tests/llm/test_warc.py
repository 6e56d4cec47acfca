import base64
import hashlib
import io
import random
import re
import zlib

import pytest

from spindrift.llm import warc
from spindrift.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload binary, digest string"


def pages():
    r = random.Random(1)
    rows = [(i, f"http://a/{i}\n é", r.choice(["", "same", "é" * 9, "x" * 100_000, f"own {i}\r\n\r\nWARC/1.1\r\n"]), None, "c") for i in range(60)]
    return [*rows, (100, None, None, None, "c"), (None, "u", "same", None, "c"), (None, "u", "only null", None, "c"), (7, "u", rows[7][2], None, "c")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    data = pages()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in warc.archive(df, min_bytes=least).collect()), key=str)
    top = {}
    for i, _, h, *_ in data:
        h = h or ""
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h, *_ in data:
        b = (h or "").encode()
        first = top[h or ""] if top[h or ""] >= 0 and len(b) >= least else i
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want.append((i, len(b), sha, "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want, key=str)
    assert warc.archive(df.limit(0)).collect() == []


def test_records_read_back(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    folder = new_path(spark, "warc")
    files = warc.write_archives(df, folder, roll=2000)
    assert files.count() > 5
    rows = warc.read_archives(spark, files, folder).collect()
    assert {x.kind for x in rows} == {"record"}
    by = {x.page_id: x for x in rows}
    for i, _, h, *_ in pages():
        if i is not None and by[i].warc_type == "response":
            assert bytes(by[i].payload).decode() == (h or "")
    assert by[3].uri == "http://a/3%0A%20é"


def members(compress):
    out = []
    for i in range(8):
        data = warc.record("response", i, f"u{i}", b"payload %d " % i * 50)
        if compress:
            z = zlib.compressobj(4, zlib.DEFLATED, 31)
            data = z.compress(data) + z.flush()
        out.append(data)
    return out


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def ids(found):
    return [warc.number(x.head.get("x-page-id")) for x in found if x.kind == "record"]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = members(compress)
    assert ids(read(b"".join(parts))) == list(range(8))
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = b"".join([*parts[:2], bytes(hurt), parts[3], b"junk WARC/1. \x1f\x8b\x08 junk", parts[4], parts[5][:-30], parts[6], parts[7][:-9]])
    found = read(data)
    # of a member cut within gzip's checksum the record is whole, and its digest proves it
    assert ids(found) == ([0, 1, 3, 4, 6, 7] if compress else [0, 1, 3, 4, 6])
    gaps = [(x.offset, x.length) for x in found if x.kind == "gap"]
    assert len(gaps) == 4
    at = 0
    for x in found:
        assert x.offset == at
        at += x.length
    assert at == len(data)


@pytest.mark.parametrize("compress", [True, False])
def test_damage_never_raises_or_loses_whole_records(compress, monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", 64)
    r = random.Random(2)
    parts = members(compress)
    for _ in range(150):
        data = bytearray(b"".join(parts))
        a = r.randrange(len(data))
        b = min(len(data), a + r.randint(1, 40))
        how = r.randrange(3)
        data[a:b] = r.randbytes(b - a) if how == 0 else b"" if how == 1 else r.randbytes(5) + data[a:b]
        found = read(bytes(data))
        assert sum(x.length for x in found) == len(data)
        ends, whole = 0, []
        for i, p in enumerate(parts):
            if ends + len(p) <= a or ends >= b:
                whole.append(i)
            ends += len(p)
        assert set(ids(found)) >= set(whole)
    assert read(b"") == []
    assert [x.kind for x in read(b"\x00" * 500)] == ["gap"]


def test_ids_of_64_bits(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    for n in (low, high, 10**18, 10**18 - 1, -(10**18), 0):
        assert warc.number(str(n)) == n
    for text in (str(high + 1), str(low - 1), "9" * 19, "9" * 20, "", None, "1.0", "x"):
        assert warc.number(text) is None
    rows = [(high, "u", "same"), (10**18, "u", "same"), (low, "u", "own")]
    got = {(x.page_id, x.record_type, x.refers_to) for x in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(high, "response", None), (10**18, "revisit", high), (low, "response", None)}


def packed(data):
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@pytest.mark.parametrize("chunk", [1 << 20, 100, 7])
def test_salvage_within_members(chunk, monkeypatch):
    """One member of many records: a bad one costs itself alone, also where the member is cut."""
    monkeypatch.setattr(warc, "_CHUNK", chunk)
    parts = members(False)
    hurt = bytearray(parts[3])
    hurt[-40] ^= 1
    one = packed(b"".join([*parts[:3], bytes(hurt), *parts[4:6]]))
    data = one + packed(parts[6]) + packed(parts[7])
    found = read(data)
    assert ids(found) == [0, 1, 2, 4, 5, 6, 7]
    assert [(x.offset, x.length, x.reason) for x in found if x.kind == "gap"] == [(0, len(one), "block digest differs")]
    assert sum(x.length for x in found) == len(data)
    whole = packed(b"".join(parts[:6]))
    found = read(whole + packed(parts[6]))
    assert ids(found) == list(range(7)) and all(x.kind == "record" for x in found)
    r = random.Random(4)
    body = [warc.record("response", i, "u", r.randbytes(3000)) for i in range(5)]
    cut = packed(b"".join(body))[:10_000]
    found = read(cut + packed(parts[7]))
    assert ids(found)[:2] == [0, 1] and ids(found)[-1] == 7 and 4 not in ids(found)[:-1]
    assert [x.reason for x in found if x.kind == "gap"]
    bare = [re.sub(rb"WARC-(Block|Payload)-Digest: .*?\r\n", b"", p) for p in parts]
    assert ids(read(packed(b"".join(bare)))) == list(range(8))
    assert ids(read(packed(b"".join(bare))[:-6])) == []  # nothing proves them


def test_gaps_are_errors_of_the_job(spark, monkeypatch):
    df = spark.createDataFrame(pages(), SCHEMA).coalesce(1)
    folder = new_path(spark, "warc")
    files = warc.write_archives(df, folder)
    path = files.first().path
    with open(path, "r+b") as f:
        f.seek(5000)
        f.write(b"\0" * 50)
    rows = warc.read_archives(spark, files, folder)
    gaps = rows.where("kind = 'gap'").collect()
    assert gaps and all(x.file == path and x.length > 0 and x.reason for x in gaps)
    assert rows.where("kind = 'record'").count() > 20
    with pytest.raises(Exception, match="gap in .*warc.*bytes"):
        warc.whole(rows).collect()
