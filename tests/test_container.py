import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from spindrift.functions.bits import BitReader, BitWriter, EndOfPacket, ilog
from spindrift.functions.codebook import Codebook, Invalid, Lookup, codewords, lookup1, unpack_float
from spindrift.functions.scalar import lookup1_values
from spindrift.sources import ogg

SIZES = [5, 0, 255, 254, 765, 256, 2, 255 * 255 - 1, 255 * 256, 100_000, 0, 77]


def data_of(sizes):
    return [bytes((31 * i + j) % 256 for j in range(n)) for i, n in enumerate(sizes)]


def test_bits():
    w = BitWriter()
    for v, n in ((12, 4), (-1, 3), (17, 7), (6969, 13)):
        w.write(v, n)
    assert w.bytes() == bytes.fromhex("fc48ce06")
    r = BitReader(w.bytes())
    assert [r.read(n) for n in (4, 3, 7, 13)] == [12, 7, 17, 6969]
    assert r.read(5) == 0
    for n in (1, 0):
        with pytest.raises(EndOfPacket):
            r.read(n)
    r = BitReader(b"\xff")
    assert r.read(6) == 63
    with pytest.raises(EndOfPacket):
        r.read(3)
    assert [ilog(x) for x in (0, 1, 2, 3, 4, 7, -1)] == [0, 1, 2, 2, 3, 3, 0]


def test_huffman():
    show = lambda ls: [f"{c:0{n}b}" if n else None for c, n in zip(codewords(ls), ls, strict=True)]
    assert show([2, 4, 4, 4, 4, 2, 3, 3]) == ["00", "0100", "0101", "0110", "0111", "10", "110", "111"]
    assert show([2, 1, 2]) == ["00", "1", "01"]
    assert show([0, 1, 0, 2, 2]) == [None, "0", None, "10", "11"]
    for bad in ([2, 4, 4, 4, 4, 2, 3], [2, 4, 4, 4, 4, 2, 3, 3, 3], [1, 1, 1], [2]):
        with pytest.raises(Invalid):
            codewords(bad)
    with pytest.raises(EndOfPacket):
        Codebook(1, (0, 0)).decode(BitReader(b"\0"))
    book = Codebook(1, (2, 4, 4, 4, 4, 2, 3, 3))
    w = BitWriter()
    want = [random.Random(1).randrange(8) for _ in range(200)]
    for e in want:
        book.encode(w, e)
    r = BitReader(w.bytes())
    assert [book.decode(r) for _ in want] == want


def test_vectors_and_book_round_trip():
    assert unpack_float(788 << 21 | 1) == 1.0 and unpack_float(1 << 31 | 788 << 21 | 3) == -3.0 and unpack_float(786 << 21 | 1) == 0.25
    assert [lookup1(*x) for x in ((81, 4), (80, 4), (625, 4), (1089, 2), (1, 1), (0, 3))] == [3, 2, 5, 33, 1, 0]
    one = 788 << 21 | 1
    nine = (3,) * 7 + (4, 4)
    b = Codebook(2, nine, Lookup(1, 1 << 31 | one, one, 2, False, (0, 1, 2)))
    assert all(b.vector(e).tolist() == [e % 3 - 1, e // 3 - 1] for e in range(9))
    half, two = 787 << 21 | 1, 789 << 21 | 1
    b = Codebook(2, nine, Lookup(1, half, two, 2, True, (0, 1, 3)))
    assert b.vector(7).tolist() == [2.5, 9.0]
    low = 1 << 31 | 789 << 21 | 1
    b = Codebook(3, (1, 1), Lookup(2, low, half, 3, False, tuple(range(1, 7))))
    assert b.vector(0).tolist() == [-1.5, -1, -0.5] and b.vector(1).tolist() == [0, 0.5, 1]
    b = Codebook(3, (1, 1), Lookup(2, low, half, 3, True, tuple(range(1, 7))))
    assert b.vector(0).tolist() == [-1.5, -2.5, -3]
    for book in (b, Codebook(1, (2, 4, 4, 4, 4, 2, 3, 3)), Codebook(1, (0, 1, 0, 2, 2)), Codebook(2, nine, Lookup(1, half, two, 2, True, (0, 1, 3)))):
        w = BitWriter()
        book.write(w)
        assert Codebook.read(BitReader(w.bytes())) == book


def test_crc_and_lacing():
    assert ogg.crc(b"123456789") == 0x89A1897F and ogg.crc(b"") == 0
    headers = data_of([30, 300, 5])
    assert ogg.xiph_lace(headers)[:4] == bytes([2, 30, 255, 45])
    assert ogg.xiph_split(ogg.xiph_lace(headers)) == headers
    with pytest.raises(ogg.Damaged):
        ogg.xiph_split(b"\2\xff")


@pytest.mark.parametrize("flush", [False, True])
def test_pages_round_trip(flush):
    packets = data_of(SIZES)
    raw = b"".join(p.to_bytes() for p in ogg.write_pages([(d, i * 10, flush) for i, d in enumerate(packets)], 7, 1000))
    found = list(ogg.read_packets(ogg.read_pages(raw, strict=True), strict=True))
    if flush:
        assert found.pop().data == b""
    assert [p.data for p in found] == packets
    assert found[0].bos and all(p.granule in (None, i * 10) for i, p in enumerate(found))


def test_damage():
    pages = [p.to_bytes() for p in ogg.write_pages([(bytes([i]) * 100, i, True) for i in range(4)], 1)]
    hurt = bytearray(pages[1])
    hurt[40] ^= 0xFF
    raw = b"".join([pages[0], bytes(hurt), *pages[2:]])
    counts = {}
    got = [p.data for p in ogg.read_packets(ogg.read_pages(raw, counts=counts)) if p.data]
    assert len(got) == 3 and counts["bad"] == 1
    with pytest.raises(ogg.Damaged):
        list(ogg.read_pages(raw, strict=True))
    r = random.Random(9)
    for _ in range(200):
        x = bytearray(raw)
        a = r.randrange(len(x))
        x[a : a + r.randrange(4)] = r.randbytes(r.randrange(4))
        list(ogg.read_packets(ogg.read_pages(bytes(x))))


def test_lookup_sizes_have_no_bound(spark):
    """The query's SQL searches up to 2099 only; the function goes on."""
    cases = [(n, d) for d in (1, 2, 3, 4) for r in (1, 11, 2099, 2100, 19999) for n in (r**d - 1, r**d, r**d + 1) if n < 1 << 32]
    got = spark.createDataFrame(cases, "n long, d int").select("n", "d", lookup1_values(F.col("n"), F.col("d")).alias("r")).collect()
    assert all(x.r**x.d <= x.n < (x.r + 1) ** x.d for x in got)


def test_frames(spark, tmp_path):
    rows = [("f", 5, k, k * 3, False, d) for k, d in enumerate(data_of(SIZES))] + [("f", 6, 0, 1, False, b"other")]
    df = spark.createDataFrame(rows, "source string, serial long, packet long, granule long, flush boolean, data binary")
    pages = ogg.paginate(df, 1000)
    for serial in (5, 6):
        raw = b"".join(bytes(r.content) for r in pages.where(f"serial = {serial}").orderBy("page").collect())
        (tmp_path / f"{serial}.ogg").write_bytes(raw)
    back = ogg.packets_of(ogg.ogg_pages(spark, str(tmp_path), "FAILFAST"), strict=True).collect()
    assert sorted((r.serial, r.packet, bytes(r.data)) for r in back) == sorted((r[1], r[2], r[5]) for r in rows)


def test_whole_files_are_dealt_once(spark):
    """Files of packets and packets of files equal the plain way by pages, with one exchange or none."""
    rows = [("f", 6 - j, k, k * 3, k == 2, d) for j in range(2) for k, d in enumerate(data_of(SIZES))] + [("e", 5, k, k, False, bytes(k)) for k in range(40)]
    order = "source string, serial long, packet long, granule long, flush boolean, data binary"
    shuffled, sorted_ = (spark.createDataFrame(x, order).coalesce(1) for x in (random.Random(3).sample(rows, len(rows)), sorted(rows)))
    pages = ogg.pages_of(ogg.joined(ogg.paginate(sorted_, 1000).orderBy("serial")), strict=True)
    want = sorted(map(str, ogg.packets_of(pages, strict=True).drop("page").collect()))
    for df, placed in ((shuffled, False), (sorted_, True)):
        found = ogg.packets_in(ogg.files_of(df, 1000, placed), strict=True)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == (not placed)
        assert sorted(map(str, found.drop("page").collect())) == want


def test_damaged_files_give_the_same_packets_without_pages(spark):
    r, files = random.Random(5), []
    for i in range(60):
        turns = [p for pair in zip(*(list(ogg.write_pages([(r.randbytes(r.randrange(700)), k, False) for k in range(12)], n, 500)) for n in (8, 9)), strict=False) for p in pair]
        raw = bytearray(b"".join(p.to_bytes() for p in turns if r.random() < 0.9))
        raw[r.randrange(len(raw))] ^= 1 << r.randrange(8)
        files.append((str(i), raw))
    df = spark.createDataFrame([*files, ("none", None)], "source string, content binary")
    want = ogg.packets_of(ogg.pages_of(df)).collect()
    assert sum(x.lost for x in want) > 9 and sorted(map(str, want)) == sorted(map(str, ogg.packets_in(df).collect()))


def test_a_text_is_dealt_once(spark):
    from spindrift.plans.codec import a3_ogg_round_trip

    df = a3_ogg_round_trip(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan
    parts = df.select(F.spark_partition_id().alias("task"), "digest").collect()
    runs = [k for k, _ in groupby((x.task, x.digest) for x in parts)]
    assert len(runs) == len(set(runs)) < len(parts) / 2  # equal words side by side


def test_checksums_equal_their_definition(spark):
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = c << 1 ^ (0x104C11DB7 if c & 0x80000000 else 0)
        return c

    r = random.Random(4)
    rows = [(i, bytearray(r.randbytes(r.randrange(700)))) for i in range(40)] + [(40, bytearray()), (41, None)]
    got = {x.doc_id: x.crc for x in ogg.checksums(spark.createDataFrame(rows, "doc_id long, data binary"), "doc_id", "data").collect()}
    assert got == {i: None if d is None else slow(d) for i, d in rows}
