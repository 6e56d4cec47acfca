"""Queries of the codec's parts on their own: pages, headers, floors, residues, blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import audio, codebook, encoder
from spindrift.functions.bits import BitReader, BitWriter, EndOfPacket
from spindrift.functions.codebook import Codebook, Invalid, Lookup
from spindrift.operators import decode as D
from spindrift.operators import encode as E
from spindrift.operators import synthetic
from spindrift.plans.codec import _streams
from spindrift.plans.kernels import PLAN, _rows, _texts
from spindrift.plans.registry import SAMPLES, SIGNAL, blocks, load, query
from spindrift.sources import ogg

_SIZES = "(select doc_id, text, octet_length(encode(coalesce(text, ''))) as n, octet_length(encode(coalesce(text, ''))) // 255 + 1 as laces from documents)"
_PAGES = f"(select *, cast(ceil(laces / 17.0) as bigint) as pages from {_SIZES})"


def _pages(data: bytes) -> list[ogg.Page]:
    """A stream whose only packet is data, in pages of 17 laces."""
    return list(ogg.write_pages([(data, len(data), False)], 1, 4096))


def _valid(read) -> bool:
    try:
        read()
    except Invalid:
        return False
    return True


def _written(thing) -> BitReader:
    w = BitWriter()
    thing.write(w)
    return BitReader(w.bytes())


@query(f"select doc_id, pages, sha256(coalesce(text, '')) as digest from {_PAGES}")
def a2_buffered_reads(spark, sf):
    """Every whole text in a stream, read in pieces of 1000 bytes."""

    def each(doc, data):
        raw, at = b"".join(p.to_bytes() for p in _pages(data)), 0

        def piece(n):
            nonlocal at
            at += 1000
            return raw[at - 1000 : at]

        pages = list(ogg.read_pages(ogg.Buffer(piece, 1000), strict=True))
        return [(doc, len(pages), b"".join(p.body for p in pages))]

    return _rows(_texts(spark, sf), "doc_id long, pages long, body binary", each).select("doc_id", "pages", F.sha2("body", 256).alias("digest"))


@query(f"""select doc_id, pages - hurt as pages, cast(hurt as bigint) as bad, cast(case when hurt = 1 then 27 + l + least(n - 4335, 4335) else 0 end as bigint) as skipped, hurt = 0 as strict_ok
from (select *, cast(doc_id % 3 = 1 and pages > 1 as int) as hurt, least(17, laces - 17) as l from {_PAGES})""")
def a8_strict_and_lenient(spark, sf):
    """Streams of which every third has a damaged second page, read in both modes."""

    def each(doc, data):
        pages = _pages(data)
        raw = bytearray(b"".join(p.to_bytes() for p in pages))
        if doc % 3 == 1 and len(pages) > 1:
            raw[len(pages[0].to_bytes()) + 6] ^= 1
        counts: dict[str, int] = {}
        kept = list(ogg.read_pages(bytes(raw), False, counts))
        try:
            strict = len(list(ogg.read_pages(bytes(raw), True))) == len(pages)
        except ogg.Damaged:
            strict = False
        return [(doc, len(kept), counts["bad"], counts["skipped"], strict)]

    return _rows(_texts(spark, sf), "doc_id long, pages long, bad long, skipped long, strict_ok boolean", each)


@query(f"""select doc_id, cast(p as bigint) as page, cast((case when p > 0 then 1 else 2 end) + (case when p = pages - 1 then 4 else 0 end) as int) as flags,
cast(case when p = pages - 1 then n else -1 end as bigint) as granule, cast(least(17, laces - 17 * p) as int) as laces, cast(least(4335, n - 4335 * p) as bigint) as body from (select *, unnest(range(pages)) as p from {_PAGES})""")
def b1_pages(spark, sf):
    """The pages of every whole text as one packet, written and read back."""

    def each(doc, data):
        raw = b"".join(p.to_bytes() for p in _pages(data))
        return [(doc, p.sequence, p.flags, p.granule, len(p.lacing), len(p.body)) for p in ogg.read_pages(raw, strict=True)]

    return _rows(_texts(spark, sf), "doc_id long, page long, flags int, granule long, laces int, body long", each)


@query(f"select source, count(*) + 3 as packets, max(granule) as samples from {PLAN} group by 1")
def b5_file_packets(spark, sf):
    """Packets of whole files, whose blocks were coded by tasks in any order."""
    files = E.ogg_files(_streams(spark, sf), encoder.Config(8000, 1, 5.0))
    found = ogg.packets_in(files, strict=True)
    return found.groupBy("source").agg(F.count("*").alias("packets"), F.max("granule").alias("samples"))


@query("""select doc_id, (b >> 3) & 1 = 1 as flag, cast((b >> 4) & 31 as int) as five, cast(8 * n - 4 as bigint) as remaining, true as ended
from (select doc_id, n, cast('0x' || substr(h, 1, 2) as bigint) + 256 * cast('0x' || coalesce(nullif(substr(h, 3, 2), ''), '0') as bigint) as b from (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) as n from documents) where n > 0)""")
def c2_bit_cursor(spark, sf):
    """Skip, flag, peek and the end, on every whole text."""

    def each(doc, data):
        if not data:
            return []
        r = BitReader(data)
        r.skip(3)
        flag, five, left = r.flag(), r.peek(5), r.remaining()
        try:
            r.read(left + 1)
        except EndOfPacket:
            return [(doc, flag, five, left, r.remaining() == 0)]
        return [(doc, flag, five, left, False)]

    return _rows(_texts(spark, sf), "doc_id long, flag boolean, five int, remaining long, ended boolean", each)


@query("select doc_id, doc_id % 4 = 1 and doc_id % 5 <> 0 as valid, case when doc_id % 4 = 1 and doc_id % 5 <> 0 then octet_length(encode(coalesce(text, ''))) end as body from documents")
def d1_common_header(spark, sf):
    """Packets of four types, some with another name, taken as identification headers."""

    def each(doc, data):
        packet = bytes([doc % 4]) + (audio.MAGIC if doc % 5 else b"vorbid") + data
        try:
            return [(doc, True, len(audio._common(packet, 1)))]
        except Invalid:
            return [(doc, False, None)]

    return _rows(_texts(spark, sf), "doc_id long, valid boolean, body long", each)


@query("""select c_custkey, cast(entries as int) as entries, cast(used as int) as used, cast(floor(sqrt(entries)) as int) as n_values, cast(list_sum(list_transform(range(cast(floor(sqrt(entries)) as bigint)), lambda i: (c_custkey + i) % 16)) as bigint) as total, true as same
from (select c_custkey, 2 + c_custkey % 12 + (case when c_custkey % 3 = 2 then 2 else 0 end) as entries, 2 + c_custkey % 12 as used from customer)""")
def d5_codebook_read(spark, sf):
    """Codebooks with ordered, plain and sparse lengths and a lattice, written and read."""

    def each(key):
        n = 2 + key % 12
        lengths = [min(i + 1, n - 1) for i in range(n)]
        lengths = (lengths, lengths[::-1], [0, *lengths[::-1], 0])[key % 3]
        count = codebook.lookup1(len(lengths), 2)
        sent = Codebook(2, tuple(lengths), Lookup(1, encoder._packed(-3), encoder._packed(2), 4, bool(key % 2), tuple((key + i) % 16 for i in range(count))))
        got = Codebook.read(_written(sent))
        return [(key, len(got.lengths), sum(x > 0 for x in got.lengths), len(got.lookup.multiplicands), sum(got.lookup.multiplicands), got == sent)]

    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, entries int, used int, n_values int, total long, same boolean", each)


@query("""select c_custkey, case when used = 0 then true when used = 1 then total = 0.5 else total = 1 end as valid from (select c_custkey, list_sum(list_transform(l, lambda x: case when x > 0 then pow(0.5, x) else 0.0 end)) as total, len(list_filter(l, lambda x: x > 0)) as used
from (select c_custkey, list_transform(range(4), lambda i: (c_custkey // cast(pow(4, i) as bigint)) % 4) as l from customer))""")
def d6_codebook_check(spark, sf):
    """Four code lengths from 0 to 3: whether they fill a tree."""
    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, valid boolean", lambda key: [(key, _valid(lambda: Codebook(1, tuple(key // 4**i % 4 for i in range(4)))))])


_LATTICE = Codebook(2, (4,) * 14 + (5,) * 4, Lookup(1, encoder._packed(0), encoder._packed(1), 3, False, (0, 1, 2, 5)))
_PLAIN = Codebook(2, (3,) * 7 + (4, 4))


@query("select c_custkey, c_custkey % 4 > 0 and (c_custkey // 4) % 3 > 0 and (c_custkey // 12) % 3 = 0 as valid from customer")
def d7_floor0_read(spark, sf):
    """Floors of type 0 of some order, map size and book: one lattice, one without, one missing."""

    def each(key):
        sent = audio.Floor0(key % 4, 8000, key // 4 % 3 * 64, 6, 100, (key // 12 % 3,))
        return [(key, _valid(lambda: audio.Floor0.read(_written(sent), [_LATTICE, _PLAIN])))]

    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, valid boolean", each)


@query("select c_custkey, a <> b and c < 2 as valid, case when a <> b and c < 2 then cast(a + b as int) end as posts from (select c_custkey, 1 + c_custkey % 7 as a, 1 + (c_custkey // 7) % 7 as b, (c_custkey // 49) % 3 as c from customer)")
def d8_floor1_read(spark, sf):
    """Floors of type 1 whose two posts may be one, and whose book may be missing."""

    def each(key):
        sent = audio.Floor1((0,), (audio.FloorClass(2, 0, 0, (key // 49 % 3,)),), 2, 3, (0, 8, 1 + key % 7, 1 + key // 7 % 7))
        try:
            return [(key, True, sum(audio.Floor1.read(_written(sent), [_LATTICE, _PLAIN]).xs[2:]))]
        except Invalid:
            return [(key, False, None)]

    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, valid boolean, posts int", each)


@query("select c_custkey, c_custkey % 5 <= (c_custkey // 5) % 5 and 1 + c_custkey % 4 <= 3 and (6 + (c_custkey // 25) % 3) % 2 = 0 as valid from customer")
def d9_residue_read(spark, sf):
    """Residues of some range, partition size and number of classes, for a book of nine words of two classes."""

    def each(key):
        n = 1 + key % 4
        sent = audio.Residue(0, key % 5, key // 5 % 5, 6 + key // 25 % 3, n, 1, ((0,) + (-1,) * 7,) * n)
        return [(key, _valid(lambda: audio.Residue.read(_written(sent), 0, [_LATTICE, _PLAIN])))]

    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, valid boolean", each)


@query("select distinct event_type as source, 1 as channels, 8000::bigint as rate, 13 as books, 2 as floors, 2 as modes from events")
def d11_decoder(spark, sf):
    """The decoder that each coded file's headers make."""
    heads = D.stream_headers(ogg.packets_in(E.ogg_files(_streams(spark, sf), encoder.Config(8000, 1, 5.0)), strict=True).withColumn("link", F.lit(0)))

    def each(source, ident, setup):
        i, s = audio.headers(ident, setup)
        return [(source, i.channels, i.rate, len(s.books), len(s.floors), len(s.modes))]

    return _rows(heads.select("source", "identification", "setup"), "source string, channels int, rate long, books int, floors int, modes int", each)


@query("select cast(n as int) as n, cast(i as int) as i, repeat('1', cast(i as int)) || case when i < n - 1 then '0' else '' end as bits from range(2, 21) t(n), range(20) u(i) where i < n")
def e4_codeword_write(spark, sf):
    """Bits of each codeword, first bit first, between two ones."""

    def each(n):
        book, out = Codebook(1, tuple(min(i + 1, n - 1) for i in range(n))), []
        for i in range(n):
            w = BitWriter()
            w.write(1, 1)
            book.encode(w, i)
            w.write(1, 1)
            r = BitReader(w.bytes())
            bits = "".join(str(r.read(1)) for _ in range(book.lengths[i] + 2))
            out.append((n, i, bits[1:-1]))
        return out

    return _rows(spark.range(2, 21).select("id"), "n int, i int, bits string", each)


_MUL = "list_extract([0, 1, 2, 5], cast({} as int) + 1)"


@query(f"""select l_orderkey, l_linenumber, cast(d as int) as d, cast(amplitude as int) as amplitude, cast(case when d < 2 then x0 else x1 + last end as double) as coefficient
from (select *, {_MUL.format('(e0 // cast(pow(4, d % 2) as bigint)) % 4')} as x0, {_MUL.format('(e1 // cast(pow(4, d % 2) as bigint)) % 4')} as x1, {_MUL.format('(e0 // 4) % 4')} as last
from (select l_orderkey, l_linenumber, l_linenumber % 4 as amplitude, l_partkey % 16 as e0, (l_partkey // 16) % 16 as e1, unnest([0, 1, 2]) as d from lineitem)) where amplitude > 0""")
def e6_floor0_packet(spark, sf):
    """Three coefficients of two vectors; the second goes on from the first's last. Amplitude 0 has none."""
    floor, book = audio.Floor0(3, 8000, 64, 6, 100, (0,)), Codebook(2, (4,) * 16, _LATTICE.lookup)

    def each(order, line, part):
        w = BitWriter()
        w.write(line % 4, 6)
        w.write(0, 1)
        for e in (part % 16, part // 16 % 16):
            book.encode(w, e)
        got = floor.decode(BitReader(w.bytes()), [book])
        return [] if got is None else [(order, line, d, got[0], float(c)) for d, c in enumerate(got[1])]

    return _rows(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey long, l_linenumber int, d int, amplitude int, coefficient double", each)


@query("""select l_orderkey, l_linenumber, cast(i as int) as i, cast(case i when 0 then l_partkey % 128 when 1 then l_orderkey % 128 else case when (word >> (i - 2)) & 1 = 1 then (l_partkey + i) % 9 else 0 end end as int) as y
from (select l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 as word, unnest([0, 1, 2, 3]) as i from lineitem where l_linenumber <> 5)""")
def e7_floor1_packet(spark, sf):
    """Two raw values and a partition of two, each with a book or without; unused floors give no row."""
    floor = audio.Floor1((0,), (audio.FloorClass(2, 1, 1, (-1, 0)),), 2, 3, (0, 8, 4, 2))
    books = [_PLAIN, Codebook(1, (2,) * 4)]

    def each(order, line, part):
        w = BitWriter()
        w.write(line != 5, 1)
        if line != 5:
            w.write(part % 128, 7)
            w.write(order % 128, 7)
            books[1].encode(w, line % 4)
            for i in range(2):
                if line % 4 >> i & 1:
                    books[0].encode(w, (part + i + 2) % 9)
        got = floor.decode(BitReader(w.bytes()), books)
        return [] if got is None else [(order, line, i, y) for i, y in enumerate(got)]

    return _rows(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey long, l_linenumber int, i int, y int", each)


_STEP = Codebook(2, (3,) * 7 + (4, 4), Lookup(1, encoder._packed(-1), encoder._packed(1), 2, False, (0, 1, 2)))


@query("""select s_suppkey, cast(kind as int) as kind, cast(chan as int) as chan, cast(i as int) as i, cast(case when c = 1 then ((e // cast(pow(3, d) as bigint)) % 3) - 1 when c = 2 then 2 * ((e // cast(pow(3, d) as bigint)) % 3) - 2 else 0 end as double) as v
from (select *, (s_suppkey + 5 * v + 7 * p + 3 * j) % 9 as e, (s_suppkey + p + v) % 3 as c
from (select s_suppkey, kind, chan, i, case when kind = 2 then 0 else chan end as v, case when kind = 2 then (2 * i + chan) // 8 else i // 8 end as p,
case kind when 0 then i % 4 when 1 then (i % 8) // 2 else ((2 * i + chan) % 8) // 2 end as j, case kind when 0 then (i % 8) // 4 when 1 then i % 2 else chan end as d
from supplier, range(3) k(kind), range(2) h(chan), range(16) t(i)))""")
def e8_residue_packet(spark, sf):
    """Residues of the three types, two channels of 16 values: classes without a book, with
    one pass and with two alike passes."""
    rows = ((-1,) * 8, (0,) + (-1,) * 7, (0, -1, 0) + (-1,) * 5)

    def each(key):
        out = []
        for kind in range(3):
            vectors, n = (1, 32) if kind == 2 else (2, 16)
            residue, w = audio.Residue(kind, 0, n, 8, 3, 1, rows), BitWriter()
            for k in range(8):
                for first in range(0, n // 8, 2):
                    if k == 0:
                        for v in range(vectors):
                            c = [(key + p + v) % 3 for p in (first, first + 1)]
                            _PLAIN.encode(w, c[0] * 3 + c[1])
                    for p in (first, first + 1):
                        for v in range(vectors):
                            if rows[(key + p + v) % 3][k] >= 0:
                                for j in range(4):
                                    _STEP.encode(w, (key + 5 * v + 7 * p + 3 * j) % 9)
            got, whole = residue.decode(BitReader(w.bytes()), [_STEP, _PLAIN], [False, False], 16)
            assert whole
            out += [(key, kind, c, i, float(x)) for c, row in enumerate(got) for i, x in enumerate(row)]
        return out

    return _rows(load(spark, sf, "supplier").select("s_suppkey"), "s_suppkey long, kind int, chan int, i int, v double", each)


_LATTICES = ", ".join(f"({k}, {d}, {t}, {s})" for k, (d, t, s) in enumerate(encoder.LATTICES))


@query(f"select cast(k as int) as lattice, cast(entry as int) as entry, cast(d as int) as d, cast(((entry // cast(pow(2 * top + 1, d) as bigint)) % (2 * top + 1) - top) * step as double) as v from (values {_LATTICES}) l(k, dims, top, step), range(729) e(entry), range(4) r(d) where entry < pow(2 * top + 1, dims) and d < dims")
def j2_lattices(spark, sf):
    """Every vector of every residue book."""
    books = [b for b in encoder.codebooks() if b.lookup]
    return _rows(spark.range(len(books)).select("id"), "lattice int, entry int, d int, v double", lambda k: [(k, e, d, float(x)) for e in range(len(books[k].lengths)) for d, x in enumerate(books[k].vector(e))])


@query("""select cast(c as int) as channels, cast(case when c < 2 then 0 when c < 4 then 1 when c < 8 then 2 else 3 end as int) as pairs, cast(case when c between 6 and 8 then c - 1 else -1 end as int) as lfe, 2 as mappings, 2 as modes,
cast(least(32 * ceil(c * ceil(least(19250.0, 22050.0) / 22050 * 1024) / 32), 1024 * c) as int) as long_end from range(1, 9) t(c)""")
def j5_setup(spark, sf):
    """Coupling, low-frequency channel, mappings and the long residue's end at 44100 Hz and quality 5."""

    def each(channels):
        enc = encoder.Encoder(encoder.Config(44100, channels, 5.0))
        s = enc.setup
        return [(channels, len(s.mappings[1].coupling), encoder.LFE.get(channels, -1), len(s.mappings), len(s.modes), s.residues[1].end)]

    return _rows(spark.range(1, 9).select("id"), "channels int, pairs int, lfe int, mappings int, modes int, long_end int", each)


@query("select vec_id, cast(n as int) as i, cast(floor(abs(x) * 1000) as int) % 128 as y from " + SAMPLES + " where n < 34")
def j6_floor_write(spark, sf):
    """Post values of the long floor, written as the encoder does and read back."""
    enc = encoder.Encoder(encoder.Config(44100, 1, 5.0))
    floor = enc.floors[1]

    def each(vec, y):
        w = encoder._Words(1)
        enc._floors(w, floor, np.array([y]), np.array([True]), 1)
        got = floor.decode(BitReader(w.bytes()[0]), enc.setup.books)
        return [(vec, i, v) for i, v in enumerate(got)]

    y = F.transform(F.slice("embedding", 1, len(floor.xs)), lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 128).cast("int"))
    return _rows(blocks(spark, sf).select("vec_id", y), "vec_id long, i int, y int", each)


@query("select vec_id, cast(n as int) as i, cast(trunc(x * s) as bigint) as v from (select *, list_extract([3, 20, 300, 9000, 0], cast(vec_id % 5 + 1 as int)) as s from " + SAMPLES + ")")
def j7_residue_write(spark, sf):
    """Values of all classes, written as the encoder does and read back."""
    enc = encoder.Encoder(encoder.Config(44100, 1, 5.0))
    residue = audio.Residue(2, 0, 64, 32, len(encoder.CLASS_PASSES), 4, enc.residues[1].books)

    def each(vec, v):
        w = encoder._Words(1)
        enc._residues(w, np.zeros(1, dtype=np.int64), residue, np.array([v], dtype=np.int64))
        got, whole = residue.decode(BitReader(w.bytes()[0]), enc.setup.books, [False], 64)
        assert whole
        return [(vec, i, int(x)) for i, x in enumerate(got[0])]

    scale = F.element_at(F.array(*map(F.lit, (3, 20, 300, 9000, 0))), (F.col("vec_id") % 5 + 1).cast("int"))
    v = F.transform("embedding", lambda x: (x.cast("double") * scale).cast("long"))
    return _rows(blocks(spark, sf).select("vec_id", v), "vec_id long, i int, v long", each)


def _compared(streams, config: encoder.Config, keys: list[str]):
    """Each sample of the streams' channels beside what it decodes to, both as double."""
    pcm = D.decode(ogg.packets_in(E.ogg_files(streams, config), strict=True), strict=True)
    heard = pcm.select("source", "chan", "position", F.posexplode("samples").alias("i", "y")).select("source", "chan", (F.col("position") + F.col("i")).alias("pos"), F.col("y").cast("double").alias("y"))
    sent = streams.select("source", F.posexplode("samples").alias("chan", "s")).select("source", "chan", F.posexplode("s").alias("pos", "x"))
    both = sent.join(heard, ["source", "chan", "pos"]).withColumn("x", F.col("x").cast("double"))
    x, y = F.col("x"), F.col("y")
    db = 10 * F.log10(F.sum(x * x) / F.sum((x - y) * (x - y)))
    return both.groupBy(*keys).agg(F.count("*").alias("samples"), db.alias("db"), F.bool_and(~F.isnan(y) & (F.abs(y) < 100)).alias("finite"))


@query(f"select event_type as source, count(*) as samples, true as close, true as finite from {SIGNAL} group by 1")
def g11_decode_samples(spark, sf):
    """Noise coded at the highest quality and decoded, every sample compared: signal to error
    is at least 5 dB."""
    rows = _compared(_streams(spark, sf), encoder.Config(8000, 1, 10.0), ["source"])
    return rows.select("source", "samples", (F.col("db") >= 5).alias("close"), "finite")


#: (rate, channels, quality, least signal to error in dB of the worst channel)
LADDER = [(44100, 2, -1, 5.0), (44100, 2, 4, 12.0), (44100, 2, 10, 20.0), (22050, 1, 3, 9.5), (44100, 6, 5, 6.0)]
_LADDER = ", ".join(map(str, LADDER))


@query(f"select cast(rate as int) as rate, cast(channels as int) as channels, cast(quality as int) as quality, cast(rate * channels as bigint) as samples, true as good from (values {_LADDER}) t(rate, channels, quality, db)")
def j8_quality_ladder(spark, sf):
    """Test signals of a second, coded and decoded: samples, and whether the worst channel
    reaches its quality's ratio of signal to error."""
    out = None
    for rate, channels, quality, least in LADDER:
        cases = spark.createDataFrame([("t", 1, rate, channels, 1.0, 0.06)], "source string, serial long, rate int, channels int, seconds double, noise double")
        found = _compared(synthetic.test_signals(cases), encoder.Config(rate, channels, float(quality)), ["chan"])
        one = found.agg(F.sum("samples").alias("samples"), ((F.min("db") >= least) & F.bool_and("finite")).alias("good"))
        one = one.select(F.lit(rate).alias("rate"), F.lit(channels).alias("channels"), F.lit(quality).alias("quality"), "samples", "good")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with recursive s as (select 0 as k, cast(305419896 as hugeint) as x union all select k + 1, (x * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 from s where k < 1000),
w as materialized (select (k - 1) // 2 as i, (k - 1) % 2 as c, cast(x // 8589934592 as double) / 2147483648 * 2 - 1 as white from s where k > 0),
l as (select -1 as i, 0 as c, 0.0::double as lp union all select -1, 1, 0.0::double union all select l.i + 1, l.c, 0.9::double * l.lp + 0.1::double * w.white from l join w on w.i = l.i + 1 and w.c = l.c)
select cast(c as int) as chan, cast(i as int) as i, round(case when i / 500.0 > 0.4 and i / 500.0 < 0.5 then 0 else 0.18 * tone * (0.5 + 0.5 * abs(sin(2 * pi() * 0.7 * t))) + 0.06 * lp + case when t < 0.01 then 0.6 * exp(-t * 400) * white else 0 end end, 5) + 0.0 as v
from (select c, i, t, lp, white, list_sum(list_transform([1, 2, 3, 4, 5, 6, 7], lambda h: sin(2 * pi() * f0 * h * t) / h)) as tone from (select w.c, w.i, w.i / 8000.0 as t, lp, white, 220.0 * (1 + w.c * 0.25) * (1 + 0.003 * sin(2 * pi() * 5 * w.i / 8000.0)) as f0 from w join l using (i, c)))""")
def k9_test_signal(spark, sf):
    """500 samples of two channels."""
    cases = spark.createDataFrame([("t", 1, 8000, 2, 0.0625, 0.06)], "source string, serial long, rate int, channels int, seconds double, noise double")
    rows = synthetic.test_signals(cases).select(F.posexplode("samples").alias("chan", "s")).select("chan", F.posexplode("s").alias("i", "v"))
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 5) + 0.0)


_NEXT = "(({x}) * 6364136223846793005 + 1442695040888963407) % 18446744073709551616"


@query(f"""select source, list_extract(['flip', 'cut', 'insert', 'remove'], cast((a // 8589934592) % 4 as int) + 1) as kind,
cast(case cast((a // 8589934592) % 4 as int) when 0 then n when 1 then place when 2 then n + amount else n - least(amount, n - place) end as bigint) as bytes
from (select *, (b // 8589934592) % greatest(n, 1) as place, ({_NEXT.format(x='b')}) // 8589934592 % 257 as amount from (select *, {_NEXT.format(x='a')} as b
from (select source, n, {_NEXT.format(x='x')} as a from (select doc_id as source, octet_length(encode(coalesce(text, ''))) as n, xor(cast(11400714819323198485 as hugeint), cast(doc_id as hugeint)) as x from documents))))""")
def k10_damage(spark, sf):
    """Every whole text, damaged: the kind and how many bytes are left."""
    return synthetic.damaged(_texts(spark, sf).select(F.col("doc_id").alias("source"), F.col("data").alias("content"))).select("source", "kind", F.octet_length("content").cast("long").alias("bytes"))
