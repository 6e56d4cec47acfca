"""Queries of what runs as a kernel: bits, headers, code tables, transforms, block plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spindrift.functions import audio, codebook, encoder, mdct
from spindrift.functions import scalar as S
from spindrift.functions.arrow import slices
from spindrift.functions.bits import BitReader, BitWriter
from spindrift.operators import encode as E
from spindrift.operators import files
from spindrift.operators import signals as G
from spindrift.plans.codec import _streams
from spindrift.plans.registry import PACKETS, PAIRS, SAMPLES, SIGNAL, blocks, int_pairs, load, packets, query
from spindrift.sources import ogg, pcm


def _rows(df: DataFrame, schema: str, each: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows that each(*row) gives, in batches of bounded size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in slices(batches):
            out = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in each(*row)]
            del b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _texts(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))


BYTES = "(select doc_id, i, cast('0x' || x as bigint) as b from (select doc_id, unnest(l) as x, unnest(range(len(l))) as i from (select doc_id, regexp_extract_all(hex(encode(text)), '..') as l from documents)))"


@query(f"""select doc_id, cast(n // 11 as bigint) as fields, cast(sum(case when 8 * i + p < n // 11 * 11 then ((b >> p) & 1) << ((8 * i + p) % 11) else 0 end) as bigint) as total
from (select *, 8 * count(*) over (partition by doc_id) as n from {BYTES}), range(8) t(p) group by doc_id, n""")
def c1_bit_fields(spark, sf):
    """Every whole text as a row of 11-bit fields."""

    def each(doc, data):
        r = BitReader(data)
        n = r.size // 11
        return [(doc, n, sum(r.read(11) for _ in range(n)))] if data else []

    return _rows(_texts(spark, sf), "doc_id long, fields long, total long", each)


@query("""select l_orderkey, l_linenumber, cast(printf('%02x%02x%02x', v & 255, (v >> 8) & 255, (v >> 16) & 255) as varchar) as packed
from (select l_orderkey, l_linenumber, cast((l_linenumber & 7) | ((l_partkey & 1048575) << 3) as bigint) as v from lineitem)""")
def c3_bit_write(spark, sf):
    def each(order, line, part):
        w = BitWriter()
        w.write(line, 3)
        w.write(part, 20)
        return [(order, line, w.bytes().hex())]

    return _rows(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey long, l_linenumber int, packed string", each)


@query("select c_custkey, cast(1 + c_custkey % 8 as int) as channels, cast(8000 + c_custkey as bigint) as rate, 64 << cast(c_custkey % 3 as int) as short_block, 2048 << cast(c_custkey % 2 as int) as long_block from customer")
def d2_identification(spark, sf):
    def each(key):
        sent = audio.Identification(1 + key % 8, 8000 + key, (0, key, 0), (64 << key % 3, 2048 << key % 2))
        got = audio.Identification.read(sent.write())
        return [(key, got.channels, got.rate, *got.blocksizes)]

    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, channels int, rate long, short_block int, long_block int", each)


@query("select c_custkey, c_name as vendor, c_mktsegment || ',x=' || c_custkey as segments from customer")
def d3_comments(spark, sf):
    def each(key, name, segment):
        got = audio.Comments.read(audio.Comments(name, (f"SEG={segment}", "other=1", f"seg=x={key}", "seg")).write())
        return [(key, got.vendor, ",".join(got.get("Seg")))]

    return _rows(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey long, vendor string, segments string", each)


@query("select cast(c as int) as channels, true as same, 13 as books, 2 as modes from range(1, 9) t(c)")
def d4_setup_round_trip(spark, sf):
    """Setup headers of all channel counts: written, read and compared."""

    def each(channels):
        sent = encoder.Encoder(encoder.Config(44100, channels, 5.0)).setup
        got = audio.Setup.read(sent.write(channels), channels)
        return [(channels, got == sent, len(got.books), len(got.modes))]

    return _rows(spark.range(1, 9).select("id"), "channels int, same boolean, books int, modes int", each)


@query("select c_custkey, c_custkey % 11 between 1 and 8 and 7000 + c_custkey % 7 * 40000 between 8000 and 192000 and c_custkey % 14 - 2 between -1 and 10 as valid from customer")
def d10_config_check(spark, sf):
    def each(key):
        try:
            encoder.Config(7000 + key % 7 * 40000, key % 11, float(key % 14 - 2))
        except ValueError:
            return [(key, False)]
        return [(key, True)]

    return _rows(load(spark, sf, "customer").select("c_custkey"), "c_custkey long, valid boolean", each)


@query("select doc_id, unnest([0, 1, 2]) as place, unnest([sha256(coalesce(lang, '')), sha256(coalesce(source, '')), sha256(coalesce(text, ''))]) as digest from documents")
def a9_xiph_lacing(spark, sf):
    """Three buffers laced into one and split again; the last is the whole text."""
    parts = [F.encode(F.coalesce(c, F.lit("")), "utf-8") for c in ("lang", "source", "text")]
    split = _rows(load(spark, sf, "documents").select("doc_id", *parts), "doc_id long, place int, data binary", lambda doc, *p: [(doc, k, x) for k, x in enumerate(ogg.xiph_split(ogg.xiph_lace(list(p))))])
    return split.select("doc_id", "place", F.sha2("data", 256).alias("digest"))


@query("select doc_id, cast(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as hugeint))), lambda a, b: xor(a, b) * 1099511628211 % 18446744073709551616) as varchar) as hash from documents")
def k4_fnv(spark, sf):
    return _rows(_texts(spark, sf), "doc_id long, hash string", lambda doc, data: [(doc, str(pcm.fnv1a(data)))])


@query("""select doc_id, count(*) as frames, cast(sum(v) as bigint) as total, cast(max(abs(v)) as bigint) as peak
from (select doc_id, case when s >= 32768 then s - 65536 else s end as v from (select doc_id, cast('0x' || substr(x, 3, 2) || substr(x, 1, 2) as bigint) as s from (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '....')) as x from documents))) group by doc_id""")
def a13_raw_pcm(spark, sf):
    """Every whole text as 16-bit samples of one channel."""
    raw = pcm.raw_pcm(_texts(spark, sf).select(F.col("doc_id").cast("string").alias("source"), F.col("data").alias("content")), 1)
    v = F.transform(F.col("samples")[0], lambda x: (x * 32768).cast("long"))
    out = raw.select(F.col("source").cast("long").alias("doc_id"), v.alias("v")).where(F.size("v") > 0)
    return out.select("doc_id", F.size("v").cast("long").alias("frames"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(F.transform("v", lambda x: F.abs(x))).alias("peak"))


@query("select cast(n as int) as n, cast(i as int) as i, cast(least(i + 1, n - 1) as int) as length from range(2, 21) t(n), range(20) u(i) where i < n")
def j1_huffman_lengths(spark, sf):
    """Code lengths of weights that fall by four."""
    return _rows(spark.range(2, 21).select("id"), "n int, i int, length int", lambda n: [(n, i, x) for i, x in enumerate(encoder.code_lengths([4.0**-i for i in range(n)]))])


@query("select cast(n as int) as n, cast(i as int) as i, cast(case when i < n - 1 then (1 << (i + 1)) - 2 else (1 << (n - 1)) - 1 end as bigint) as code from range(2, 21) t(n), range(20) u(i) where i < n")
def e1_huffman_codes(spark, sf):
    """Codewords of the lengths 1, 2, ... n - 1, n - 1."""
    return _rows(spark.range(2, 21).select("id"), "n int, i int, code long", lambda n: [(n, i, c) for i, c in enumerate(codebook.codewords([min(i + 1, n - 1) for i in range(n)]))])


@query("select doc_id, unnest(map_keys(m)) as entry, unnest(map_values(m)) as n from (select doc_id, map_from_entries(list_transform(list_distinct(l), lambda e: {'k': e, 'v': len(list_filter(l, lambda x: x = e))})) as m from (select doc_id, list_transform(string_split(text, ' '), lambda w: cast(least(7, length(w)) as int)) as l from documents))")
def e2_huffman_decode(spark, sf):
    """Lengths of a whole text's words, coded and decoded."""
    book = codebook.Codebook(1, (7, 7, 6, 5, 4, 3, 2, 1))

    def each(doc, entries):
        w = BitWriter()
        for e in entries:
            book.encode(w, e)
        r, counts = BitReader(w.bytes()), {}
        for _ in entries:
            e = book.decode(r)
            counts[e] = counts.get(e, 0) + 1
        return [(doc, e, n) for e, n in counts.items()]

    words = F.transform(F.split("text", " ", -1), lambda w: F.least(F.lit(7), F.length(w)))
    return _rows(load(spark, sf, "documents").where("text is not null").select("doc_id", words), "doc_id long, entry int, n long", each)


def _posts(n: int) -> tuple[int, ...]:
    """0, n, then each span's middle in turn."""
    out, spans = [0, n], [(0, n)]
    while spans:
        a, b = spans.pop(0)
        if b - a > 1:
            out.append((a + b) // 2)
            spans += [(a, out[-1]), (out[-1], b)]
    return tuple(out)


@query("select vec_id, cast(n as int) as i, cast(greatest(0, least(127, floor(64 + 200 * x))) as int) as y from " + SAMPLES)
def f1_floor_amplitudes(spark, sf):
    """Post values folded and unfolded: each comes back."""
    floor = audio.Floor1((0,) * 31, (audio.FloorClass(2, 0, 0, (0,)),), 2, 6, _posts(64)[:64])
    target = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(127), F.floor(64 + 200 * x.cast("double")))).cast("int"))
    return _rows(blocks(spark, sf).select("vec_id", target), "vec_id long, i int, y int", lambda v, t: [(v, i, y) for i, y in enumerate(floor.unfold(floor.fold(t))[0])])


@query(f"select vec_id, cast(k as int) as bin, round(sum(x * cos(pi() / 64 * (n + 0.5) * (k + 0.5))), 6) as x from {SAMPLES}, range(64) t(k) group by vec_id, k")
def g3_dct4(spark, sf):
    return _rows(blocks(spark, sf).select("vec_id", F.col("embedding").cast("array<double>")), "vec_id long, bin int, x double", lambda v, x: [(v, k, float(y)) for k, y in enumerate(mdct.dct4(np.array([x]))[0])]).withColumn("x", F.round("x", 6))


@query(f"select vec_id, cast(k as int) as bin, round(sqrt(pow(sum(x * cos(2 * pi() / 64 * n * k)), 2) + pow(sum(x * sin(2 * pi() / 64 * n * k)), 2)), 6) as size from {SAMPLES}, range(64) t(k) group by vec_id, k")
def g4_fft(spark, sf):
    return _rows(blocks(spark, sf).select("vec_id", F.col("embedding").cast("array<double>")), "vec_id long, bin int, size double", lambda v, x: [(v, k, float(abs(y))) for k, y in enumerate(np.fft.fft(x))]).withColumn("size", F.round("size", 6))


@query(f"""with b as (select label, vec_id % 3 as segment, row_number() over (partition by label, vec_id % 3, n order by vec_id) as k, vec_id, n, x from {SAMPLES})
select c.label, c.vec_id, cast(c.n as int) as i, round(c.x + p.x, 6) as v from b c join b p on p.label = c.label and p.segment = c.segment and p.k = c.k - 1 and p.n = c.n + 32 where c.n < 32""")
def g10_reset(spark, sf):
    """Overlap-add that begins anew with each segment."""
    out = G.overlap_add(blocks(spark, sf).withColumn("segment", F.col("vec_id") % 3), ["label", "segment"], "vec_id", "embedding")
    return out.select("label", "vec_id", F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"select serial, doc_id, cast(sum(size) over (partition by serial order by doc_id) - size as bigint) as position, size as kept from {PACKETS}")
def h4_cut_stream(spark, sf):
    """Packets of streams without granule positions and without an end: nothing is trimmed."""
    cut = packets(spark, sf).withColumns({"granule": F.lit(None).cast("long"), "eos": F.lit(False)})
    return G.place(cut, ["serial"], "doc_id", "size", "granule", "eos").select("serial", "doc_id", "position", "kept")


@query("select label, vec_id, cast(64 * (row_number() over (partition by label order by vec_id % 3, vec_id) - 1) as bigint) as at from embeddings")
def h5_chain_concat(spark, sf):
    links = blocks(spark, sf).select(F.col("label").alias("source"), (F.col("vec_id") % 3).alias("link"), F.lit(0).alias("chan"), F.col("vec_id").alias("packet"), F.col("embedding").alias("samples"))
    return files.concatenated(links).select(F.col("source").alias("label"), F.col("packet").alias("vec_id"), "at")


@query("select distinct event_type as source, 0 as link, 7::bigint as serial from events")
def a11_links(spark, sf):
    """The audio streams of coded files, each beside a stream that is none."""
    coded = E.ogg_files(_streams(spark, sf), encoder.Config(8000, 1, 5.0))
    other = b"".join(p.to_bytes() for p in ogg.write_pages([(b"other", 0, True), (b"data", 5, False)], 55))
    both = coded.withColumn("content", F.concat(F.lit(other), "content"))
    return files.links(ogg.packets_in(both, strict=True), alike=True).select("source", "link", "serial")


@query("select distinct event_type as source, 1 as channels, 8000::bigint as rate, 'spindrift' as vendor from events")
def a12_headers(spark, sf):
    return pcm.headers_of(E.ogg_files(_streams(spark, sf), encoder.Config(8000, 1, 5.0))).select("source", "channels", "rate", "vendor")


@query("""with recursive z as materialized (select k, 13.0 * atan(0.00076 * k * 44100 / 2048.0) + 3.5 * atan(pow(k * 44100 / 2048.0 / 7500.0, 2)) as z from range(1024) t(k)),
n as materialized (select a.k, (select min(b.k) from z b where b.k > a.k and b.z - a.z >= 0.5) as following from z a),
s as (select 0 as band, cast(0 as bigint) as first union all select band + 1, following from s join n on n.k = s.first where following is not null)
select band, cast(first as int) as first, cast(coalesce(lead(first) over (order by band), 1024) as int) as ending from s""")
def i5_bark_bands(spark, sf):
    return spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(G.bark_bands(1024, 44100))], "band int, first int, ending int")


@query(f"select l_orderkey, l_linenumber, case when l = 0 and r = 0 then 0 when abs(l) > abs(r) then l else r end as m, case when l = 0 and r = 0 then 0 when (case when abs(l) > abs(r) then l else r end) > 0 then l - r else r - l end as a from {PAIRS}")
def i13_forward_coupling(spark, sf):
    """Coupled pairs; a pair of silent channels stays as it is."""
    c = S.couple(F.col("l"), F.col("r"))
    used = (F.col("l") != 0) | (F.col("r") != 0)
    return int_pairs(spark, sf).select("l_orderkey", "l_linenumber", F.when(used, c["m"]).otherwise(F.lit(0)).alias("m"), F.when(used, c["a"]).otherwise(F.lit(0)).alias("a"))


#: The block plan by its recurrence: segment energies, jumps, then block after block.
PLAN = """(with recursive v as (select event_type as source, pos, cast(v as float) as v from """ + SIGNAL + """),
n as materialized (select source, count(*) as total, (count(*) + 63) // 64 + 1 as segs from v group by 1),
g as (select source, unnest(range(64 * segs)) as pos from n),
d as (select source, pos, coalesce(v, cast(0 as float)) - coalesce(lag(v) over (partition by source order by pos), cast(0 as float)) as d from (select g.source, g.pos, coalesce(v.v, cast(0 as float)) as v from g left join v on v.source = g.source and v.pos = g.pos)),
e as materialized (select source, pos // 64 as seg, sum(cast(d as double) * cast(d as double)) as e from d group by 1, 2),
j as (select source, seg, e > 0.000064 and e > 12 * greatest(coalesce(sum(e) over (partition by source order by seg rows between 4 preceding and 1 preceding), 0) / 4, 0.0000064) as jump from e),
h as materialized (select source, list_prepend(0, list(c order by seg)) as hits from (select source, seg, sum(cast(jump as int)) over (partition by source order by seg) as c from j) group by 1),
b as (select n.source, cast(0 as bigint) as k, cast(0 as bigint) as centre, hits[least(16, segs) + 1] = hits[1] as is_long, true as was_long, total, segs, hits from n join h on h.source = n.source
union all select source, k + 1, centre + (case when is_long then 512 else 64 end) + (case when after then 512 else 64 end), after, is_long, total, segs, hits
from (select *, hits[least((centre + (case when is_long then 1024 else 576 end) + 1024 + 63) // 64, segs) + 1] = hits[least(greatest((centre + (case when is_long then 1024 else 576 end) - 512) // 64, 0), segs) + 1] as after from b) where centre < total)
select source, k + 3 as packet, least(centre, total) as granule, is_long, was_long as before, hits[least((centre + (case when is_long then 1024 else 576 end) + 1024 + 63) // 64, segs) + 1] = hits[least(greatest((centre + (case when is_long then 1024 else 576 end) - 512) // 64, 0), segs) + 1] as after from b)"""


@query(f"select source, packet, granule, is_long, before, after from {PLAN}")
def i4_block_plan(spark, sf):
    """Block sequence of each signal."""
    return E.plan_blocks(_streams(spark, sf)).select("source", "packet", "granule", "is_long", "before", "after")


@query(f"select source, packet, granule, true as same from {PLAN} union all select distinct event_type, cast(p as bigint), 0, true from events, range(3) t(p)")
def j9_encode_packets(spark, sf):
    """Granule positions of coded packets, and whether pushing the samples in pieces of 300
    gives the same packets."""
    config = encoder.Config(8000, 1, 5.0)
    streams = _streams(spark, sf)

    def each(source, samples):
        x, live = np.array(samples, dtype=np.float32), encoder.Push(encoder.Encoder(config))
        out = [(k, 0, h) for k, h in enumerate(live.encoder.headers())]
        for at in range(0, x.shape[1], 300):
            out += live.push(x[:, at : at + 300])
        return [(source, k, g, data) for k, g, data in out + live.finish()]

    pushed = _rows(streams.select("source", "samples"), "source string, packet long, g long, pushed binary", each)
    both = E.encode(streams, config).join(pushed, ["source", "packet"], "full")
    return both.select("source", "packet", "granule", F.coalesce((F.col("data") == F.col("pushed")) & (F.col("granule") == F.col("g")), F.lit(False)).alias("same"))


_LATTICES = ", ".join(f"({5 + k}, {(2 * t + 1) ** d}, {d})" for k, (d, t, _) in enumerate(encoder.LATTICES))


@query(f"select cast(place as int) as book, cast(entries as int) as entries, cast(dims as int) as dims from (values (0, 256, 1), (1, 8, 1), (2, 24, 1), (3, 128, 1), (4, 81, 2), {_LATTICES}) t(place, entries, dims)")
def j3_codebooks(spark, sf):
    return spark.createDataFrame([(k, len(b.lengths), b.dims) for k, b in enumerate(encoder.codebooks())], "book int, entries int, dims int")


@query("""with recursive s as (select * from (values (128, 16), (1024, 32)) t(half, n)),
z as materialized (select half, n, k, 13.0 * atan(0.00076 * (k * 22050.0 / half)) + 3.5 * atan(pow(k * 22050.0 / half / 7500.0, 2)) as z from (select *, unnest(range(1, half)) as k from s)),
t as (select half, n, j, (13.0 * atan(0.00076 * 22050.0) + 3.5 * atan(pow(22050.0 / 7500.0, 2))) * j / (n + 1) as z from (select *, unnest(range(1, n + 1)) as j from s)),
p as (select distinct half, k from (select t.half, arg_min(z.k, abs(z.z - t.z)) as k from t join z using (half) group by t.half, t.j)),
l as (select half, list(k order by k) as ks from p group by half),
q as (select half, ks, 0 as a, len(ks) // 4 * 4 as b, 0 as level, 0 as place from l
union all select half, ks, case when side = 0 then a else (a + b) // 2 + 1 end, case when side = 0 then (a + b) // 2 else b end, level + 1, 2 * place + side from q, range(2) x(side) where a < b)
select 2 * half as blocksize, cast(i as int) as i, cast(x as int) as x from (select half, 1 + row_number() over (partition by half order by level, place) as i, ks[(a + b) // 2 + 1] as x from q where a < b union all select half, 0, 0 from s union all select half, 1, half from s)""")
def j4_floor_posts(spark, sf):
    """Posts of both block sizes in the order in which they are coded."""
    return spark.createDataFrame([(n, i, x) for n in encoder.BLOCKSIZES for i, x in enumerate(encoder.floor_for(n // 2).xs)], "blocksize int, i int, x int")


@query("select event_type as source, cast(count(*) as bigint) as samples from events group by 1")
def g11_decode_blocks(spark, sf):
    """Samples of coded files that are read as wholes, by place in the file."""
    found = files.decode_files(E.ogg_files(_streams(spark, sf), encoder.Config(8000, 1, 5.0)), "FAILFAST")
    return found.groupBy("source").agg(F.max(F.col("at") + F.size("samples")).cast("long").alias("samples"))
