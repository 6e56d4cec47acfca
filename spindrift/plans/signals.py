"""Queries of containers, transforms, time axis, analysis and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import scalar as S
from spindrift.operators import signals as G
from spindrift.plans.registry import PACKETS, PAIRS, SAMPLES, SIGNAL, blocks, int_pairs, load, packets, query, signal
from spindrift.plans.scalars import _DB
from spindrift.sources import ogg

RATE, HALF = 44100, 32
_WIN = "sin(pi() / 2 * pow(sin((least(n, 63 - n) + 0.5) / 32 * pi() / 2), 2))"
_COS = "cos(2 * pi() / 64 * (n + 0.5 + 16) * (k + 0.5))"
_HZ = RATE / 2 / HALF
SPECTRA = f"(select vec_id, k, 4.0 / 64 * sum(x * {_WIN} * {_COS}) as x from {SAMPLES}, range(32) t(k) group by vec_id, k)"
_BANDS = G.bark_bands(HALF, RATE)
BANDS = "(values " + ", ".join(f"({i}, {k}, {b - a}, {z!r}::double)" for i, (a, b, z) in enumerate(_BANDS) for k in range(a, b)) + ") bands(band, k, width, z)"


def _r(c, n=6):
    return F.round(c, n)


def _spectra(spark, sf):
    return G.transform_blocks(blocks(spark, sf), "vec_id", "embedding", sizes=(64, 64))


@query(f"select vec_id, cast(band as int) as band, round(sum(x * x), 6) as energy from {SPECTRA} join {BANDS} using (k) group by vec_id, band")
def g2_band_energy(spark, sf):
    x = G.bins(_spectra(spark, sf), "vec_id")
    return x.join(F.broadcast(G.band_frame(x, HALF, RATE)), "bin").groupBy("vec_id", "band").agg(_r(F.sum(F.col("x") * F.col("x"))).alias("energy"))


@query(f"select vec_id, cast(k as int) as bin, round(4.0 / 64 * sum(x * {_COS}), 6) as x from {SAMPLES}, range(32) t(k) group by vec_id, k")
def g2_forward_mdct(spark, sf):
    return G.bins(G.transform_blocks(blocks(spark, sf), "vec_id", "embedding"), "vec_id").withColumn("x", _r("x") + 0.0)


@query(f"select vec_id, cast(i as int) as i, round(sum(x * cos(2 * pi() / 128 * (i + 0.5 + 32) * (n + 0.5))), 6) as y from {SAMPLES}, range(128) t(i) group by vec_id, i")
def g1_imdct(spark, sf):
    """Every whole embedding as a spectrum of 64 values."""
    return G.transform_blocks(blocks(spark, sf), "vec_id", "embedding", inverse=True).select("vec_id", F.posexplode("x").alias("i", "y")).withColumn("y", _r("y") + 0.0)


@query("select cast(i as int) as i, round(sin(pi() / 2 * pow(sin((i + 0.5) / 128 * pi() / 2), 2)), 6) as s from range(128) t(i)")
def g5_slope(spark, sf):
    return spark.range(128).select(F.col("id").cast("int").alias("i"), _r(S.slope(F.col("id"), F.lit(128.0))).alias("s"))


@query("""with c as (select n, p, f from (values (256, 256, 256), (2048, 256, 256), (2048, 256, 2048), (2048, 2048, 256), (2048, 2048, 2048)) t(n, p, f)),
w as (select n, p, f, i, i - (n // 4 - p // 4) as u, (n * 3 // 4 + f // 4) - 1 - i as d from c, range(2048) r(i) where i < n)
select cast(n as int) as n, cast(p as int) as prev, cast(f as int) as following, cast(i as int) as i,
round(case when i < n // 2 then (case when u < 0 then 0.0 when u >= p // 2 then 1.0 else sin(pi() / 2 * pow(sin((u + 0.5) / (p // 2) * pi() / 2), 2)) end)
else (case when d < 0 then 0.0 when d >= f // 2 then 1.0 else sin(pi() / 2 * pow(sin((d + 0.5) / (f // 2) * pi() / 2), 2)) end) end, 6) as w from w""")
def g6_window(spark, sf):
    cases = spark.createDataFrame([(256, 256, 256), (2048, 256, 256), (2048, 256, 2048), (2048, 2048, 256), (2048, 2048, 2048)], "n int, prev int, following int")
    x = cases.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return x.withColumn("w", _r(S.window(F.col("i"), F.col("n"), F.col("prev"), F.col("following"))))


@query(f"select vec_id, cast(n as int) as i, round(case when vec_id % 7 = 0 then 0.0 else x * {_DB.format(y='(n * 3 % 256)')} end, 9) + 0.0 as v from {SAMPLES}")
def g7_floor_residue(spark, sf):
    curve = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: S.inverse_db(n * 3 % 256))
    product = F.zip_with("embedding", curve, lambda x, y: F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(x.cast("double") * y))
    return blocks(spark, sf).select("vec_id", F.posexplode(product).alias("i", "v")).withColumn("v", _r("v", 9) + 0.0)


@query(f"""with s as (select l_orderkey, l_linenumber, l, r, q, case when r > 0 and q > 0 then r when r > 0 then r + q when q > 0 then r else r - q end as b, case when r > 0 and q > 0 then r - q when r > 0 then r when q > 0 then r + q else r end as c from {PAIRS})
select l_orderkey, l_linenumber, case when l > 0 and b > 0 then l when l > 0 then l + b when b > 0 then l else l - b end as ch0, case when l > 0 and b > 0 then l - b when l > 0 then l when b > 0 then l + b else l end as ch1, c as ch2 from s""")
def g8_inverse_coupling(spark, sf):
    df = int_pairs(spark, sf).withColumn("s2", S.decouple(F.col("r"), F.col("q"))).withColumn("s1", S.decouple(F.col("l"), F.col("s2.l")))
    return df.select("l_orderkey", "l_linenumber", F.col("s1.l").alias("ch0"), F.col("s1.r").alias("ch1"), F.col("s2.r").alias("ch2"))


@query(f"""with b as (select label, row_number() over (partition by label, n order by vec_id) as k, vec_id, n, x from {SAMPLES})
select c.label, c.vec_id, cast(c.n as int) as i, round(c.x + p.x, 6) as v from b c join b p on p.label = c.label and p.k = c.k - 1 and p.n = c.n + 32 where c.n < 32""")
def g9_overlap_add(spark, sf):
    out = G.overlap_add(blocks(spark, sf), ["label"], "vec_id", "embedding")
    return out.select("label", "vec_id", F.posexplode("samples").alias("i", "v")).withColumn("v", _r("v"))


_PAGED = f"""(with p as (select serial, doc_id, size, row_number() over (partition by serial order by doc_id) as i, count(*) over (partition by serial) as n from {PACKETS})
select serial, doc_id, size, i, i = n as eos, case when i % 3 = 0 or i = n then sum(size) over (partition by serial order by i) - 70 - (case when i = n then 100 else 0 end) end as granule from p)"""


def _paged(spark, sf):
    w = Window.partitionBy("serial").orderBy("doc_id")
    p = packets(spark, sf).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("serial")), "sum": F.sum("size").over(w)})
    eos = F.col("i") == F.col("n")
    return p.select("serial", "doc_id", "size", eos.alias("eos"), F.when((F.col("i") % 3 == 0) | eos, F.col("sum") - 70 - F.when(eos, 100).otherwise(0)).alias("granule"))


@query(f"""select a.serial, a.doc_id, cast((select count(*) from {_PAGED} b where b.serial = a.serial and b.i < a.i and (b.granule is not null or b.eos)) as bigint) as page from {_PAGED} a""")
def h1_page_groups(spark, sf):
    return G.place(_paged(spark, sf), ["serial"], "doc_id", "size", "granule", "eos").select("serial", "doc_id", F.col("page").cast("long").alias("page"))


@query(f"""with p as materialized (select * from {_PAGED}), a as (select x.serial, x.doc_id, x.size, x.eos, x.granule, x.i, coalesce((select sum(y.size) from p y where y.serial = x.serial and y.i < x.i), 0) as raw from p x),
f as (select serial, min(i) as first from p where granule is not null group by serial),
s as (select a.*, a.raw + case when g.eos then 0 else g.granule - g.raw - g.size end as start from a join f using (serial) join a g on g.serial = a.serial and g.i = f.first),
e as (select s.*, l.i as li, l.granule as lg, coalesce((select max(y.i) from p y where y.serial = s.serial and y.i < l.i and y.granule is not null), 0) as before_last from s join (select serial, i, granule from p where eos) l using (serial))
select serial, doc_id, cast(greatest(start, 0) as bigint) as position, cast(greatest((case when i > before_last then least(start + size, lg) else start + size end) - greatest(start, 0), 0) as bigint) as kept from e""")
def h2_placement(spark, sf):
    return G.place(_paged(spark, sf), ["serial"], "doc_id", "size", "granule", "eos").select("serial", "doc_id", "position", "kept")


@query(f"select event_type, pos - 100 as pos, v from (select *, count(*) over (partition by event_type) as n from {SIGNAL}) where pos >= 100 and pos < n - 50")
def h3_trim(spark, sf):
    """100 samples cut in front and 50 at the end of each stream."""
    n = F.count("*").over(Window.partitionBy("event_type"))
    return signal(spark, sf).withColumn("n", n).where((F.col("pos") >= 100) & (F.col("pos") < F.col("n") - 50)).select("event_type", (F.col("pos") - 100).alias("pos"), "v")


@query(f"select cast(sum(granule) as bigint) as samples, count(*) as streams from (select serial, granule, row_number() over (partition by serial order by doc_id desc) as r from {_PAGED} where granule is not null) where r = 1")
def h6_declared_length(spark, sf):
    last = _paged(spark, sf).where("granule is not null").groupBy("serial").agg(F.max_by("granule", "doc_id").alias("g"))
    return last.agg(F.sum("g").cast("long").alias("samples"), F.count("*").alias("streams"))


def _crc_table() -> list[int]:
    """What each four bits shifted out of the checksum bring in."""
    out = []
    for x in range(16):
        c = x << 28
        for _ in range(4):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 & 1 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


@query(f"select doc_id, list_reduce(list_prepend(0::bigint, list_transform(regexp_extract_all(hex(encode(text)), '.'), lambda x: cast('0x' || x as bigint))), lambda c, x: xor((c << 4) & 4294967295, list_extract({_crc_table()}, cast(xor(c >> 28, x) as int) + 1))) as crc from documents")
def a4_page_crc(spark, sf):
    return ogg.checksums(packets(spark, sf), "doc_id", "data")


@query(f"select serial, row_number() over (partition by serial order by doc_id) - 1 as packet, size from {PACKETS}")
def a5_reassembly(spark, sf):
    laces = G.lacing(packets(spark, sf).select("serial", "doc_id", "size"), "size")
    return G.reassemble(laces, "serial", ["doc_id", "place"]).select("serial", F.col("packet").cast("long").alias("packet"), F.col("size").cast("long").alias("size"))


@query("""with e as (select event_type, event_id, row_number() over (partition by event_type order by event_id) as k, (4294967000 + event_id) % 4294967296 as seq from events)
select a.event_type, a.event_id, coalesce(b.seq + 1 - (case when b.seq = 4294967295 then 4294967296 else 0 end) <> a.seq, false) as gap from e a left join e b on b.event_type = a.event_type and b.k = a.k - 1""")
def a6_sequence_gap(spark, sf):
    pages = load(spark, sf, "events").select("event_type", "event_id", ((F.col("event_id") + 4294967000) % (1 << 32)).alias("seq"))
    return G.gaps(pages, "event_type", "event_id", "seq").select("event_type", "event_id", "gap")


@query("""select event_type, count(*) as pages, cast(sum(case when d > 1 then 1 else 0 end) as bigint) as lost from (select event_type, event_id - lag(event_id) over (partition by event_type order by event_id) as d from events) group by 1""")
def a7_damage_counts(spark, sf):
    pages = G.gaps(load(spark, sf, "events"), "event_type", "event_id", "event_id")
    return pages.groupBy("event_type").agg(F.count("*").alias("pages"), F.count_if("gap").alias("lost"))


@query(f"select doc_id, cast(place as int) as place, cast(case when place < size // 255 then 255 else size % 255 end as int) as lace from (select doc_id, size, unnest(range(size // 255 + 1)) as place from {PACKETS})")
def b2_lacing(spark, sf):
    return G.lacing(packets(spark, sf).select("doc_id", "size"), "size").select("doc_id", "place", "lace")


@query(f"select t.event_type, cast(p as bigint) as pos, coalesce(v, 0) as v from (select event_type, unnest(range(-10, count(*) + 10)) as p from events group by 1) t left join {SIGNAL} s on s.event_type = t.event_type and s.pos = p")
def i1_padded(spark, sf):
    """Each whole signal with ten samples of silence on both sides."""
    s = signal(spark, sf)
    grid = s.groupBy("event_type").agg(F.max("pos").alias("last")).select("event_type", F.explode(F.sequence(F.lit(-10).cast("long"), F.col("last") + 10)).alias("pos"))
    return grid.join(s, ["event_type", "pos"], "left").select("event_type", "pos", F.coalesce("v", F.lit(0.0)).alias("v"))


_ENERGY = f"(select event_type, pos // 64 as seg, sum(pow(v - coalesce(b, 0), 2)) as e from (select event_type, pos, v, lag(v) over (partition by event_type order by pos) as b from {SIGNAL}) group by 1, 2)"


@query(f"select event_type, seg, round(e, 6) as e from {_ENERGY}")
def i2_segment_energy(spark, sf):
    return G.segment_energy(signal(spark, sf), "event_type").withColumn("e", _r("e"))


@query(f"""with g as (select * from {_ENERGY}) select a.event_type, a.seg, a.e > 0.000064 and a.e > 12 * greatest(coalesce((select sum(b.e) from g b where b.event_type = a.event_type and b.seg between a.seg - 4 and a.seg - 1), 0) / 4, 0.0000064) as attack from g a""")
def i3_transient(spark, sf):
    return G.transients(G.segment_energy(signal(spark, sf), "event_type"), "event_type")


_TONAL = f"""(with p as materialized (select vec_id, k, x * x as pw from {SPECTRA}),
m as (select a.vec_id, a.k, a.pw, avg(b.pw) as mean from p a join p b on b.vec_id = a.vec_id and b.k between a.k - 8 and a.k + 8 group by 1, 2, 3),
r as (select vec_id, k, pw, mean, band, z, width, row_number() over (partition by vec_id, band order by pw desc, k) as rk, sum(pw) over (partition by vec_id, band) as energy from m join {BANDS} using (k)),
t as (select vec_id, band, z, width, energy, greatest(0.0, least(1.0, (10 * log10((pw + 1e-30) / (mean + 1e-30)) - 5) / 7)) as t from r where rk = 1)
select vec_id, band, z, width, energy, t * (14.5 + z) + (1 - t) * 5.5 as off from t)"""
_SPREAD = f"(with t as materialized {_TONAL} select a.vec_id, a.band, a.width, sum(case when att + b.off < 120 then b.energy * pow(10, -(att + b.off) / 10) else 0 end) as threshold from t a join t b using (vec_id), lateral (select case when a.z >= b.z then 10 * (a.z - b.z) else 25 * (b.z - a.z) end as att) group by 1, 2, 3)"
_MASK = f"(select vec_id, k, greatest(threshold / s.width, pow(10, (least(3.64 * pow(f, -0.8) - 6.5 * exp(-0.6 * pow(f - 3.3, 2)) + 0.001 * pow(f, 4), 110) - 96) / 10)) * pow(10, 0.4) as mask from {_SPREAD} s join {BANDS} using (band), lateral (select greatest((k + 0.5) * {_HZ!r}, 20) / 1000 as f))"


@query(f"select vec_id, cast(band as int) as band, round(off, 5) as off from {_TONAL}")
def i7_tonality(spark, sf):
    return G.tonality(_spectra(spark, sf), "vec_id", HALF, RATE).select("vec_id", "band", _r("offset", 5).alias("off"))


@query(f"select vec_id, cast(band as int) as band, round(threshold, 6) as threshold from {_SPREAD}")
def i8_spreading(spark, sf):
    return G.spread(G.tonality(_spectra(spark, sf), "vec_id", HALF, RATE), "vec_id").select("vec_id", "band", _r("threshold").alias("threshold"))


def _mask(spark, sf):
    return G.mask(G.spread(G.tonality(_spectra(spark, sf), "vec_id", HALF, RATE), "vec_id"), "vec_id", HALF, RATE, 4.0)


@query(f"select vec_id, cast(k as int) as bin, round(mask, 6) as mask from {_MASK}")
def i9_mask(spark, sf):
    return _mask(spark, sf).select("vec_id", "bin", _r("mask").alias("mask"))


@query(f"select vec_id, cast(k as int) as bin, cast(greatest(0, least(127, floor((255 + 10 * log10(12 * mask) / (-20 * log10(1.0649863e-07) / 255)) / 2))) as int) as target from {_MASK}")
def i10_floor_target(spark, sf):
    return _mask(spark, sf).select("vec_id", "bin", G.floor_target(F.col("mask")).alias("target"))


@query(f"""select vec_id, cast(x as int) as x, cast(least(cast(round(avg(t)) as int), min(t) + 2) as int) as target from (select vec_id, n, cast(floor(abs(x) * 1000) as int) % 128 as t from {SAMPLES}) s
join (values (0, 0, 4), (8, 4, 12), (16, 12, 24), (32, 24, 48), (64, 48, 64)) p(x, lo, hi) on n >= lo and n < hi group by 1, 2""")
def i11_region_mean(spark, sf):
    posts = [0, 8, 16, 32, 64]
    edges = [0, *((a + b) // 2 for a, b in zip(posts, posts[1:], strict=False)), 64]
    regions = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for x, lo, hi in zip(posts, edges, edges[1:], strict=False)))
    t = blocks(spark, sf).select("vec_id", F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 128).cast("int")).alias("t"))
    part = t.select("vec_id", "t", F.inline(regions)).select("vec_id", "x", F.slice("t", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("t"))
    mean = F.aggregate("t", F.lit(0), lambda a, v: a + v) / F.size("t")
    return part.select("vec_id", "x", F.least(F.round(mean, 0).cast("int"), F.array_min("t") + 2).alias("target"))


@query(f"select vec_id, cast(n as int) as i, cast(sign(x) * greatest(-7796, least(7796, floor(greatest(abs(x * 40) - 0.15, 0) + 0.5))) as bigint) as q from {SAMPLES}")
def i12_quantise(spark, sf):
    q = F.transform("embedding", lambda v: S.quantise(v.cast("double") * 40, F.lit(0.15)))
    return blocks(spark, sf).select("vec_id", F.posexplode(q).alias("i", "q"))


_CLASSED = f"(select l_orderkey // 32 as part, max(abs(q)) as top from (select l_orderkey, q // 8 as q from {PAIRS}) group by 1)"


@query(f"select part, cast(case when top <= 0 then 0 when top <= 1 then 1 when top <= 2 then 2 when top <= 4 then 3 when top <= 8 then 4 when top <= 16 then 5 when top <= 247 then 6 else 7 end as int) as class from {_CLASSED}")
def i14_class(spark, sf):
    top = int_pairs(spark, sf).groupBy(F.floor(F.col("l_orderkey") / 32).alias("part")).agg(F.max(F.abs(F.floor(F.col("q") / 8))).alias("top"))
    return top.select("part", S.residue_class(F.col("top")).alias("class"))


@query(f"select cast(c as int) as class, count(*) as n from (select case when abs(q) <= 0 then 0 when abs(q) <= 1 then 1 when abs(q) <= 2 then 2 when abs(q) <= 4 then 3 when abs(q) <= 8 then 4 when abs(q) <= 16 then 5 when abs(q) <= 247 then 6 else 7 end as c from {PAIRS}) group by 1")
def i15_class_histogram(spark, sf):
    return int_pairs(spark, sf).groupBy(S.residue_class(F.abs("q")).alias("class")).agg(F.count("*").alias("n"))


@query("select cast(q as int) as quality, cast(least(24000.0, greatest(11000.0, 13000 + 1250 * q)) as double) as lowpass, round(cast(4 - 1.6 * q as double), 6) as adjust_db, round(cast(0.2 - 0.01 * q as double), 6) as deadzone from range(-1, 11) t(q)")
def i16_parameter_curves(spark, sf):
    q = F.col("id").cast("double")
    return spark.range(-1, 11).select(F.col("id").cast("int").alias("quality"), F.least(F.lit(24000.0), F.greatest(F.lit(11000.0), 13000 + 1250 * q)).alias("lowpass"), _r(4 - 1.6 * q).alias("adjust_db"), _r(0.2 - 0.01 * q).alias("deadzone"))


def _requantised(spark, sf):
    x = signal(spark, sf)
    return x.withColumn("y", F.floor(F.col("v") * 128 + 0.5) / 128)


_REQ = f"(select *, floor(v * 128 + 0.5) / 128 as y from {SIGNAL})"


@query(f"select event_type, round(10 * log10(sum(v * v) / sum((v - y) * (v - y))), 6) as snr from {_REQ} group by 1")
def k1_snr(spark, sf):
    d = F.col("v") - F.col("y")
    return _requantised(spark, sf).groupBy("event_type").agg(_r(10 * F.log10(F.sum(F.col("v") * F.col("v")) / F.sum(d * d))).alias("snr"))


@query(f"select event_type, round(max(abs(v)), 6) as peak, round(10 * log10(avg(v * v)), 6) as rms_db, bool_and(isfinite(v)) as finite from {SIGNAL} group by 1")
def k2_levels(spark, sf):
    finite = ~F.isnan("v") & (F.abs("v") != float("inf"))
    return signal(spark, sf).groupBy("event_type").agg(_r(F.max(F.abs("v"))).alias("peak"), _r(10 * F.log10(F.avg(F.col("v") * F.col("v")))).alias("rms_db"), F.bool_and(finite).alias("finite"))


@query(f"select event_type, round(max(d), 6) as worst, round(sqrt(avg(d * d)), 6) as rms, round(count(*) filter (d <= 100) / count(*), 6) as share from (select event_type, abs(v - y) * 32768 as d from {_REQ}) group by 1")
def k3_lsb_error(spark, sf):
    df = _requantised(spark, sf).withColumn("d", F.abs(F.col("v") - F.col("y")) * 32768)
    return df.groupBy("event_type").agg(_r(F.max("d")).alias("worst"), _r(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rms"), _r(F.count_if(F.col("d") <= 100) / F.count("*")).alias("share"))


@query(f"select cast(case when size < 200 then 256 else 2048 end as int) as blocksize, count(*) as n from {PACKETS} group by 1")
def k5_block_histogram(spark, sf):
    return packets(spark, sf).groupBy(F.when(F.col("size") < 200, 256).otherwise(2048).alias("blocksize")).agg(F.count("*").alias("n"))


@query(f"select serial, round(sum(size) * 8 / (count(*) * 1024 / 44100.0) / 1000, 6) as kbps from {PACKETS} group by 1")
def k6_bit_rate(spark, sf):
    return packets(spark, sf).groupBy("serial").agg(_r(F.sum("size") * 8 / (F.count("*") * 1024 / 44100.0) / 1000).alias("kbps"))


@query("select source, cast(count(*) filter (b % 2 = 1) as bigint) as discarded from (select source, cast(('0x' || substring(hex(encode(text)), 1, 2)) as bigint) as b from documents) group by 1")
def k7_discarded(spark, sf):
    from spindrift.operators.floors import blocksize

    b = F.conv(F.hex(F.substring(F.encode("text", "utf-8"), 1, 1)), 16, 10).cast("int")
    return load(spark, sf, "documents").groupBy("source").agg(F.count_if(blocksize(b, [256, 2048]).isNull()).alias("discarded"))


@query("select doc_id, sha256(text) as digest from documents")
def k8_sha256(spark, sf):
    return packets(spark, sf).select("doc_id", F.sha2("data", 256).alias("digest"))
