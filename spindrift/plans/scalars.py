"""Queries of bit-level parsing, scalar functions, tables and spectral envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import scalar as S
from spindrift.operators import floors
from spindrift.plans.registry import PAIRS, SAMPLES, blocks, int_pairs, load, query

_BARK0 = "(13.1 * atan(0.00074 * ({x})) + 2.24 * atan(1.85e-8 * ({x}) * ({x})) + 0.0001 * ({x}))"
_BARK = "(13.0 * atan(0.00076 * ({x})) + 3.5 * atan(pow(({x}) / 7500.0, 2)))"
_DB = "(1.0649863e-07 * pow(1 / 1.0649863e-07, ({y}) / 255.0))"


def _r(c, n=6):
    return F.round(c, n)


@query(f"select l_orderkey, l_linenumber, l * l_partkey as x, cast(case when l * l_partkey <= 0 then 0 else floor(log2(l * l_partkey)) + 1 end as int) as bits from {PAIRS}")
def c4_ilog(spark, sf):
    x = F.col("l") * F.col("l_partkey")
    return int_pairs(spark, sf).select("l_orderkey", "l_linenumber", x.alias("x"), S.ilog(x).cast("int").alias("bits"))


_PACKED = "((l_partkey % 2) * 2147483648 + (770 + l_linenumber) * 2097152 + (l_orderkey * 31) % 2097152)"


@query(f"""select l_orderkey, l_linenumber, p as packed, v as value, round(log2(nullif(abs(v), 0)), 6) as size
from (select *, (case when p // 2147483648 = 1 then -1.0 else 1.0 end) * (p % 2097152) * pow(2.0, (p // 2097152) % 1024 - 788) as v from (select *, {_PACKED} as p from {PAIRS}))""")
def c5_float32_unpack(spark, sf):
    p = F.expr(_PACKED)
    return int_pairs(spark, sf).withColumn("packed", p).withColumn("value", S.float32_unpack(F.col("packed"))).select("l_orderkey", "l_linenumber", "packed", "value", _r(F.log2(F.abs("value"))).alias("size"))


@query(f"""select l_orderkey, l_linenumber, q / 64.0 as value,
cast(case when q = 0 then 0 else (case when q < 0 then 2147483648 else 0 end) + (floor(log2(abs(q))) - 6 + 768) * 2097152 + abs(q) * pow(2, 20 - floor(log2(abs(q)))) end as bigint) as packed, q / 64.0 as back from {PAIRS}""")
def c5_float32_pack(spark, sf):
    df = int_pairs(spark, sf).withColumn("value", F.col("q") / 64.0).withColumn("packed", S.float32_pack(F.col("value")))
    return df.select("l_orderkey", "l_linenumber", "value", "packed", S.float32_unpack(F.col("packed")).alias("back"))


@query(f"select l_orderkey, l_linenumber, l_partkey as entries, cast(l_linenumber % 5 as int) as dims, case when l_linenumber % 5 = 0 then 0 else (select max(r) from range(0, 2100) t(r) where pow(r, l_linenumber % 5) <= l_partkey) end as r from {PAIRS}")
def c6_lookup1(spark, sf):
    df = int_pairs(spark, sf).withColumn("dims", (F.col("l_linenumber") % 5).cast("int"))
    return df.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("entries"), "dims", S.lookup1_values(F.col("l_partkey"), F.col("dims")).alias("r"))


_HZ = "l_extendedprice"


@query(f"select l_orderkey, l_linenumber, round({_BARK0.format(x=_HZ)}, 6) as z from lineitem")
def c7_bark_floor(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(S.bark_floor(F.col(_HZ))).alias("z"))


@query(f"select l_orderkey, l_linenumber, round({_BARK.format(x=_HZ)}, 6) as z from lineitem")
def c8_bark_psy(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(S.bark(F.col(_HZ))).alias("z"))


@query("select l_orderkey, l_linenumber, round(3.64 * pow(k, -0.8) - 6.5 * exp(-0.6 * pow(k - 3.3, 2)) + 0.001 * k * k * k * k, 3) as db from (select *, greatest(l_extendedprice / 10, 20.0) / 1000 as k from lineitem)")
def c9_ath(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(S.ath_db(F.col("l_extendedprice") / 10), 3).alias("db"))


@query(f"select cast(y as int) as y, round({_DB.format(y='y')} * 1e6, 4) as micro from range(256) t(y)")
def c10_inverse_db(spark, sf):
    return spark.range(256).select(F.col("id").cast("int").alias("y"), _r(S.inverse_db(F.col("id")) * 1e6, 4).alias("micro"))


@query("select round(-20 * log10(1.0649863e-07) / 255, 9) as step_db")
def c11_step_db(spark, sf):
    return spark.range(1).select(_r(S.step_db(), 9).alias("step_db"))


@query("select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 256 when 1 then 128 when 2 then 86 else 64 end as span from lineitem")
def c12_ranges(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.floor_range(F.col("l_linenumber") % 4 + 1).alias("span"))


@query(f"select l_orderkey, l_linenumber, y0 + (y1 - y0) * (x - x0) // (x1 - x0) as y from (select *, 0 as x0, 100 + l_linenumber as x1, r + 40 as y0, l_partkey % 97 as y1, l_orderkey % 100 as x from {PAIRS})")
def c13_render_point(spark, sf):
    df = int_pairs(spark, sf).withColumns({"x1": (F.col("l_linenumber") + 100).cast("long"), "y0": F.col("r") + 40, "y1": F.col("l_partkey") % 97, "x": F.col("l_orderkey") % 100})
    return df.select("l_orderkey", "l_linenumber", S.render_point(F.lit(0), F.col("y0"), F.col("x1"), F.col("y1"), F.col("x")).alias("y"))


@query("""with recursive s as (select s_suppkey, s_nationkey as y0, cast(s_suppkey % 60 as int) as y1, cast(10 + s_suppkey % 37 as int) as adx from supplier),
t as (select s_suppkey, y0, y1, adx, 0 as x, y0 as y, 0 as err from s
union all select s_suppkey, y0, y1, adx, x + 1,
  y + (case when y1 < y0 then -1 else 1 end) * (abs(y1 - y0) // adx + case when err + abs(y1 - y0) % adx >= adx then 1 else 0 end),
  err + abs(y1 - y0) % adx - case when err + abs(y1 - y0) % adx >= adx then adx else 0 end from t where x + 1 < adx)
select s_suppkey, x, y from t""")
def c14_render_line(spark, sf):
    df = load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("y0"), (F.col("s_suppkey") % 60).cast("int").alias("y1"), (10 + F.col("s_suppkey") % 37).cast("int").alias("adx"))
    return floors.render_lines(df, "adx", "y0", "y1").select("s_suppkey", "x", F.col("y").cast("int").alias("y"))


_LIST = "(select p_brand, p_size as v, row_number() over (partition by p_brand order by k) - 1 as i from (select p_brand, p_size, min(p_partkey) as k from part group by p_brand, p_size))"


@query(f"""select a.p_brand, cast(a.i as int) as i, cast(a.v as int) as v,
cast((select b.i from {_LIST} b where b.p_brand = a.p_brand and b.i < a.i and b.v < a.v order by b.v desc limit 1) as int) as low,
cast((select b.i from {_LIST} b where b.p_brand = a.p_brand and b.i < a.i and b.v > a.v order by b.v limit 1) as int) as high from {_LIST} a""")
def c15_neighbors(spark, sf):
    part = load(spark, sf, "part").groupBy("p_brand", F.col("p_size").alias("v")).agg(F.min("p_partkey").alias("k"))
    posts = part.withColumn("i", (F.row_number().over(Window.partitionBy("p_brand").orderBy("k")) - 1).cast("int")).select("p_brand", "i", F.col("v").cast("int").alias("v"))
    return floors.neighbors(posts, "p_brand")


@query(f"""select l_orderkey, l_linenumber, case when l > 0 and r > 0 then l when l > 0 then l + r when r > 0 then l else l - r end as dl,
case when l > 0 and r > 0 then l - r when l > 0 then l when r > 0 then l + r else l end as dr from {PAIRS}""")
def c16_decouple(spark, sf):
    d = S.decouple(F.col("l"), F.col("r"))
    return int_pairs(spark, sf).select("l_orderkey", "l_linenumber", d["l"].alias("dl"), d["r"].alias("dr"))


@query(f"""select l_orderkey, l_linenumber, case when abs(l) > abs(r) then l else r end as m,
case when abs(l) > abs(r) then (case when l > 0 then l - r else r - l end) else (case when r > 0 then l - r else r - l end) end as a, l as back_l, r as back_r from {PAIRS}""")
def c17_couple(spark, sf):
    df = int_pairs(spark, sf).withColumn("c", S.couple(F.col("l"), F.col("r"))).withColumn("b", S.decouple(F.col("c.m"), F.col("c.a")))
    return df.select("l_orderkey", "l_linenumber", "c.m", "c.a", F.col("b.l").alias("back_l"), F.col("b.r").alias("back_r"))


@query(f"""select l_orderkey, l_linenumber, passes, g as s0, case when passes = 1 then 0 when passes = 2 then q - g else 33 * f end as s1, case when passes = 3 then q - g - 33 * f else 0 end as s2
from (select *, cast(greatest(-7, least(7, round((q - g) / 33.0))) as bigint) as f from (select *, cast(case passes when 1 then q when 2 then 33 * greatest(-7, least(7, round(q / 33.0))) else 495 * greatest(-31, least(31, round(q / 495.0))) end as bigint) as g
from (select *, cast(1 + l_linenumber % 3 as int) as passes from {PAIRS})))""")
def c18_split(spark, sf):
    df = int_pairs(spark, sf).withColumn("passes", (1 + F.col("l_linenumber") % 3).cast("int")).withColumn("s", S.split(F.col("q"), F.col("passes")))
    return df.select("l_orderkey", "l_linenumber", "passes", *(F.col("s")[i].alias(f"s{i}") for i in range(3)))


@query(f"select l_orderkey, l_linenumber, round(1 / exp(abs(r) / 9.5), 6) as w from {PAIRS}")
def c19_laplace(spark, sf):
    return int_pairs(spark, sf).select("l_orderkey", "l_linenumber", _r(S.laplace(F.col("r"), F.lit(9.5))).alias("w"))


@query("""select doc_id, v from (select doc_id, unnest(['SOURCE=' || source, 'Lang=' || lang, 'lang=' || lang || '=x', 'lang']) as c from documents) t, lateral (select substring(c, strpos(c, '=') + 1) as v, lower(substring(c, 1, greatest(strpos(c, '=') - 1, 0))) as k) where k = 'lang' and strpos(c, '=') > 0""")
def c20_comment_get(spark, sf):
    tags = F.array(F.concat(F.lit("SOURCE="), "source"), F.concat(F.lit("Lang="), "lang"), F.concat(F.lit("lang="), "lang", F.lit("=x")), F.lit("lang"))
    return load(spark, sf, "documents").select("doc_id", F.explode(S.comment_values(tags, "LANG")).alias("v"))


@query(f"select vec_id, cast((n % 32) * 2 + n // 32 as int) as i, round(x, 6) as x from {SAMPLES}")
def c21_interleave(spark, sf):
    planar = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return blocks(spark, sf).select("vec_id", F.posexplode(S.interleave(planar, F.lit(32))).alias("i", "x")).withColumn("x", _r(F.col("x").cast("double")))


@query(f"select l_orderkey, l_linenumber, case when l = 0 or (r < 0 and l_linenumber = 1) then 0.0 else cast(r as double) end as v from {PAIRS}")
def c22_scrub(spark, sf):
    v = F.when(F.col("l") == 0, F.lit(float("nan"))).when((F.col("r") < 0) & (F.col("l_linenumber") == 1), F.lit(float("-inf"))).otherwise(F.col("r").cast("double"))
    return int_pairs(spark, sf).select("l_orderkey", "l_linenumber", S.scrub(v).alias("v"))


@query(f"""select l_orderkey, l_linenumber, cast(d as int) as d, cast(0.5 + 2.0 * (case ((l_partkey % 81) // cast(pow(3, d) as bigint)) % 3 when 0 then 0 when 1 then 1 else 3 end) as double) as plain,
cast(0.5 * (d + 1) + 2.0 * sum(case ((l_partkey % 81) // cast(pow(3, d) as bigint)) % 3 when 0 then 0 when 1 then 1 else 3 end) over (partition by l_orderkey, l_linenumber, l_partkey, rid order by d) as double) as seq
from (select *, row_number() over () as rid from {PAIRS}), range(4) t(d)""")
def e3_vq_vector(spark, sf):
    entry = F.col("l_partkey") % 81
    both = F.arrays_zip(floors.vq_vector(entry, [0, 1, 3], 4, 0.5, 2.0, False).alias("plain"), floors.vq_vector(entry, [0, 1, 3], 4, 0.5, 2.0, True).alias("seq"))
    return int_pairs(spark, sf).select("l_orderkey", "l_linenumber", F.posexplode(both).alias("d", "x")).select("l_orderkey", "l_linenumber", "d", "x.*")


@query("select event_id, cast(event_id % 3 = 1 as boolean) as long_block, case event_id % 3 when 1 then 7 else 3 end as residue from events where event_id % 3 < 2")
def e5_mode_join(spark, sf):
    modes = spark.createDataFrame([(0, False, 0), (1, True, 1)], "mode int, long_block boolean, mapping int")
    maps = spark.createDataFrame([(0, 3), (1, 7)], "mapping int, residue int")
    packets = load(spark, sf, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("mode"))
    return packets.join(F.broadcast(modes), "mode").join(F.broadcast(maps), "mapping").select("event_id", "long_block", "residue")


@query("select label, vec_id // 2 as pair, bool_or(embedding[1] > 0) as used from embeddings group by 1, 2")
def e9_nonzero(spark, sf):
    return blocks(spark, sf).groupBy("label", F.floor(F.col("vec_id") / 2).alias("pair")).agg(F.bool_or(F.col("embedding")[0] > 0).alias("used"))


@query("select doc_id, case when b % 2 = 1 then null when (b // 2) % 4 = 3 then null when (b // 2) % 2 = 1 then 2048 else 256 end as blocksize from (select doc_id, cast(('0x' || substring(hex(encode(text)), 1, 2)) as bigint) as b from documents)")
def e10_blocksize_peek(spark, sf):
    b = F.conv(F.hex(F.substring(F.encode("text", "utf-8"), 1, 1)), 16, 10).cast("int")
    return load(spark, sf, "documents").select("doc_id", floors.blocksize(b, [256, 2048, 256]).alias("blocksize"))


@query(f"""select p_partkey, cast(x as int) as x, round({_DB.format(y='greatest(0, least(255, y))')}, 6) as amp from (
select p_partkey, x, case when x < 32 then a + (case when b < a then -1 else 1 end) * (abs(b - a) * x // 32) when x < 64 then b + (case when c < b then -1 else 1 end) * (abs(c - b) * (x - 32) // 32) else c end as y
from (select p_partkey, 2 * (p_size * 2) as a, 2 * (p_partkey % 120) as b, 2 * (p_partkey % 77) as c from part), range(80) t(x))""")
def f2_floor_curve(spark, sf):
    part = load(spark, sf, "part")
    posts = part.select("p_partkey", F.inline(F.array(*(F.struct(F.lit(x).alias("x"), (y * 2).cast("long").alias("y")) for x, y in ((0, F.col("p_size") * 2), (32, F.col("p_partkey") % 120), (64, F.col("p_partkey") % 77))))))
    return floors.curve(posts, ["p_partkey"], 80).select("p_partkey", "x", _r(S.inverse_db(F.col("y"))).alias("amp"))


@query(f"""select l_orderkey, l_linenumber, cast(t as int) as t, cast(t as int) as back from (select *, l_partkey % 128 as t from {PAIRS})""")
def f3_floor_inverse(spark, sf):
    df = int_pairs(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 128).cast("int").alias("t"), (F.col("l_orderkey") % 128).cast("int").alias("p"))
    coded = floors.encode_value(F.col("t"), F.col("p"), F.lit(128))
    return df.withColumn("v", coded).select("l_orderkey", "l_linenumber", "t", floors.decode_value(F.col("v"), F.col("p"), F.lit(128)).cast("int").alias("back"))


@query(f"select cast(n as int) as n, cast(i as int) as i, cast(least(255, floor({_BARK0.format(x='44100.0 * i / (2.0 * n)')} * (256 / {_BARK0.format(x='22050.0')}))) as int) as m from (select unnest([64, 256]) as n) t, range(256) r(i) where i < n")
def f4_bark_map(spark, sf):
    sizes = spark.createDataFrame([(64,), (256,)], "n int")
    return floors.bark_map(sizes, 44100, 256)


@query(f"""select cast(i as int) as i, round((1 - cw) / 2 * 4 * pow(cos(0.9) - cw, 2) * 4 * pow(cos(2.1) - cw, 2) + (1 + cw) / 2 * 4 * pow(cos(0.4) - cw, 2) * 4 * pow(cos(1.6) - cw, 2), 6) as even,
round((1 - cw * cw) * 4 * pow(cos(0.9) - cw, 2) + 0.25 * 4 * pow(cos(0.4) - cw, 2) * 4 * pow(cos(1.6) - cw, 2), 6) as odd from (select i, cos(pi() * i / 256) as cw from range(256) t(i))""")
def f5_lsp_response(spark, sf):
    w = math.pi * F.col("id") / 256
    return spark.range(256).select(F.col("id").cast("int").alias("i"), _r(floors.lsp_response([0.4, 0.9, 1.6, 2.1], w)).alias("even"), _r(floors.lsp_response([0.4, 0.9, 1.6], w)).alias("odd"))


@query(f"""with m as (select i, least(255, floor({_BARK0.format(x='44100.0 * i / 128.0')} * (256 / {_BARK0.format(x='22050.0')}))) as m from range(64) t(i)),
c as (select i, m, cos(pi() * m / 256) as cw from m),
p as (select i, (1 - cw) / 2 * 4 * pow(cos(0.9) - cw, 2) * 4 * pow(cos(2.1) - cw, 2) + (1 + cw) / 2 * 4 * pow(cos(0.4) - cw, 2) * 4 * pow(cos(1.6) - cw, 2) as pq from c)
select cast(a as int) as amplitude, cast(i as int) as i, round(exp(0.11512925 * (a * 100 / (63 * sqrt(pq)) - 100)), 4) as value from p, range(0, 64, 21) t(a)""")
def f6_lsp_curve(spark, sf):
    sizes = spark.createDataFrame([(64,)], "n int")
    frames = spark.range(0, 64, 21).select(F.col("id").cast("int").alias("amplitude"))
    return floors.lsp_curve(frames, floors.bark_map(sizes, 44100, 256), [0.4, 0.9, 1.6, 2.1], 256, 6, 100).select("amplitude", "i", _r(F.col("value"), 4).alias("value"))
