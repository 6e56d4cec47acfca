"""The corpus operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import crosspoly, decontam, langid, licenses, packing, secrets, simhash, suffix, tokens, warc
from spindrift.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hits")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("all")


def op6_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_cross_polytope_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_winnowing_decontamination": op2_winnowing_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op3_license_diagonals": op3_license_diagonals,
    "op9_naive_bayes_language": op9_naive_bayes_language,
    "op10_secret_randomness": op10_secret_randomness,
    "op6_simple8b_tokens": op6_simple8b_tokens,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op5_cross_polytope_links": op5_cross_polytope_links,
    "op8_warc_salvage": op8_warc_salvage,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as g
       from (select item_id, w, least(10, len(w)) as n, unnest(range(len(w) - least(10, len(w)) + 1)) as s from i where len(w) > 0)),
dw as (select doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') as g
       from (select doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) as s from d cross join (select distinct n from iw))),
m as (select dw.doc_id, dw.s, dw.n, iw.item_id from dw join iw using (n, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from m) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from m group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

OP1_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
w as (select doc_id, s, md5(substr(h, 2 * s + 1, 800)) as m from (select doc_id, h, unnest(range(n - 399)) as s from d where n >= 400)),
t as (select doc_id, s from (select doc_id, s, count(*) over (partition by m) as c from w) where c > 1),
i as (select doc_id, s, sum(new) over (partition by doc_id order by s) as k from (select doc_id, s, case when s > lag(s) over (partition by doc_id order by s) + 400 then 1 else 0 end as new from t)),
p as (select doc_id, min(s) as a, max(s) + 400 as e from i group by doc_id, k),
g as (select doc_id, lag(e, 1, 0) over (partition by doc_id order by a) as a, a as e from p union all select doc_id, max(e), 9e15::bigint from p group by doc_id),
k as (select g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (least(e, n) - a)), '' order by a) as kept from g join d using (doc_id) group by g.doc_id),
x as (select doc_id, sum(e - a) as n_removed, count(*) as n_spans from p group by doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k.kept, d.h))) as kept_sha256
from d left join x using (doc_id) left join k using (doc_id)
"""

OP5_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v where list_inner_product(e, e) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) >= 0.9),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a)
select vec_id, cast((select count(*) from l where l.a = vec_id) as bigint) as n_links, c.component_id, vec_id = c.component_id as kept
from embeddings join (select a, min(b) as component_id from r group by a) c on c.a = vec_id
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {5 * i + 1}, 5) as bigint) >> {15 - 5 * j}) & 31 as bigint) + 1, 1)" for i in range(8) for j in range(4))
OP8_SQL = f"""
select page_id, n as payload_bytes, {_BASE32} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as n, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op5_cross_polytope_links": OP5_SQL,
    "op8_warc_salvage": OP8_SQL,
    "op2_winnowing_decontamination": OP2_SQL,
}
