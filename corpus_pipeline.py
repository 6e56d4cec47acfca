"""Documents to packed training sequences, each stage one corpus operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet to the shared folder and reads it again for the next one. All stages
but the last return the columns of documents, and stay whole-table at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontam, langid, packing, secrets, simhash
from spindrift.llm.common import table, written

#: Bits of a bitmap, as bitmap_construct_agg makes them.
_BITMAP = 1 << 15


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of docs has it, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text, or no letter in it. Which language
    it is decides nothing. Learns from all labelled rows; without any, letters decide alone.
    Repeated rows and rows with a null id are judged each on their own and all kept or all
    dropped alike; columns of any other name pass through."""
    cols = docs.columns
    lang, score = _fresh(docs, "lang_pred", "score")
    named = langid.predict(docs, langid.fit(docs) or langid.ANY, names=(lang, score))
    return named.where(F.col(lang) != langid.UNKNOWN).select(*cols)


def _text_key() -> Column:
    """Names a row's text: what a stage decides by text holds for the row whatever its id."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _bit(doc_id: Column, parts: int) -> tuple[Column, Column]:
    """An id's part and place among ``parts`` bitmaps."""
    h = F.pmod(F.xxhash64(doc_id), F.lit(parts * _BITMAP))
    return F.floor(h / _BITMAP), h % _BITMAP


def _split(docs: DataFrame, ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose doc_id may be among the n ``ids(doc_id)``, at most one in 16
    of them for nothing, and rows whose id is not among them, or null. The ids go along as
    bitmaps, two bytes an id, so a text isn't shuffled to learn it unless those are too large
    to broadcast; each part reads docs once."""
    part, bits = _fresh(docs, "part", "bits")
    parts = max(1, -(-16 * n // _BITMAP))
    own, place = _bit(F.col("doc_id"), parts)
    maps = written(ids.select(own.alias(part), place.alias("place")).groupBy(part).agg(F.bitmap_construct_agg("place").alias(bits)), "bitmaps")
    byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.col("doc_id").isNotNull() & (F.call_function("getbit", byte, (place % 8).cast("int")) == 1), F.lit(False))
    both = docs.withColumn(part, own).join(maps, part, "left")
    return both.where(hit).select(*docs.columns), both.where(~hit).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, one row of
    it where rows repeat or texts of the group share that id, and every document whose
    id is null. Texts of other groups with the same id are documents of their own.
    Groups are those of op4's contract, so copies beyond 2 of 64 bits stay (see README).
    Columns of any other name pass through. Rows that are alone in their group stay where
    they are; only the others are joined with their group's decision."""
    key, kept, kept_key = _fresh(docs, "text_key", "kept_id", "kept_key")
    groups = simhash.simhash_groups(docs.select("doc_id", "text", _text_key().alias(key)), carry=(key,)).where("doc_id is not null")
    groups = written(groups.select("doc_id", key, "group"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", key)).alias("first"), F.count("*").alias("n"))
    first = written(first.select("group", F.col("first.doc_id").alias(kept), F.col(f"first.{key}").alias(kept_key), "n"), "first")
    several = first.where("n > 1")
    n = several.agg(F.sum("n")).first()[0] or 0
    some, alone = _split(docs, groups.join(several.select("group"), "group").select("doc_id"), n)
    first = first.select(kept, kept_key)
    single = some.withColumn(key, _text_key()).join(first, (F.col("doc_id") == F.col(kept)) & (F.col(key) == F.col(kept_key))).drop(kept, kept_key)
    return single.dropDuplicates(["doc_id", key]).drop(key).unionByName(alone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, each by its own text:
    rows that share an id, or whose id is null, are judged apart, and repeated rows
    all go or all stay. Columns of any other name pass through."""
    key, hit_key = _fresh(docs, "text_key", "hit_key")
    keyed = docs.withColumn(key, _text_key())
    hit = decontam.decontaminate(keyed.select("text", key), table(spark, sf_dir, "benchmark"), id_col=key).where("contaminated").select(F.col("doc_id").alias(hit_key)).distinct()
    return keyed.join(hit, F.col(key) == F.col(hit_key), "left_anti").drop(key)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and keeps all documents, repeated rows and rows with
    a null id included. n_chars follows where the text changed; other columns stay."""
    (spans,) = _fresh(docs, "spans")
    found = secrets.scan(docs, carry=True).select("row.*", F.col("all").alias(spans))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and place in it. Repeated rows
    are packed each on their own; a null text is its end id alone; a null id is kept."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Naive Bayes, XXH64 and the tokenizer are beyond SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
