"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def int_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer pairs and residue values, from lineitem."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_linenumber") - 4).cast("long").alias("l"),
        (F.col("l_partkey") % 81 - 40).alias("r"),
        (F.col("l_orderkey") * 7919 % 31185 - 15592).alias("q"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of 64 samples a row, from embeddings."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per event type: value / 512 in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_type", (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("value") / 512).alias("v"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each document, its whole text in UTF-8, by source as stream."""
    return load(spark, sf_dir, "documents").select(F.col("source").alias("serial"), "doc_id", F.octet_length("text").cast("long").alias("size"), F.encode("text", "utf-8").alias("data"))


PAIRS = "(select l_orderkey, l_linenumber, l_partkey, cast(l_linenumber - 4 as bigint) as l, l_partkey % 81 - 40 as r, l_orderkey * 7919 % 31185 - 15592 as q from lineitem)"
SAMPLES = "(select vec_id, label, unnest(range(64)) as n, cast(unnest(embedding) as double) as x from embeddings)"
SIGNAL = "(select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as pos, value / 512 as v from events)"
PACKETS = "(select source as serial, doc_id, cast(octet_length(encode(text)) as bigint) as size from documents)"
