"""Queries of the container and the codec as wholes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.encoder import Config
from spindrift.operators import decode as D
from spindrift.operators import encode as E
from spindrift.plans.registry import SIGNAL, load, query, signal
from spindrift.sources import ogg


def _side_by_side(df: DataFrame, column: str, size: int = 1 << 25) -> DataFrame:
    """The same rows, each run of that many bytes sorted by a column, so that files which
    they are written to can pack what repeats. Nothing is dealt, and no more than a run held."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.nbytes
            if n >= size:
                out, held, n = pa.Table.from_batches(held).sort_by(column), [], 0
                yield from out.to_batches(10_000)
                del out
        if held:
            yield from pa.Table.from_batches(held).sort_by(column).to_batches(10_000)

    return df.mapInArrow(run, df.schema)


@query("select cast(doc_id as varchar) as source, unnest(range(len(p))) as packet, sha256(unnest(p)) as digest from (select doc_id, string_split(text, ' ') as p from documents)")
def a3_ogg_round_trip(spark, sf):
    """A stream for each document, its words as packets: to pages, to files, and back."""
    # a text is dealt once, its words and their pages stay where it is
    texts = load(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    words = texts.select(F.col("doc_id").cast("string").alias("source"), F.lit(1).cast("long").alias("serial"), F.posexplode(F.split("text", " ", -1)).alias("packet", "word"))
    rows = words.select("source", "serial", F.col("packet").cast("long").alias("packet"), F.lit(0).cast("long").alias("granule"), F.lit(False).alias("flush"), F.encode("word", "utf-8").alias("data"))
    found = ogg.packets_in(ogg.files_of(rows, 1000, placed=True), strict=True)
    return _side_by_side(found.select("source", "packet", "data"), "data").select("source", "packet", F.sha2("data", 256).alias("digest"))


def _streams(spark, sf):
    x = signal(spark, sf).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    mono = F.transform("s", lambda p: p["v"].cast("float"))
    return x.select(F.col("event_type").alias("source"), F.lit(7).cast("long").alias("serial"), F.array(mono).alias("samples"))


@query(f"select event_type as source, 0 as chan, 0 as first, count(*) as samples from {SIGNAL} group by 1")
def g11_decode_length(spark, sf):
    """What is encoded decodes to its own length, without gaps."""
    files = E.ogg_files(_streams(spark, sf), Config(8000, 1, 5.0))
    pcm = D.decode(ogg.packets_in(files, strict=True), strict=True)
    return pcm.groupBy("source", "chan").agg(F.min("position").cast("int").alias("first"), F.sum(F.size("samples")).alias("samples"))
