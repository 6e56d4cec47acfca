"""Whole files: chained links to one PCM stream, and files from signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import audio
from spindrift.functions.codebook import Invalid
from spindrift.functions.encoder import Config
from spindrift.operators.decode import decode
from spindrift.operators.encode import ogg_pages
from spindrift.sources import ogg

LINKS = "source string, link int, serial long, first long, last long"


def links(packets: DataFrame, alike: bool = False) -> DataFrame:
    """LINKS of PACKETS: the audio streams of each file that follow one another, with
    their first and last packet. A link begins with this codec's first header while no
    other is live, and ends with its stream; what begins beside it is no link. With alike,
    links of a file that differ in rate or channels are an error. Only packets at either
    end of a stream are grouped by file."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page", "packet"])
        rows, live, kinds = [], None, set()
        for serial, packet, bos, eos, starts, kind in zip(*(frame[c] for c in ("serial", "packet", "bos", "eos", "starts", "kind")), strict=True):
            if bos and starts and live is None:
                live = serial
                kinds.add(bytes(kind))
                rows.append([key[0], len(rows), serial, packet, None])
            if eos and live == serial:
                rows[-1][4], live = packet, None
        if alike and len(kinds) > 1:
            raise Invalid(f"links of {key[0]} differ in rate or channels")
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in LINKS.split(", ")])
        out["last"] = out["last"].astype("Int64")
        return out

    ends = packets.where("bos or eos").select("source", "serial", "page", "packet", "bos", "eos", (F.substring("data", 1, 7) == F.lit(b"\1" + audio.MAGIC)).alias("starts"), F.substring("data", 12, 5).alias("kind"))
    return ends.groupBy("source").applyInPandas(run, LINKS)


def linked(packets: DataFrame, alike: bool = False) -> DataFrame:
    """The packets of links, numbered from 0 in each, with the column link. Packets that
    begin a stream but not the link are dropped: they are no audio."""
    own = packets.join(links(packets, alike), ["source", "serial"]).where((F.col("packet") >= F.col("first")) & (F.col("last").isNull() | (F.col("packet") <= F.col("last"))))
    return own.withColumn("packet", F.col("packet") - F.col("first")).where("packet = 0 or not bos").drop("first", "last")


def concatenated(pcm: DataFrame) -> DataFrame:
    """Adds at, the place in the file: links follow one another without gaps."""
    before = Window.partitionBy("source", "chan").orderBy("link", "packet").rowsBetween(Window.unboundedPreceding, -1)
    return pcm.withColumn("at", F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)).cast("long"))


def decode_pages(pages: DataFrame, strict: bool) -> DataFrame:
    """(source, link, serial, chan, packet, rate, position, samples, at) of PAGES."""
    return concatenated(decode(linked(ogg.packets_of(pages, strict), alike=True), strict))


def decode_files(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """(source, link, serial, chan, packet, rate, position, samples, at) of (source, content):
    position counts in the link, at in the file. FAILFAST raises on damage; links that
    differ in rate or channels always do."""
    strict = {"PERMISSIVE": False, "FAILFAST": True}[mode]
    return decode_pages(ogg.pages_of(files, strict), strict)


def read_ogg(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """decode_files() of all .ogg files below path, of any size."""
    return decode_pages(ogg.ogg_pages(spark, path, mode, "*.ogg"), {"PERMISSIVE": False, "FAILFAST": True}[mode])


def write_ogg(streams: DataFrame, path: str, config: Config) -> None:
    """Codes (source, serial, samples) and writes a file for each source, page by page."""
    from spindrift.sources.sink import write_pages

    write_pages(ogg_pages(streams, config), path)
