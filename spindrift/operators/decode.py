"""Packets to PCM: parallel over packets, then overlap-add and placement as windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import audio, batch
from spindrift.functions.codebook import Invalid
from spindrift.operators import signals

#: Packets that one task decodes together at least.
CHUNK = 64
BLOCKS = "source string, link int, serial long, packet long, granule long, eos boolean, rate long, chan int, samples array<float>"


def stream_headers(packets: DataFrame) -> DataFrame:
    """(source, link, serial, identification, comment, setup, last) of the streams that begin
    with this codec's header; last is the number of the last packet."""
    first = packets.select("source", "link", "serial", "packet", F.when(F.col("packet") < 3, F.col("data")).alias("data")).groupBy("source", "link", "serial").agg(
        F.max(F.when(F.col("packet") == 0, F.col("data"))).alias("identification"), F.max(F.when(F.col("packet") == 1, F.col("data"))).alias("comment"), F.max(F.when(F.col("packet") == 2, F.col("data"))).alias("setup"), F.max("packet").alias("last")
    )
    return first.where(F.substring("identification", 1, 7) == F.lit(b"\1" + audio.MAGIC))


def decode_blocks(packets: DataFrame, strict: bool = False) -> DataFrame:
    """BLOCKS: a row per audio packet and channel. Setup is parsed once per worker and
    stream. Packets may have the column link (from files.linked), else a stream is one."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.float32())]

    def run(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(9)]
            streams: dict[tuple[bytes, bytes], list[int]] = {}
            for i, key in enumerate(zip(cols[7], cols[8], strict=True)):
                streams.setdefault(key, []).append(i)
            found: dict[int, tuple[int, list]] = {}
            for key, own in streams.items():
                try:
                    ident, _ = audio.headers(*key)
                except (Invalid, TypeError):
                    if strict:
                        raise
                    continue
                for i, block in zip(own, batch.decode_packets(*key, [cols[6][i] or b"" for i in own]), strict=True):
                    if block is None and strict and cols[6][i]:
                        raise Invalid(f"packet {cols[3][i]} of stream {cols[2][i]} is no audio")
                    # without a block, the row keeps the packet's place on the page
                    found[i] = ident.rate, [None] * ident.channels if block is None else block
            rows = [(*(c[i] for c in cols[:6]), found[i][0], c, x) for i in sorted(found) for c, x in enumerate(found[i][1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    if "link" not in packets.columns:
        packets = packets.withColumn("link", F.lit(0))
    keys = ["source", "link", "serial", "chunk"]
    heads = stream_headers(packets).select("source", "link", "serial", "identification", "setup", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / CHUNK))).alias("chunk"))
    # runs of packets are dealt anew, so that one long stream is decoded by many tasks; a fixed
    # number of tasks, since by their bytes packets are few where by their work they aren't
    tasks = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packets.where("packet >= 3").withColumn("chunk", F.floor(F.col("packet") / CHUNK)).repartition(tasks, *keys)
    own = dealt.join(heads, keys)
    return own.select("source", "link", "serial", "packet", "granule", "eos", "data", "identification", "setup").mapInArrow(run, BLOCKS)


def decode(packets: DataFrame, strict: bool = False) -> DataFrame:
    """(source, link, serial, chan, packet, rate, position, samples): PCM in its place on the
    time axis. Packets that aren't audio leave the overlap as it was; granule positions
    anchor the first page and cut the last."""
    blocks = decode_blocks(packets, strict)
    keys = ["source", "link", "serial", "chan"]
    # one row goes through all of it, so that no packet is decoded twice
    pcm = signals.overlap_add(blocks, keys, "packet", "samples", ("granule", "eos", "rate"), keep=True)
    held = pcm.withColumn("n", F.coalesce(F.greatest(F.size("samples"), F.lit(0)), F.lit(0)))
    out = signals.place(held, keys, "packet", "n", "granule", "eos", ("rate", "samples")).where("kept > 0")
    return out.select(*keys, "packet", "rate", "position", F.slice("samples", (F.col("skip") + 1).cast("int"), F.col("kept").cast("int")).cast("array<float>").alias("samples"))
