"""PCM to Ogg: plan each stream's blocks, code blocks in parallel, paginate."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import encoder as E
from spindrift.sources import ogg
from spindrift.sources.pcm import from_planar, planar

PLANNED = "source string, serial long, packet long, granule long, is_long boolean, before boolean, after boolean, samples array<array<float>>"
PACKETS = "source string, serial long, packet long, granule long, flush boolean, data binary"


@lru_cache(maxsize=8)
def _encoder(config: E.Config) -> E.Encoder:
    return E.Encoder(config)


def plan_blocks(streams: DataFrame) -> DataFrame:
    """PLANNED of (source, serial, samples array<array<float>> by channel). Non-finite samples count as 0."""
    names = [c.split()[0] for c in PLANNED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches):
        for b in batches:
            for source, serial, samples in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), from_planar(b.column(2)), strict=True):
                x = np.nan_to_num(samples, nan=0.0, posinf=0.0, neginf=0.0)
                blocks, total = E.plan(x), x.shape[1]
                for first in range(0, len(blocks), 256):
                    own = blocks[first : first + 256]
                    rows = [(source, serial, k + 3, min(c, total), bool(long_), bool(before), bool(after)) for k, (c, long_, before, after) in enumerate(own, first)]
                    cut = [E.cut(x, c, E.BLOCKSIZES[long_]) for c, long_, _, _ in own]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)), planar(cut)], names=names)

    return streams.select("source", "serial", "samples").mapInArrow(run, PLANNED)


def encode(streams: DataFrame, config: E.Config) -> DataFrame:
    """PACKETS of all streams: three headers, then a packet per block, whose granule
    position is its block's centre or, for the last, the input's length."""

    def run(batches):
        enc = _encoder(config)
        for b in batches:
            flags = (b.column(k).to_pylist() for k in (4, 5, 6))
            data = enc.blocks(list(zip(from_planar(b.column(7)), *flags, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([False] * len(data)), pa.array(data, pa.binary())], names=["source", "serial", "packet", "granule", "flush", "data"])

    # blocks are dealt anew, so that one long stream is coded by many tasks
    tasks = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    audio = plan_blocks(streams).repartition(tasks, "source", "serial", F.floor(F.col("packet") / 64)).mapInArrow(run, PACKETS)
    heads = [(k, k != 1, h) for k, h in enumerate(_encoder(config).headers())]
    head = F.array(*(F.struct(F.lit(k).cast("long").alias("packet"), F.lit(0).cast("long").alias("granule"), F.lit(f).alias("flush"), F.lit(h).alias("data")) for k, f, h in heads))
    return streams.select("source", "serial", F.inline(head)).unionByName(audio)


def ogg_pages(streams: DataFrame, config: E.Config) -> DataFrame:
    """(source, serial, page, content): the pages of a file per stream."""
    return ogg.paginate(encode(streams, config))


def ogg_files(streams: DataFrame, config: E.Config) -> DataFrame:
    """(source, content): a whole file per stream. files.write_ogg() writes larger ones."""
    return ogg.files_of(encode(streams, config))
