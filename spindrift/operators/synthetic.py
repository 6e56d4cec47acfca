"""Test signals and damaged copies as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.functions import synthetic
from spindrift.functions.arrow import slices
from spindrift.sources.pcm import planar


def test_signals(cases: DataFrame) -> DataFrame:
    """(source, serial, samples) of (source, serial, rate, channels, seconds, noise)."""

    def run(batches):
        for b in batches:
            for source, serial, *case in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([serial], pa.int64()), planar([synthetic.tones(*case)])], names=["source", "serial", "samples"])

    own = cases.selectExpr("cast(source as string)", "cast(serial as long)", "cast(rate as int)", "cast(channels as int)", "cast(seconds as double)", "cast(noise as double)")
    return own.mapInArrow(run, "source string, serial long, samples array<array<float>>")


test_signals.__test__ = False  # not a test


def damaged(files: DataFrame, seed: int = 0x9E3779B97F4A7C15) -> DataFrame:
    """(source, kind, content) of (source long, content): one kind of damage each, by
    the source's number and the seed."""

    def run(batches):
        for b in slices(batches):
            kinds, data = zip(*(synthetic.damaged(c or b"", seed ^ s) for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), strict=True) if b.num_rows else ((), ())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(data, pa.binary())], names=["source", "kind", "content"])
            del b, kinds, data
            yield out
            del out

    return files.selectExpr("cast(source as long)", "content").mapInArrow(run, "source long, kind string, content binary")
