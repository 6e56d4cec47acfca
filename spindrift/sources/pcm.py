"""Metadata of audio files, raw PCM, and hashes of samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.arrow import slices
from spindrift.functions.audio import MAGIC, Comments, Identification
from spindrift.functions.codebook import Invalid
from spindrift.sources.ogg import Damaged, read_packets, read_pages, xiph_split

HEADERS = "source string, serial long, channels int, rate long, blocksizes array<int>, vendor string, comments array<string>, error string"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("source"), "content")


def headers_of(files: DataFrame, laced: bool = False) -> DataFrame:
    """HEADERS of (source, content): the first two headers of each file's first audio
    stream, or of three laced headers; nothing after them is parsed. A file without
    them gets a row with its error."""
    names = [c.split()[0] for c in HEADERS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string()), pa.string()]

    def one(source: str, content: bytes) -> tuple:
        try:
            if laced:
                serial, first, second = None, *xiph_split(content)[:2]
            else:
                serial = first = second = None
                for p in read_packets(read_pages(content)):
                    if first is None and p.bos and p.data[:7] == b"\1" + MAGIC:
                        serial, first = p.serial, p.data
                    elif p.serial == serial:
                        second = p.data
                        break
                if second is None:
                    raise Invalid("no audio headers")
            ident, comments = Identification.read(first), Comments.read(second, strict=False)
            return source, serial, ident.channels, ident.rate, list(ident.blocksizes), comments.vendor, list(comments.comments), None
        except (Invalid, Damaged) as e:
            return source, None, None, None, None, None, None, str(e)

    def run(batches):
        for b in slices(batches):
            rows = [one(s, c or b"") for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("source", "content").mapInArrow(run, HEADERS)


def ogg_headers(spark: SparkSession, path: str) -> DataFrame:
    return headers_of(_files(spark, path, "*.ogg"))


def planar(blocks: list[np.ndarray]) -> pa.Array:
    """array<array<float>> of (channels x samples) blocks, without a Python number each."""
    inner = np.cumsum([0, *(x.shape[1] for x in blocks for _ in x)], dtype=np.int32)
    outer = np.cumsum([0, *(len(x) for x in blocks)], dtype=np.int32)
    flat = np.concatenate([np.ascontiguousarray(x, dtype=np.float32).ravel() for x in blocks]) if blocks else np.zeros(0, dtype=np.float32)
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(flat)))


def from_planar(column: pa.Array) -> list[np.ndarray]:
    """The (channels x samples) blocks of an array<array<float>> column; nulls count as 0.
    Channels of a row must have the same length."""
    inner = column.flatten()
    sizes, counts = inner.value_lengths().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    out, at, first = [], 0, 0
    for n in counts.tolist():
        own = sizes[first : first + n]
        if n and (own != own[0]).any():
            raise ValueError("channels differ in length")
        size = int(own[0]) if n else 0
        out.append(flat[at : at + n * size].reshape(n, size))
        at, first = at + n * size, first + n
    return out


def raw_pcm(files: DataFrame, channels: int) -> DataFrame:
    """(source, samples array<array<float>> by channel) of interleaved little-endian 16-bit
    content; bytes after the last whole frame are left out."""

    def run(batches):
        for b in batches:
            out = []
            for content in b.column(1).to_pylist():
                n = len(content or b"") // (2 * channels)
                out.append((np.frombuffer(content or b"", "<i2", n * channels).reshape(n, channels).T / np.float32(32768)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), planar(out)], names=["source", "samples"])

    return files.select("source", "content").mapInArrow(run, "source string, samples array<array<float>>")


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
