"""Ogg pages and packets: kernels, and DataFrame sources and sinks over them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spindrift.functions.arrow import slices

CONTINUED, BOS, EOS = 1, 2, 4
NONE = -1  # granule position of a page on which no packet ends
PAGES = "source string, page long, offset long, flags int, granule long, serial long, sequence long, lacing array<int>, body binary, skipped long, bad long"
PACKETS = "source string, serial long, packet long, granule long, bos boolean, eos boolean, data binary, lost long, page long"


class Damaged(ValueError):
    """Damage, in strict mode."""


#: Each byte with its bits in the opposite order.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc(data: bytes) -> int:
    """Checksum of polynomial 0x04c11db7, start 0, neither reflected nor inverted: zlib's,
    which is both and starts at all ones, of the mirrored bytes, mirrored back."""
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    offset: int = 0
    place: int = 0

    def to_bytes(self) -> bytes:
        head = b"OggS" + struct.pack("<BBqIII", 0, self.flags, self.granule, self.serial, self.sequence, 0) + bytes([len(self.lacing)]) + self.lacing
        whole = head + self.body
        return whole[:22] + struct.pack("<I", crc(whole)) + whole[26:]


class Buffer:
    """A window on an input that is read forwards in pieces; what is behind is given up."""

    def __init__(self, read: Callable[[int], bytes], piece: int = 1 << 16):
        self.read, self.piece, self.data, self.first, self.ended = read, piece, b"", 0, False

    def fill(self, at: int, n: int) -> int:
        """Reads until n bytes from place ``at`` on are held; how many there are, at most n."""
        need = at - self.first + n
        if len(self.data) < need and not self.ended:
            parts, held = [self.data[at - self.first :]], len(self.data) - (at - self.first)
            self.first = at
            while held < n:
                more = self.read(max(self.piece, n - held))
                if not more:
                    self.ended = True
                    break
                parts.append(more)
                held += len(more)
            self.data = b"".join(parts)
        return min(n, self.first + len(self.data) - at)

    def view(self, at: int, n: int) -> bytes:
        return self.data[at - self.first : at - self.first + n]


def read_pages(data: bytes | Buffer, strict: bool = False, counts: dict[str, int] | None = None) -> Iterator[Page]:
    """All sound pages of bytes, or of a buffer, which then holds no more than a page and
    a piece. What isn't a page is searched byte by byte for the next capture pattern;
    counts gets the bytes skipped and the pages whose checksum was wrong."""
    counts = {} if counts is None else counts
    counts |= {"skipped": 0, "bad": 0}
    if not isinstance(data, Buffer):
        pieces = iter((data,))
        data = Buffer(lambda n: next(pieces, b""))
    at, lost = 0, False
    while data.fill(at, 27) == 27:
        if data.view(at, 5) != b"OggS\0":
            if strict:
                raise Damaged(f"no page at byte {at}")
            there = data.data.find(b"OggS\0", at + 1 - data.first) + data.first
            lost = there < data.first
            if lost:  # the pattern may begin in the last bytes that are held
                there = max(at + 1, data.first + len(data.data) - 4)
            counts["skipped"] += there - at
            at = there
            continue
        lost = False
        n = data.view(at + 26, 1)[0]
        data.fill(at, 27 + n)
        lacing = data.view(at + 27, n)
        size = 27 + n + sum(lacing)
        if len(lacing) < n or data.fill(at, size) < size:
            if strict:
                raise Damaged("page cut short")
            return  # a page without its end ends the input
        whole = data.view(at, size)
        flags, granule, serial, sequence, check = struct.unpack_from("<BqIII", whole, 5)
        if crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != check:
            if strict:
                raise Damaged(f"checksum differs at byte {at}")
            counts["bad"] += 1
            counts["skipped"] += 1
            at += 1
            continue
        yield Page(flags, granule, serial, sequence, lacing, whole[27 + n :], at)
        at += size
    if lost:
        counts["skipped"] += data.first + len(data.data) - at


@dataclass
class Packet:
    data: bytes
    serial: int
    granule: int | None = None
    bos: bool = False
    eos: bool = False
    page: int = 0  # place of the page it ends on


def read_packets(pages: Iterable[Page], strict: bool = False, counts: dict[str, int] | None = None, parts: dict[int, bytes | None] | None = None, due: dict[int, int] | None = None) -> Iterator[Packet]:
    """Packets in order of their last page. Only the last that ends on a page has its
    granule. A gap in a stream's page numbers drops the packet in progress; an ending
    page on which no packet ends gives an empty one. parts and due, by stream, are the
    packet in progress and the next page number; a caller that keeps them can go on later."""
    counts = {} if counts is None else counts
    counts.setdefault("lost", 0)
    parts, due = {} if parts is None else parts, {} if due is None else due

    def lose(why: str) -> None:
        if strict:
            raise Damaged(why)
        counts["lost"] += 1

    for p in pages:
        if p.flags & BOS:
            parts[p.serial] = None
        elif p.serial in due and due[p.serial] != p.sequence:
            if parts.get(p.serial) is not None:
                lose("a packet misses its end")
            elif strict:
                raise Damaged("pages are missing")
            parts[p.serial] = None
        due[p.serial] = p.sequence + 1 & 0xFFFFFFFF
        part, skip = parts.get(p.serial), False
        if p.flags & CONTINUED:
            if part is None:
                skip = True
                lose("a packet misses its start")
        elif part is not None:
            lose("a packet misses its end")
            part = None
        done, at, begun = [], 0, part
        for lace in p.lacing:
            piece = p.body[at : at + lace]
            at += lace
            begun = piece if begun is None else begun + piece
            if lace < 255:
                if not skip:
                    done.append(begun)
                begun, skip = None, False
        parts[p.serial] = None if skip else begun
        eos = bool(p.flags & EOS)
        out = [Packet(d, p.serial, page=p.place) for d in done] or ([Packet(b"", p.serial, page=p.place)] if eos else [])
        if out:
            out[0].bos = bool(p.flags & BOS)
            out[-1].eos = eos
            out[-1].granule = None if p.granule == NONE else p.granule
        yield from out


def write_pages(packets: Iterable[tuple[bytes, int, bool]], serial: int, target: int = 4096) -> Iterator[Page]:
    """Pages of one stream from (data, granule, flush). A page ends when it has target
    bytes or 255 laces, or after a packet that asks for it; the last one ends the stream."""
    lacing, body, granule, sequence, going, ended = bytearray(), bytearray(), NONE, 0, False, False

    def emit(eos: bool, more: bool) -> Page:
        nonlocal lacing, body, granule, sequence, going
        flags = (CONTINUED if going else 0) | (BOS if sequence == 0 else 0) | (EOS if eos else 0)
        page = Page(flags, granule, serial, sequence, bytes(lacing), bytes(body))
        lacing, body, granule, sequence, going = bytearray(), bytearray(), NONE, sequence + 1, more
        return page

    last = NONE
    for data, position, flush in packets:
        for at in range(0, len(data) + 1, 255):
            if len(lacing) == 255 or len(body) >= target:
                yield emit(False, at > 0)
            piece = data[at : at + 255]
            lacing.append(len(piece))
            body += piece
        granule = last = position
        if flush:
            yield emit(False, False)
            ended = True
        else:
            ended = False
    if ended:
        granule = last
    yield emit(True, False)


def ogg_pages(spark: SparkSession, path: str, mode: str = "PERMISSIVE", glob: str = "*") -> DataFrame:
    """PAGES of all files below path whose names match. FAILFAST raises on damage; PERMISSIVE
    skips it and counts. Files are read in pieces of 64 KiB, whatever their size; in stores
    that only Spark reads, as wholes."""
    strict = {"PERMISSIVE": False, "FAILFAST": True}[mode]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    scheme = path.split("://")[0] if "://" in path else "file"
    if scheme not in ("file", "s3", "s3a", "gs", "hdfs", "abfss"):
        return pages_of(found.select(F.col("path").alias("source"), "content"), strict)
    return _pages(found.select(F.col("path").alias("source")), strict, _opened)


def _opened(uri: str) -> Buffer:
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        system, path = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(quote(uri.replace("s3a:", "s3:", 1), safe=":/@"))
    return Buffer(system.open_input_file(path).read)


def pages_of(files: DataFrame, strict: bool = False) -> DataFrame:
    """PAGES of (source, content). A file is one task's; its pages leave it one by one."""
    return _pages(files.select("source", "content"), strict, None)


def _pages(files: DataFrame, strict: bool, opened: Callable[[str], Buffer] | None) -> DataFrame:
    names = [c.split()[0] for c in PAGES.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        for b in slices(batches):
            sources = b.column(0).to_pylist()
            for source, content in zip(sources, map(opened, sources) if opened else b.column(1).to_pylist(), strict=True):
                counts, rows, before = {}, [], {"skipped": 0, "bad": 0}
                for k, p in enumerate(read_pages(content or b"", strict, counts)):
                    rows.append((source, k, p.offset, p.flags, p.granule, p.serial, p.sequence, list(p.lacing), p.body, counts["skipped"] - before["skipped"], counts["bad"] - before["bad"]))
                    before = dict(counts)
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, PAGES)


def _held(rows: Iterable[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, of 1000 or 16 MiB at most unless one row has more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= 1000 or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)


def _streamed(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, each: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], placed: bool = False) -> DataFrame:
    """Rows that each(key, rows in order) gives for every group: a group is one task's,
    sorted by Spark, and read and written row by row, so that none is held as a whole.
    placed: the rows of a group follow one another in order already, and aren't dealt."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield from zip(*(c.to_pylist() for c in b.slice(at, 1000).columns), strict=True)

    def run(batches):
        n = len(keys)
        yield from _held((row for key, rows in groupby(rows_of(batches), key=lambda r: r[:n]) for row in each(key, (r[n:] for r in rows))), arrow)

    own = df.select(*keys, *columns)
    return (own if placed else own.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInArrow(run, schema)


def packets_of(pages: DataFrame, strict: bool = False) -> DataFrame:
    """PACKETS of PAGES, a stream at a time, in page order."""

    def each(key, rows):
        counts: dict[str, int] = {}
        own = (Page(f, g, key[1], q, bytes(x), b, place=k) for k, f, g, q, x, b in rows)
        lost = 0
        for k, p in enumerate(read_packets(own, strict, counts)):
            yield (*key, k, p.granule, p.bos, p.eos, p.data, counts["lost"] - lost, p.page)
            lost = counts["lost"]

    return _streamed(pages, ["source", "serial"], ["page"], ["page", "flags", "granule", "sequence", "lacing", "body"], PACKETS, each)


def packets_in(files: DataFrame, strict: bool = False) -> DataFrame:
    """PACKETS of (source, content), each row a file of its own: packets_of(pages_of()) of
    whole files, whose pages are in order where they are read, so that nothing is dealt."""
    arrow = to_arrow_schema(StructType.fromDDL(PACKETS))

    def rows_of(source, content):
        counts: dict[int, dict[str, int]] = {}
        seen: dict[int, list[int]] = {}  # packets and losses so far, by stream
        parts, due = {}, {}
        for place, page in enumerate(read_pages(content, strict)):
            page.place = place
            own, so_far = counts.setdefault(page.serial, {}), seen.setdefault(page.serial, [0, 0])
            for p in read_packets((page,), strict, own, parts, due):
                yield source, p.serial, so_far[0], p.granule, p.bos, p.eos, p.data, own["lost"] - so_far[1], p.page
                so_far[:] = so_far[0] + 1, own["lost"]

    def run(batches):
        yield from _held((row for b in batches for k in range(b.num_rows) for row in rows_of(b.column(0)[k].as_py(), b.column(1)[k].as_py() or b"")), arrow)

    return files.select("source", "content").mapInArrow(run, PACKETS)


def checksums(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, crc) of a binary column; null for null."""
    schema = StructType([df.schema[key], *StructType().add("crc", "long").fields])

    def run(batches):
        for b in slices(batches):
            found = [None if x is None else crc(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=[key, "crc"])
            del b

    return df.select(key, data).mapInArrow(run, schema)


def paginate(packets: DataFrame, target: int = 4096) -> DataFrame:
    """(source, serial, page, content): pages of (source, serial, packet, granule, flush, data), a stream a task."""

    def each(key, rows):
        for k, p in enumerate(write_pages(((data, granule, flush) for _, granule, flush, data in rows), key[1], target)):
            yield (*key, k, p.to_bytes())

    return _streamed(packets, ["source", "serial"], ["packet"], ["packet", "granule", "flush", "data"], "source string, serial long, page long, content binary", each)


def joined(pages: DataFrame) -> DataFrame:
    """(source, content) of (source, page, content): the pages one after another."""
    return _streamed(pages, ["source"], ["page"], ["page", "content"], "source string, content binary", lambda key, rows: [(*key, b"".join(content for _, content in rows))])


def files_of(packets: DataFrame, target: int = 4096, placed: bool = False) -> DataFrame:
    """(source, content) of (source, serial, packet, granule, flush, data): joined(paginate()),
    dealt once. placed: the packets of a source follow one another by stream and number, in
    one partition, as when they come from one row; they aren't dealt at all."""

    def each(key, rows):
        pages = [(k, serial, p.to_bytes()) for serial, own in groupby(rows, key=lambda r: r[0]) for k, p in enumerate(write_pages(((data, granule, flush) for _, _, granule, flush, data in own), serial, target))]
        pages.sort(key=lambda x: x[:2])  # the first pages of all streams lead
        yield *key, b"".join(content for _, _, content in pages)

    return _streamed(packets, ["source"], ["serial", "packet"], ["serial", "packet", "granule", "flush", "data"], "source string, content binary", each, placed)


def xiph_lace(headers: list[bytes]) -> bytes:
    """Three headers in one buffer: a count, two sizes in 255s, the headers."""
    sizes = b"".join(b"\xff" * (len(h) // 255) + bytes([len(h) % 255]) for h in headers[:-1])
    return bytes([len(headers) - 1]) + sizes + b"".join(headers)


def xiph_split(data: bytes) -> list[bytes]:
    if not data or data[0] != 2:
        raise Damaged("three headers are expected")
    at, sizes = 1, []
    for _ in range(2):
        n = 0
        while True:
            if at >= len(data):
                raise Damaged("sizes cut short")
            n, at = n + data[at], at + 1
            if data[at - 1] < 255:
                break
        sizes.append(n)
    if at + sum(sizes) > len(data):
        raise Damaged("headers cut short")
    return [data[at : at + sizes[0]], data[at + sizes[0] : at + sum(sizes)], data[at + sum(sizes) :]]
