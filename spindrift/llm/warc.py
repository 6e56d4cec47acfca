"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader checks every gzip member and record (gzip's checksum, version line, header,
length, payload digest). After a failed check it searches for the next gzip member or
version line that passes, recovers all later records, and reports the bytes between
as a quarantined gap. Members are inflated as a stream, a record at a time: within one,
and in what can be inflated of a broken one, it searches for the next version line too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import new_path, written

MIN_BYTES, ROLL_BYTES, DATE = 0, 64 << 20, "1970-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_CHUNK, _HEADER = 1 << 20, 1 << 24
RECORDS = "file string, offset long, length long, kind string, reason string, warc_type string, record_id string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(warc_type: str, page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record; a revisit keeps the payload's length and digest, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if warc_type == "response" else b"")
    head = {"WARC-Type": warc_type, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", "WARC-Date": DATE}
    if uri is not None:
        head["WARC-Target-URI"] = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 128 else "%20", uri)
    head |= {"WARC-Payload-Digest": f"sha1:{digest32(payload)}", "WARC-Block-Digest": f"sha1:{digest32(block)}"}
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if warc_type == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": str(len(payload))}
        if refers_to is not None:
            head |= {"WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", "X-Refers-To-Page": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Bad(ValueError):
    """A check has failed."""


@dataclass
class Found:
    offset: int
    length: int
    kind: str  # record or gap
    reason: str | None = None
    head: dict[str, str] | None = None
    payload: bytes | None = None


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header, payload and end of the record at ``at``; raises Bad if a check fails."""
    if not _VERSION.match(data, at):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("header without end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        head[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdigit() or not size.isascii():
        raise Bad("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("record without end")
    block = data[start:stop]
    own = head.get("warc-block-digest", "")
    if own.startswith("sha1:") and own[5:] != digest32(block):
        raise Bad("block digest differs")
    payload = block
    if "application/http" in head.get("content-type", ""):
        payload = block.partition(b"\r\n\r\n")[2]
    own = head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and own.startswith("sha1:") and own[5:] != digest32(payload):
        raise Bad("payload digest differs")
    return head, payload, stop + 4


def number(text: str | None) -> int | None:
    """The 64-bit integer that the text is; null if it isn't one."""
    n = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


class _File:
    """Random access in chunks, so that memory follows the records, not the file."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, self.size - at))

    def member(self, at: int) -> Iterator[bytes | tuple[int, str | None]]:
        """What can be inflated of the gzip member at ``at``, in pieces of bounded size,
        and last its end and, where it is broken, the reason."""
        z, pos = zlib.decompressobj(31), at
        while not z.eof:
            chunk = self.read(pos, _CHUNK)
            if not chunk:
                yield pos, "member cut short"
                return
            pos += len(chunk)
            while chunk and not z.eof:
                try:
                    data = z.decompress(chunk, _CHUNK)
                except zlib.error as e:
                    yield pos, f"gzip: {e}"
                    return
                chunk = z.unconsumed_tail
                if data:
                    yield data
        yield pos - len(z.unused_data), None

    def plain(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """The uncompressed record at ``at``, reading no more than its length asks for."""
        n = 1 << 16
        while True:
            data = self.read(at, n)
            try:
                head, payload, end = parse(data)
                return head, payload, at + end
            except Bad:
                if at + len(data) >= self.size:
                    raise
                stop = data.find(b"\r\n\r\n")
                size = re.search(rb"\r\ncontent-length:\s*(\d{1,15})\s*\r\n", data[: stop + 2], re.I) if stop >= 0 else None
                if not _VERSION.match(data) or (stop >= 0 and (not size or stop + 8 + int(size[1]) <= len(data))):
                    raise
                n = max(4 * n, stop + 8 + int(size[1])) if size else 4 * n
                if n > 1 << 24 and stop < 0:
                    raise

    def next_mark(self, at: int) -> int:
        """The next place from ``at`` on where a member or version line may begin."""
        tail = b""
        while at < self.size:
            data = tail + self.read(at, _CHUNK)
            base = at - len(tail)
            hits = [i for i in (data.find(_GZIP), data.find(b"WARC/1.")) if i >= 0]
            if hits:
                return base + min(hits)
            at += len(data) - len(tail)
            tail = data[-6:]
        return self.size


def proven(head: dict[str, str]) -> bool:
    """Whether the record has a digest of its own, which parse() has checked."""
    return head.get("warc-block-digest", "").startswith("sha1:")


def _wanted(data: bytes) -> int:
    """How many bytes the record at the start of data asks for, as far as can be told."""
    head = b"WARC/1.1\r\n"
    if len(data) < len(head):
        return len(head)
    stop = data.find(b"\r\n\r\n")
    if not _VERSION.match(data) or stop < 0 and len(data) >= _HEADER:
        return 0
    if stop < 0:
        return min(2 * len(data), _HEADER)
    size = re.search(rb"\r\ncontent-length:\s*(\d{1,15})\s*\r\n", data[: stop + 2], re.I)
    return stop + 8 + int(size[1]) if size else 0


def inflated(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes] | tuple[None, str]]:
    """The sound records of a member's content, (header, payload), and (None, reason)
    for each run of bytes that holds none. No more than a record is held."""
    data, more, lost = b"", True, False
    while True:
        held, size, want = [data], len(data), _wanted(data)
        while more and size < max(want, 1):
            piece = next(pieces, None)
            if piece is None:
                more = False
                break
            held.append(piece)
            size += len(piece)
            if size >= want:
                data = b"".join(held)
                held, want = [data], _wanted(data)
        data = b"".join(held)
        if not data:
            return
        try:
            head, payload, end = parse(data)
        except Bad as e:
            if not lost:
                yield None, str(e)
            lost = True
            at = data.find(b"WARC/1.", 1)
            data = data[at:] if at >= 0 else data[-6:] if more and len(data) > 6 else b""
            if at < 0 and more:  # the mark may lie across two pieces
                piece = next(pieces, None)
                more = piece is not None
                data = data + (piece or b"") if more else b""
                at = data.find(b"WARC/1.")
                data = data[at:] if at >= 0 else data
            continue
        lost = False
        yield head, payload
        data = data[end:]


def salvage(source, size: int) -> Iterator[Found]:
    """All sound records in order, and a gap for each run of bytes that holds none. Of a
    member of several records only the last has a length. A member that is broken, or
    holds a bad record, gives its sound records without length, and is a gap as well;
    of a broken one only records with a digest of their own count as sound."""
    f, at, lost, why = _File(source, size), 0, None, None
    while at < size:
        if f.read(at, 3) == _GZIP:
            end, broken, inner = at, None, None

            def pieces(at=at):
                nonlocal end, broken
                for x in f.member(at):
                    if isinstance(x, bytes):
                        yield x
                    else:
                        end, broken = x

            held: list[Found] = []  # the last record, and those that only gzip's checksum can prove
            for head, payload in inflated(pieces()):
                if head is None:
                    inner = inner or payload
                    continue
                if lost is not None:
                    yield Found(lost, at - lost, "gap", why)
                    lost = None
                if held and proven(held[-1].head):
                    yield held.pop()
                held.append(Found(at, 0, "record", None, head, payload))
            if broken is None and inner is None and held:
                held[-1].length = end - at
                yield from held
                at = end
                continue
            yield from (x for x in held if broken is None or proven(x.head))
            if lost is None:
                lost, why = at, broken or inner or "empty member"
            at = f.next_mark(at + 1) if broken is not None else end
        else:
            try:
                head, payload, end = f.plain(at)
            except Bad as e:
                if lost is None:
                    lost, why = at, str(e)
                at = f.next_mark(at + 1)
                continue
            if lost is not None:
                yield Found(lost, at - lost, "gap", why)
                lost = None
            yield Found(at, end - at, "record", None, head, payload)
            at = end
    if lost is not None:
        yield Found(lost, size - lost, "gap", why)


def with_types(pages: DataFrame, id_col: str, url_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, first): first is the id of the response that a record
    revisits, null for responses."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    top = src.select("digest", "page_id").where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    first = F.when(F.col("top") != F.coalesce("page_id", F.col("top") - 1), F.col("top"))
    return src.join(top.drop("n"), "digest", "left").select("page_id", "url", "payload", first.alias("first"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, roll: int = ROLL_BYTES, compress: bool = True) -> DataFrame:
    """Writes a record per row into archives below ``folder`` and returns (path, bytes)
    of the finished ones. Each attempt of a task has names of its own, and only what
    the finished attempt reports is read later."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    typed = with_types(pages, id_col, url_col, payload, min_bytes)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, n, out, sizes = uuid.uuid4().hex, 0, None, {}

        def close():
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for b in batches:
            for page_id, url, body, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    path = f"{root}/{name}-{n:05d}.warc" + ".gz" * compress
                    out, n, sizes[path] = store.open_output_stream(path, compression=None), n + 1, 0
                data = record("response" if first is None else "revisit", page_id, url, body, first)
                if compress:
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                sizes[path] += len(data)
                if sizes[path] >= roll:
                    close()
        close()
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes)), pa.array(list(sizes.values()), pa.int64())], names=["path", "bytes"])

    return written(typed.mapInArrow(run, "path string, bytes long"), "archives")


def read_archives(spark: SparkSession, files: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of all files (path): sound records, and gaps with their reason."""
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for x in salvage(source, source.size()):
                        h = x.head or {}
                        row = [path, x.offset, x.length, x.kind, x.reason] + [None] * 8
                        if x.kind == "record":
                            kind = h.get("warc-type")
                            whole = kind != "revisit"
                            size = len(x.payload) if whole else number(h.get("x-payload-length"))
                            sha = digest32(x.payload) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:")
                            row[5:] = [kind, h.get("warc-record-id"), h.get("warc-target-uri"), number(h.get("x-page-id")), number(h.get("x-refers-to-page")), size, sha, x.payload if with_payload else None]
                            held += len(x.payload) if with_payload else 0
                        rows.append(row)
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # the list is one small file, which Spark would read in one task: an archive a task instead
    return files.select("path").repartition(max(1, min(files.count(), 20_000)), "path").mapInArrow(run, RECORDS)


def whole(rows: DataFrame) -> DataFrame:
    """RECORDS without gaps; fails at the first gap."""
    said = F.concat_ws(" ", F.lit("gap in"), "file", F.lit("at"), "offset", F.lit("of"), "length", F.lit("bytes:"), "reason")
    return rows.where(F.when(F.col("kind") == "record", True).otherwise(F.raise_error(said).cast("boolean")))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back. A gap in them
    is an error that names file, place and reason: a page of this job would be lost.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to of all
    records read; one row per input row. Of payloads that are equal and have at least
    ``min_bytes`` bytes the one with the largest id is the response and the others
    revisit it; rows that share that id are all responses. Null html is an empty
    payload; a null id revisits unless all ids of its payload are null; a null url
    leaves the target out; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    files = write_archives(pages, folder, id_col, url_col, html_col, min_bytes)
    rows = whole(read_archives(spark, files, folder, with_payload=False))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
