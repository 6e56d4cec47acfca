"""Sink of whole files: a Python data source that writes (source, content) rows, or
(source, page, content) rows, those of a source one after another."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING = "_pending"


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


def file_name(source: str, ending: str) -> str:
    """A file's name for any source: itself if it can be, else cut and made unique by a hash."""
    name = quote(source, safe=" ,;=()+@")
    if name.startswith(("_", ".")) or len(name) > 180:  # hidden, or too long
        name = "x" + name[:100] + "-" + hashlib.sha256(source.encode()).hexdigest()[:32]
    return name + ending


class FileWriter(DataSourceWriter):
    """Tasks write below a folder of their own; the commit moves whole files into place, so
    that tasks run twice or lost leave nothing behind."""

    def __init__(self, path: str, ending: str, overwrite: bool, paged: bool = False):
        self.path, self.ending, self.overwrite, self.paged, self.job = path, ending, overwrite, paged, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else "file://" + posixpath.abspath(self.path))

    def write(self, iterator) -> Written:
        system, root = self._open()
        own = f"{root}/{PENDING}-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        names, last, out = [], None, None
        for row in iterator:
            if row.source is None:
                raise ValueError("a file needs a source")
            if out is None or not self.paged or row.source != last:
                if out is not None:
                    out.close()
                at = f"{own}/{len(names)}"
                out = system.open_output_stream(at)
                names.append((at, file_name(row.source, self.ending)))
                last = row.source
            out.write(bytes(row.content or b""))
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, root = self._open()
        names = [x for m in messages if m is not None for x in m.names]
        final = {name for _, name in names}
        if len(final) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same source")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.is_file and old.base_name.endswith(self.ending) and old.base_name not in final:
                    system.delete_file(old.path)
        for at, name in names:
            system.move(at, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = self._open()
        if system.get_file_info(f"{root}/{PENDING}-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}-{self.job}")


class OggFiles(DataSource):
    """Format ``ogg``, for writing: mode append keeps other files, overwrite removes them."""

    @classmethod
    def name(cls) -> str:
        return "ogg"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {"source", "content"} - set(schema.names):
            raise ValueError("columns source and content are needed")
        return FileWriter(self.options["path"], self.options.get("ending", ".ogg"), overwrite, "page" in schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OggFiles)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes each row's content to a file that is named after its source."""
    register(files.sparkSession)
    files.select("source", "content").write.format("ogg").mode(mode).save(path)


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (source, page, content) to a file for each source; no file is held as a whole."""
    register(pages.sparkSession)
    sorted_ = pages.select("source", "page", "content").repartition("source").sortWithinPartitions("source", "page")
    sorted_.write.format("ogg").mode(mode).save(path)
