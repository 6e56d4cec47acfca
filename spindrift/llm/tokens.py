"""Token ids of a corpus as a table of Simple-8b blocks, in document order.

A block holds whole documents and may begin and end within one, so that its size has a
bound whatever a document's length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import simple8b
from spindrift.llm.common import new_path, slices, written
from spindrift.llm.tokenizing import encoder, vocabulary

#: Ids of a block.
BLOCK_IDS = 1 << 16
#: carried: ids of the block's first document in earlier blocks (0 if it begins here);
#: goes_on: whether the last document has ids in the next block.
BLOCKS = "part int, first long, carried long, goes_on boolean, doc_ids array<long>, counts array<long>, payload binary"
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials of 32 bits (reflected) modulo the checksum's."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def joined_crc32(first: int, second: int, n: int) -> int:
    """The crc32 of two byte strings joined, from theirs and the second's length."""
    shift, power = 0x80000000, 0x00800000  # 1, and x to the eighth
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(shift, first) ^ second


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary_path: str | None = None) -> None:
    """Writes the ids of all documents, each with end_id after it, as Parquet rows of
    BLOCKS in ascending id order: part numbers ascend, and first is the number of
    ids before the block within its part. Null text counts as empty, null ids come
    first, and rows that share an id are all kept, next to each other."""
    vocabulary_path = vocabulary(vocabulary_path)

    def run(batches):
        enc, end = encoder(vocabulary_path), np.array([end_id], dtype="<u4")
        part, first, carried = TaskContext.get().partitionId(), 0, 0
        names, ids, held = [], [], 0

        def block(goes_on=False):
            nonlocal first
            sizes = [len(x) for x in ids]
            payload = simple8b.pack(np.concatenate(ids))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([carried], pa.int64()), pa.array([goes_on]), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["part", "first", "carried", "goes_on", "doc_ids", "counts", "payload"])
            first += sum(sizes)
            return out

        for b in slices(batches):
            for did, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, done = np.concatenate((np.frombuffer(enc.ids(text), "<u4"), end)), 0
                while done < len(x):
                    piece = x[done : done + BLOCK_IDS - held]
                    names.append(did)
                    ids.append(piece)
                    held += len(piece)
                    done += len(piece)
                    if held == BLOCK_IDS:
                        yield block(done < len(x))
                        names, ids, held, carried = [], [], 0, done if done < len(x) else 0
        if names:
            yield block()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, and its ids.
    Only documents that lie in several blocks are put together by a shuffle; with_ids,
    each has to fit in a row."""
    names = ["part", "doc_id", "start", "at", "n_tokens", "ids_crc32", "whole", "ids"]
    ddl = "part int, doc_id long, start long, at long, n_tokens long, ids_crc32 long, whole boolean" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for b in batches:
            for part, first, carried, goes_on, docs, sizes, payload in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                ids = simple8b.unpack(payload).astype("<u4")
                ends = np.cumsum(sizes)
                if ends[-1] != len(ids):
                    raise ValueError("a block's counts don't match its ids")
                cut = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                starts, at, whole = ends - sizes + first, np.zeros(len(docs), dtype=np.int64), np.ones(len(docs), dtype=bool)
                starts[0] -= carried
                at[0] = carried
                whole[0] = not carried
                whole[-1] &= not goes_on
                cols = [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(at), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array(whole)]
                kept = [pa.array([x.astype(np.int64).tolist() for x in cut], pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols + kept, names=names[: len(cols + kept)])

    def checked(batches):
        for b in batches:
            crcs = []
            for parts in b.column(4).to_pylist():
                crc = 0
                for x in parts:
                    crc = joined_crc32(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64()), *b.columns[5:]], names=["part", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"][: b.num_columns - 5]])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each written part, not for each document
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    pieces = written(blocks.mapInArrow(run, ddl), "pieces")
    ids = ["ids"] if with_ids else []
    open_ = pieces.where("not whole").groupBy("part", "start").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"), *ids))).alias("pieces")
    )
    open_ = open_.select("part", "doc_id", "start", "n_tokens", F.transform("pieces", lambda x: F.struct(x["n"].alias("n"), x["crc"].alias("crc"))).alias("ids_crc32"), *([F.flatten("pieces.ids").alias("ids")] if ids else []))
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", *ids]
    rows = pieces.where("whole").select(*names).unionByName(open_.mapInArrow(checked, pieces.select(*names).schema))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary_path: str | None = None) -> DataFrame:
    """Writes the corpus' ids to the shared folder and reads the files back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32; one row per input row. Null and empty texts are the end id alone;
    an empty table gives no rows; other columns are ignored.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, end_id, vocabulary_path)
    return read_tokens(docs.sparkSession, path)
