"""What the corpus operators share: tables, shared storage, components of a graph."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Where that is unset, a temporary folder if master is local; on a cluster
    that folder would be another one on each machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not (own := getattr(spark, "_spindrift_dir", None)):
            own = spark._spindrift_dir = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        root = own
    return root


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage,
    and a lost executor costs nothing that was finished before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that not all texts of one are Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release(spark: SparkSession | None = None) -> None:
    """Deletes the intermediate tables of this process. Call it when the results
    that were made from them are written; runs by itself at exit."""
    for s, path in [x for x in _written if spark is None or x[0] is spark]:
        with contextlib.suppress(Exception):
            p = s._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(s._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove((s, path))


atexit.register(release)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns (node, root): every node that occurs in an edge with the smallest node
    reachable. Each round is two aggregations with map-side combine and two joins,
    whose large partitions Spark splits; nothing is collected. Rounds grow with the
    logarithm of the component sizes. Null ends and loops are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    star = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = star.union(star.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        large = both.join(low, both.a == low.n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        kept = large.join(low, large.a == low.n)
        small = kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("n", "m"))
        star = written(small.distinct().toDF("a", "b"), "star")
        seen = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = star.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = star.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return nodes.union(roots)
