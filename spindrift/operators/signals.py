"""Transforms, time axis, analysis and statistics over DataFrames of blocks and samples."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from spindrift.functions import mdct
from spindrift.functions import scalar as S


def transform_blocks(blocks: DataFrame, key: str, samples: str, inverse: bool = False, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(key, x array<double>): MDCT of each block, Arrow batches through the FFT kernel.
    sizes, if given, are the neighbours' sizes, and blocks are windowed first."""

    def run(batches):
        for b in batches:
            rows = b.column(1).to_pylist()
            out: list = [None] * len(rows)
            for n in {len(r) for r in rows if r}:
                own = [i for i, r in enumerate(rows) if r and len(r) == n]
                x = np.array([rows[i] for i in own], dtype=np.float64)
                if sizes:
                    x *= mdct.window(n, min(sizes[0], n), min(sizes[1], n))
                for i, y in zip(own, mdct.inverse(x) if inverse else mdct.forward(x), strict=True):
                    out[i] = y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "x"])

    src = blocks.select(F.col(key).cast("long").alias(key), F.col(samples).cast("array<double>").alias("s"))
    return src.mapInArrow(run, f"{key} long, x array<double>")


def bark_bands(half: int, rate: int) -> list[tuple[int, int, float]]:
    """(first bin, end, Bark of the centre) of bands at least half a Bark wide."""
    hz = rate / 2 / half
    z = lambda f: 13.0 * np.arctan(0.00076 * f) + 3.5 * np.arctan((f / 7500.0) ** 2)
    starts = [0]
    for k in range(1, half):
        if z(k * hz) - z(starts[-1] * hz) >= 0.5:
            starts.append(k)
    ends = [*starts[1:], half]
    return [(a, b, float(z((a + b) / 2 * hz))) for a, b in zip(starts, ends, strict=True)]


def band_frame(like: DataFrame, half: int, rate: int) -> DataFrame:
    """(band, bin, width, z): a dimension of at most ``half`` rows, for broadcast."""
    rows = [(i, k, b - a, z) for i, (a, b, z) in enumerate(bark_bands(half, rate)) for k in range(a, b)]
    return like.sparkSession.createDataFrame(rows, "band int, bin int, width int, z double")


def bins(spectra: DataFrame, key: str) -> DataFrame:
    return spectra.select(key, F.posexplode("x").alias("bin", "x"))


def tonality(spectra: DataFrame, key: str, half: int, rate: int) -> DataFrame:
    """(key, band, z, width, energy, offset): band energies and masking offsets. The peak's
    neighbourhood comes from the block's own array, so that bins are grouped only once."""
    band = F.broadcast(band_frame(spectra, half, rate))
    power = spectra.withColumn("p", F.transform("x", lambda v: v * v))
    rows = power.select(key, F.posexplode(F.arrays_zip("p")).alias("bin", "pw"), "p").withColumn("pw", F.col("pw.p"))
    near = F.slice("p", F.greatest(F.col("bin") - 7, F.lit(1)), F.least(F.col("bin") + 9, F.lit(half)) - F.greatest(F.col("bin") - 7, F.lit(1)) + 1)
    rows = rows.select(key, "bin", "pw", (F.aggregate(near, F.lit(0.0), lambda a, v: a + v) / F.size(near)).alias("mean"))
    best = rows.join(band, "bin").groupBy(key, "band", "z", "width").agg(F.sum("pw").alias("energy"), F.max(F.struct("pw", -F.col("bin"), "mean")).alias("top"))
    ratio = 10.0 * F.log10((F.col("top.pw") + 1e-30) / (F.col("top.mean") + 1e-30))
    tonal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio - 5.0) / 7.0))
    return best.select(key, "band", "z", "width", "energy", (tonal * (14.5 + F.col("z")) + (1.0 - tonal) * 5.5).alias("offset"))


def spread(bands: DataFrame, key: str) -> DataFrame:
    """(key, band, threshold): each band's energy falls 10 dB per Bark upwards and 25
    downwards. All bands of a block, 60 at most, sit in one array; none is paired by a join."""
    own = bands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("band", "z", "width", "energy", "offset"))).alias("b"))

    def at(me: Column) -> Column:
        def add(a: Column, j: Column) -> Column:
            dz = me["z"] - j["z"]
            db = F.when(dz >= 0, 10.0 * dz).otherwise(-25.0 * dz) + j["offset"]
            return a + F.when(db < 120.0, j["energy"] * F.pow(F.lit(10.0), -db / 10.0)).otherwise(0.0)

        return F.aggregate("b", F.lit(0.0), add)

    out = F.transform("b", lambda me: F.struct(me["band"].alias("band"), me["width"].alias("width"), at(me).alias("threshold")))
    return own.select(key, F.inline(out))


def mask(thresholds: DataFrame, key: str, half: int, rate: int, adjust_db: float) -> DataFrame:
    """(key, bin, mask): power that each bin can hide."""
    hz = rate / 2 / half
    quiet = F.pow(F.lit(10.0), (F.least(S.ath_db((F.col("bin") + 0.5) * hz), F.lit(110.0)) - 96.0) / 10.0)
    dim = F.broadcast(band_frame(thresholds, half, rate).select("band", "bin").withColumn("ath", quiet))
    return thresholds.join(dim, "band").select(key, "bin", (F.greatest(F.col("threshold") / F.col("width"), F.col("ath")) * 10 ** (adjust_db / 10)).alias("mask"))


def floor_target(mask_: Column, multiplier: int = 2) -> Column:
    t = F.floor((255.0 + 20.0 * F.log10(F.sqrt(12.0 * mask_)) / S.step_db()) / multiplier)
    return F.greatest(F.lit(0), F.least(S.floor_range(F.lit(multiplier)) - 1, t)).cast("int")


def overlap_add(blocks: DataFrame, keys: list[str], order: str, samples: str, carry: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """(keys, order, carry, samples): the second half of the block before plus the first half
    of this one, aligned at their centres; a stream's first block gives nothing. Null blocks
    leave the overlap as it was. With keep, rows that give nothing stay, with null samples."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = blocks.select(*keys, order, *carry, F.last(samples, ignorenulls=True).over(w).alias("prev"), F.col(samples).alias("cur"))
    if not keep:
        both = both.where("prev is not null and cur is not null")
    keys = [*keys, *carry]
    n = len(keys) + 1
    schema = StructType([*both.schema.fields[:n], StructField("samples", ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                full = [x.is_valid and y.is_valid for x, y in zip(b.column(n), b.column(n + 1), strict=True)]
                own = b.filter(pa.array(full))
                out = mdct.overlapped(*(rows(own.column(n + k)) for k in (0, 1))) if own.num_rows else []
                found = iter(out)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([next(found) if f else None for f in full], pa.list_(pa.float64()))], names=schema.names)

    return both.mapInArrow(run, schema)


def rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of an array column; nulls in them count as 0."""
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False)) if column.flatten().null_count else column.flatten().to_numpy()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return np.split(flat, ends[:-1])


def beside(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns that more has for its keys; null keys meet."""
    other = more.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return df.join(other, same).drop(*(f"_{k}" for k in keys))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], run: int = 1 << 16) -> DataFrame:
    """Adds sums over all rows before, by key. Only sums of runs of ``run`` numbers of the
    first order column are added up over a whole stream; the rows of a run are one task's."""
    part = df.withColumn("_run", F.floor(F.col(order[0]) / run))
    by_run = part.groupBy(*keys, "_run").agg(*(F.sum(x).alias(f"_{n}") for n, x in sums.items()))
    w = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    by_run = by_run.select(*keys, "_run", *(F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_{n}") for n in sums))
    own = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = beside(part, by_run, [*keys, "_run"])
    return out.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(x).over(own), F.lit(0)) for n, x in sums.items()}).drop("_run", *(f"_{n}" for n in sums))


def place(blocks: DataFrame, keys: list[str], order: str, length: str, granule: str, eos: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Position, samples cut in front (skip) and samples kept of each block of a stream,
    and its columns ``carry``.

    Blocks wait for the packet that has a granule position or ends the stream. The first
    such page, unless it also ends the stream, anchors the time axis: it starts at its
    granule less its length, and what would lie before 0 is cut. After that, positions
    add up. The ending page is cut at its granule.
    """
    # windows over the rows that are here: a join with sums of runs would make them again
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closes = (F.col(granule).isNotNull() | F.col(eos)).cast("int")
    paged = blocks.withColumn("page", F.coalesce(F.sum(closes).over(before), F.lit(0))).withColumn("raw", F.coalesce(F.sum(length).over(before), F.lit(0)))
    per_page = Window.partitionBy(*keys, "page")
    paged = paged.withColumns({"g": F.max(granule).over(per_page), "last": F.max(F.col(eos).cast("int")).over(per_page) == 1, "total": F.sum(length).over(per_page)})
    first = F.when((F.col("page") == 0) & ~F.col("last") & F.col("g").isNotNull(), F.col("g") - F.col("total"))
    paged = paged.withColumn("base", F.max(first).over(Window.partitionBy(*keys)))
    paged = paged.withColumn("base", F.coalesce("base", F.lit(0))).withColumn("start", F.col("raw") + F.col("base")).withColumn("end", F.col("start") + F.col(length))
    stop = F.when(F.col("last") & F.col("g").isNotNull(), F.least(F.col("end"), F.col("g"))).otherwise(F.col("end"))
    out = paged.withColumn("from", F.greatest(F.col("start"), F.lit(0))).withColumn("kept", F.greatest(stop - F.col("from"), F.lit(0)))
    return out.select(*keys, order, *carry, "page", F.col("from").cast("long").alias("position"), (F.col("from") - F.col("start")).cast("long").alias("skip"), F.col("kept").cast("long").alias("kept"))


def segment_energy(signal: DataFrame, key: str, segment: int = 64) -> DataFrame:
    """(key, seg, e): energy of first differences by aligned segment; before the signal is 0."""
    w = Window.partitionBy(key).orderBy("pos")
    d = F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0.0))
    return signal.select(key, F.floor(F.col("pos") / segment).alias("seg"), (d * d).alias("e")).groupBy(key, "seg").agg(F.sum("e").alias("e"))


def transients(energy: DataFrame, key: str, channels: int = 1, segment: int = 64) -> DataFrame:
    """(key, seg, attack): energy far above the mean of the four segments before."""
    least = 1e-6 * segment * channels
    w = Window.partitionBy(key).orderBy("seg").rowsBetween(-4, -1)
    mean = F.coalesce(F.sum("e").over(w), F.lit(0.0)) / 4
    return energy.withColumn("mean", mean).select(key, "seg", ((F.col("e") > least) & (F.col("e") > 12.0 * F.greatest(F.col("mean"), F.lit(0.1 * least)))).alias("attack"))


def lacing(packets: DataFrame, size: str) -> DataFrame:
    """Explodes each packet to its lacing values (place, lace): 255s, then the rest, which may be 0."""
    full = F.floor(F.col(size) / 255).cast("int")
    laces = F.concat(F.array_repeat(F.lit(255), full), F.array((F.col(size) % 255).cast("int")))
    return packets.select("*", F.posexplode(laces).alias("place", "lace"))


def reassemble(laces: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, packet, size): sizes of packets from a stream's lacing values."""
    ended = running(laces, [key], order, {"packet": (F.col("lace") < 255).cast("int")})
    return ended.groupBy(key, "packet").agg(F.sum("lace").alias("size"))


def gaps(pages: DataFrame, key: str, order: str, sequence: str) -> DataFrame:
    """Adds gap: whether a page's number isn't one more than that of the stream's page before."""
    before = F.lag(sequence).over(Window.partitionBy(key).orderBy(order))
    return pages.withColumn("gap", before.isNotNull() & (F.pmod(before + 1, F.lit(1 << 32)) != F.col(sequence)))
