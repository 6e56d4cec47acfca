"""Spectral envelopes, neighbours and code-table lookups over DataFrames."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import scalar as S


def render_lines(lines: DataFrame, adx: str, y0: str, y1: str) -> DataFrame:
    """Every x in [0, adx) of each line with its y, in the closed form of the integer stepping."""
    x = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col(adx) - 1)))
    return x.withColumn("y", S.render_point(F.lit(0), F.col(y0), F.col(adx), F.col(y1), F.col("x")))


def neighbors(posts: DataFrame, group: str) -> DataFrame:
    """(group, i, v, low, high): place of the nearest lower and higher value among earlier
    places. Lists are short (65 posts at most in a stream), so each list is one array."""
    lists = posts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    rows = lists.select(group, "p", F.explode("p").alias("me"))
    earlier = F.filter("p", lambda o: o["i"] < F.col("me.i"))
    low = F.array_max(F.transform(F.filter(earlier, lambda o: o["v"] < F.col("me.v")), lambda o: F.struct(o["v"].alias("v"), o["i"].alias("i"))))
    high = F.array_min(F.transform(F.filter(earlier, lambda o: o["v"] > F.col("me.v")), lambda o: F.struct(o["v"].alias("v"), o["i"].alias("i"))))
    return rows.select(group, "me.i", "me.v", low["i"].alias("low"), high["i"].alias("high"))


def curve(posts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, x, y) for x in [0, n): lines between consecutive active posts, flat after the last."""
    w = Window.partitionBy(*keys).orderBy("x")
    lines = posts.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    end = F.least(F.coalesce("x1", F.lit(n)), F.lit(n))
    xs = lines.where(F.col("x0") < n).withColumn("x", F.explode(F.sequence(F.col("x0"), end - 1)))
    y = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(S.render_point(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("x")))
    return xs.select(*keys, "x", y.alias("y"))


def encode_value(target: Column, predicted: Column, span: Column) -> Column:
    """Floor 1 value that unfolds to target, given the prediction."""
    high, d = span - predicted, target - predicted
    folded = F.when(d > 0, 2 * d).otherwise(-2 * d - 1)
    return F.when(d == 0, 0).when(folded < 2 * F.least(high, predicted), folded).when(high > predicted, d + predicted).otherwise(high - 1 - d)


def decode_value(value: Column, predicted: Column, span: Column) -> Column:
    """Unfolds a floor 1 value around its prediction."""
    high = span - predicted
    beyond = F.when(high > predicted, value).otherwise(predicted - value + high - 1)
    near = predicted + F.when(value % 2 == 1, -F.floor((value + 1) / 2)).otherwise(F.floor(value / 2))
    return F.when(value == 0, predicted).when(value >= 2 * F.least(high, predicted), beyond).otherwise(near)


def bark_map(sizes: DataFrame, rate: int, map_size: int) -> DataFrame:
    """(n, i, m): bark map value of each bin of a spectrum of n bins."""
    scale = map_size / S.bark_floor(F.lit(0.5 * rate))
    i = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return i.withColumn("m", F.least(F.lit(map_size - 1), F.floor(S.bark_floor(rate * F.col("i") / (2.0 * F.col("n"))) * scale)).cast("int"))


def lsp_response(coefficients: list[float], omega: Column) -> Column:
    """Squared magnitude response p + q of a line-spectral-pair filter at omega."""
    cw = F.cos(omega)
    term = [4.0 * (math.cos(c) - cw) * (math.cos(c) - cw) for c in coefficients]
    product = lambda start, terms: reduce(lambda a, b: a * b, terms, start)
    if len(coefficients) % 2:
        return product(1.0 - cw * cw, term[1::2]) + product(F.lit(0.25), term[0::2])
    return product((1.0 - cw) / 2.0, term[1::2]) + product((1.0 + cw) / 2.0, term[0::2])


def lsp_curve(frames: DataFrame, bins: DataFrame, coefficients: list[float], map_size: int, amplitude_bits: int, offset: int) -> DataFrame:
    """Floor 0 curve: one value for each distinct map value, joined back to its bins. The
    bins are a stream's constants, 4096 at most."""
    points = [r.m for r in bins.select("m").distinct().limit(4097).collect()]
    if len(points) > 4096:
        raise ValueError("more than 4096 values in a floor's map")
    at = frames.withColumn("m", F.explode(F.array(*map(F.lit, points)).cast("array<int>")))
    pq = lsp_response(coefficients, math.pi * F.col("m") / map_size)
    top = (1 << amplitude_bits) - 1
    value = F.exp(0.11512925 * (F.col("amplitude") * float(offset) / (top * F.sqrt(pq)) - offset))
    at = at.withColumn("value", F.when(pq > 0, S.scrub(value)).otherwise(0.0))
    return at.join(F.broadcast(bins), "m")


def vq_vector(entry: Column, multiplicands: list[int], dims: int, minimum: float, delta: float, sequence: bool) -> Column:
    """Lookup type 1 vector of a codebook entry: base-n digits, least first, summed up if a sequence."""
    values, n = F.array(*map(F.lit, multiplicands)), len(multiplicands)
    digits = [(F.floor(entry / n**d) % n).cast("int") + 1 for d in range(dims)]
    plain = [F.element_at(values, d) * delta + minimum for d in digits]
    return F.array(*(accumulate(plain) if sequence else plain))


def blocksize(first_byte: Column, by_mode: list[int]) -> Column:
    """Block size that an audio packet's first byte announces; null for other packets and unknown modes."""
    bits = max(len(by_mode) - 1, 0).bit_length()
    mode = F.shiftright(first_byte, 1).bitwiseAND(F.lit((1 << bits) - 1))
    size = F.try_element_at(F.array(*map(F.lit, by_mode)), (mode + 1).cast("int"))
    return F.when(first_byte.bitwiseAND(F.lit(1)) == 0, size)
