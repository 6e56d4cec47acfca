"""Scalar functions of the codec as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: floor 1 range by multiplier, first and last entry of its dB table.
RANGES = [256, 128, 86, 64]
DB_FIRST, DB_LAST, DB_SIZE = 1.0649863e-07, 1.0, 256
#: Largest magnitude of each residue class, and the passes that code it.
CLASS_LIMITS = [0, 1, 2, 4, 8, 16, 247, 15592]
CLASS_PASSES = [0, 1, 1, 1, 1, 1, 2, 3]


def ilog(x: Column) -> Column:
    """Position of the highest set bit, from 1; 0 for x <= 0."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x)))


def float32_unpack(x: Column) -> Column:
    """Value of a packed float: 21 bits of mantissa, exponent with bias 788, sign."""
    x = x.cast("long")
    mantissa = x.bitwiseAND(F.lit(0x1FFFFF)).cast("double")
    exponent = F.shiftright(x, 21).bitwiseAND(F.lit(0x3FF)).cast("double")
    sign = F.when(x.bitwiseAND(F.lit(0x80000000)) != 0, -1.0).otherwise(1.0)
    return sign * mantissa * F.pow(F.lit(2.0), exponent - 788)


def float32_pack(v: Column) -> Column:
    """Packed float of a value, mantissa rounded to 21 bits; 0 for 0 and non-finite values."""
    m = F.abs(v)
    e = F.floor(F.log2(m))
    scaled = F.floor(m / F.pow(F.lit(2.0), (e - 20).cast("double")) + 0.5).cast("long")
    over = scaled >= 1 << 21
    mantissa = F.when(over, F.shiftright(scaled, 1)).otherwise(scaled).bitwiseAND(F.lit(0x1FFFFF))
    exponent = F.greatest(F.lit(0), F.least(F.lit(1023), e + over.cast("long") + 768)).cast("long")
    sign = F.when(v < 0, F.lit(0x80000000)).otherwise(F.lit(0)).cast("long")
    return F.when((m > 0) & (m < float("inf")), sign.bitwiseOR(F.shiftleft(exponent, 21)).bitwiseOR(mantissa)).otherwise(F.lit(0).cast("long"))


def lookup1_values(entries: Column, dimensions: Column) -> Column:
    """The largest r with r^dimensions <= entries; the root is corrected by one either way."""
    root = F.floor(F.pow(entries.cast("double"), 1.0 / dimensions.cast("double"))).cast("long")
    near = F.array(root + 1, root, root - 1)
    fits = F.filter(near, lambda r: (r >= 0) & (F.pow(r.cast("double"), dimensions.cast("double")) <= entries))
    return F.when(dimensions == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.array_max(fits), F.lit(0).cast("long")))


def bark_floor(x: Column) -> Column:
    """Bark scale of floor type 0."""
    return 13.1 * F.atan(0.00074 * x) + 2.24 * F.atan(x * x * 1.85e-8) + 1e-4 * x


def bark(f: Column) -> Column:
    """Bark scale of the masking model (not that of floor type 0)."""
    return 13.0 * F.atan(0.00076 * f) + 3.5 * F.atan((f / 7500.0) * (f / 7500.0))


def ath_db(f: Column) -> Column:
    """Threshold in quiet, dB SPL; frequencies under 20 Hz count as 20."""
    k = F.greatest(f, F.lit(20.0)) / 1000.0
    return 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * (k - 3.3) * (k - 3.3)) + 1e-3 * F.pow(k, F.lit(4.0))


def inverse_db(y: Column) -> Column:
    """Floor 1 amplitude of a value 0..255. The format's table is geometric to 1e-5; this is the rule."""
    y = F.greatest(F.lit(0), F.least(F.lit(DB_SIZE - 1), y)).cast("double")
    return F.pow(F.lit(DB_FIRST), (DB_SIZE - 1 - y) / (DB_SIZE - 1))


def step_db() -> Column:
    return 20.0 * F.log10(F.lit(DB_LAST / DB_FIRST)) / (DB_SIZE - 1)


def floor_range(multiplier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANGES)), multiplier.cast("int"))


def render_point(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """Integer interpolation; the step is cut towards zero."""
    dy = y1 - y0
    off = F.floor(F.abs(dy) * (x - x0) / (x1 - x0)).cast("long")
    return F.when(dy < 0, y0 - off).otherwise(y0 + off)


def decouple(m: Column, a: Column) -> Column:
    """Square polar to left and right, as struct<l, r>."""
    pos = (m > 0).cast("int") * 2 + (a > 0).cast("int")
    left = F.when(pos == 1, m).when(pos == 0, m - a).when(pos == 2, m + a).otherwise(m)
    right = F.when(pos == 3, m - a).when(pos == 2, m).when(pos == 1, m + a).otherwise(m)
    return F.struct(left.alias("l"), right.alias("r"))


def couple(left: Column, right: Column) -> Column:
    """Integer left and right to square polar, as struct<m, a>: the inverse of decouple.
    The larger magnitude is kept; the angle says which side it was and how far the other is."""
    l_wins = F.abs(left) > F.abs(right)
    big = F.when(l_wins, left).otherwise(right)
    angle = F.when(big > 0, left - right).otherwise(right - left)
    return F.struct(big.alias("m"), angle.alias("a"))


def _round_div(q: Column, step: int) -> Column:
    """q / step rounded half away from zero."""
    return F.round(q.cast("double") / step, 0).cast("long")


def split(q: Column, passes: Column) -> Column:
    """A residue value as up to three summands in steps of 495, 33 and 1: fixed values, with
    at most 31 of the largest and 7 of the middle step."""
    clamp = lambda c, n: F.greatest(F.lit(-n), F.least(F.lit(n), c))
    zero = F.lit(0).cast("long")
    fine = 33 * clamp(_round_div(q, 33), 7)
    coarse = 495 * clamp(_round_div(q, 495), 31)
    rest = q - coarse
    mid = 33 * clamp(_round_div(rest, 33), 7)
    return F.when(passes <= 1, F.array(q.cast("long"), zero, zero)).when(passes == 2, F.array(fine, q - fine, zero)).otherwise(F.array(coarse, mid, rest - mid))


def laplace(v: Column, scale: Column) -> Column:
    return F.exp(-F.abs(v) / scale)


def comment_values(comments: Column, name: str) -> Column:
    """Values of all comments with that name, whose case doesn't matter; entries without '=' don't count."""
    named = F.filter(comments, lambda c: (F.instr(c, "=") > 0) & (F.lower(F.split_part(c, F.lit("="), F.lit(1))) == name.lower()))
    return F.transform(named, lambda c: F.substr(c, F.instr(c, "=") + 1))


def interleave(planar: Column, frames: Column) -> Column:
    """array<array> by channel to one array by frame."""
    return F.flatten(F.transform(F.sequence(F.lit(1), frames), lambda i: F.transform(planar, lambda ch: F.element_at(ch, i))))


def scrub(v: Column) -> Column:
    """Non-finite samples become 0."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def ogg_crc(data: Column) -> Column:
    """CRC of a binary: polynomial 0x04c11db7, start 0, neither reflected nor inverted."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    turn = lambda c, _: F.when(c.bitwiseAND(F.lit(0x80000000)) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x104C11DB7))).otherwise(F.shiftleft(c, 1))
    eight = F.sequence(F.lit(1), F.lit(8))
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda c, i: F.aggregate(eight, c.bitwiseXOR(F.shiftleft(byte(i), 24)), turn))


def slope(i: Column, length: Column) -> Column:
    """Rising half of the power-complementary window."""
    s = F.sin((i + 0.5) / length * (3.141592653589793 / 2))
    return F.sin(3.141592653589793 / 2 * s * s)


def window(i: Column, n: Column, prev: Column, following: Column) -> Column:
    """Window of a block of n samples whose neighbours overlap with slopes of prev/2 and following/2."""
    left, right = F.least(prev, n), F.least(following, n)
    up, down = i - (n / 4 - left / 4), i - (n * 3 / 4 - right / 4)
    rise = F.when(up < 0, 0.0).when(up < left / 2, slope(up, left / 2)).otherwise(1.0)
    fall = F.when(down < 0, 1.0).when(down < right / 2, slope(right / 2 - 1 - down, right / 2)).otherwise(0.0)
    return F.when(i < n / 2, rise).otherwise(fall)


def quantise(r: Column, deadzone: Column, limit: int = CLASS_LIMITS[-1] // 2) -> Column:
    v = F.round(F.greatest(F.abs(r) - deadzone, F.lit(0.0)), 0) * F.signum(r)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), v)).cast("long")


def residue_class(magnitude: Column) -> Column:
    """First class that covers a partition's largest magnitude."""
    out = F.lit(len(CLASS_LIMITS) - 1)
    for k in range(len(CLASS_LIMITS) - 2, -1, -1):
        out = F.when(magnitude <= CLASS_LIMITS[k], k).otherwise(out)
    return out
