"""Native words and word k-grams of whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, and faster, unless the text has other capitals."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; none for null."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def upto(first: Column, last: Column) -> Column:
    """first..last, empty where last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(ws: Column, k: int) -> Column:
    """A hash of each k consecutive words; entry i belongs to words i..i+k-1."""
    return F.transform(upto(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))
