"""Column functions for text, categories and integers read from bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = ",.!?:;()[]"


def plain_words(text: Column) -> Column:
    """Lower-cased words split at white space, without the marks of PUNCTUATION and without empty words."""
    spaced = F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), "[\\s ]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def letters(text: Column) -> Column:
    """Words of a-z; every other character but the blank is deleted, so a line break glues its neighbours."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z ]", ""), " "), lambda w: w != "")


def categories(text: Column, mark: str = ",") -> Column:
    """Trimmed parts; repeated ones stay, a final mark gives an empty one."""
    return F.transform(F.split(text, mark), lambda c: F.trim(c))


def utf8_mod(text: Column, m: int) -> Column:
    """The UTF-8 bytes, read as one big-endian integer, modulo m (m < 2^54), folded byte by byte."""
    pairs = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda c: c != "")
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 256 + F.conv(c, 16, 10).cast("long"), F.lit(m)))


def trailing_zeros(x: Column) -> Column:
    """Of the binary digits; 1 for zero, whose digits are '0'."""
    return F.when(x == 0, F.lit(1)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("long")


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mahalanobis(x: Column, mean: Column, variance: Column, least: float = 1e-9) -> Column:
    """With a diagonal variance, which is raised to `least` where a cluster has none."""
    part = F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), variance, lambda d, v: d / F.greatest(v, F.lit(least)))
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, d: s + d))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)
