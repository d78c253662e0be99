"""Bloom filter, distinct counts by trailing zeros, and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trailing_zeros, utf8_mod
from .similarity import hash_params


def bloom_positions(text: Column, bits: int, params: list[tuple[int, int]]) -> Column:
    """The bits of a text; its bytes count as one integer."""
    x = utf8_mod(text, bits)
    return F.array(*(F.pmod(x * a + b, F.lit(bits)) for a, b in params))


def bloom_probe(known: DataFrame, probe: DataFrame, column: str, bits: int = 10_000, hashes: int = 8) -> DataFrame:
    """probe with verdict 1 where all bits are set. Empty texts and nulls are not entered and answer 0. The set bits
    are one row of at most `bits` numbers."""
    params = hash_params(hashes)
    some = known.where(F.col(column) != "").select(column).distinct()
    filled = some.select(F.explode(bloom_positions(F.col(column), bits, params)).alias("p")).agg(F.collect_set("p").alias("bits"))
    verdict = (F.col(column) != "") & (F.size(F.array_except(bloom_positions(F.col(column), bits, params), "bits")) == 0)
    return probe.crossJoin(F.broadcast(filled)).select(*probe.columns, F.coalesce(verdict, F.lit(False)).cast("int").alias("verdict"))


MODULUS = (1 << 63) - 1
HASHES, GROUP = 200, 40


def hashed(x: Column, a: Column, b: Column) -> Column:
    """(a * x - b) mod MODULUS for 0 <= x < MODULUS and a, b < 2^20, in 64 bits: 2^63 is 1 modulo MODULUS, so what a
    times the upper half of x has above 31 bits comes back at the bottom."""
    high, low = F.shiftright(x, 32) * a, x.bitwiseAND(F.lit(0xFFFFFFFF)) * a
    top = F.shiftleft(high.bitwiseAND(F.lit(0x7FFFFFFF)), 32)
    rest = F.shiftright(high, 31) + low
    whole = F.when(top >= MODULUS - rest, top - (MODULUS - rest)).otherwise(top + rest)
    return F.when(whole >= b, whole - b).otherwise(whole - b + MODULUS)


def longest_tails(x: Column, n: int = HASHES) -> list[Column]:
    """The most trailing zeros of each hash, as aggregates of one pass over a stream."""
    x = F.pmod(x.cast("long"), F.lit(MODULUS))
    return [F.max(trailing_zeros(hashed(x, F.lit(a), F.lit(b)))).alias(f"r{i}") for i, (a, b) in enumerate(hash_params(n))]


def fm_estimate(tails: Column, n: int = HASHES, group: int = GROUP) -> Column:
    """2^R of all hashes in order, means of runs of `group`, the middle one, rounded."""
    powers = F.array_sort(F.transform(tails, lambda r: F.pow(F.lit(2.0), r)))
    means = [F.aggregate(F.slice(powers, g * group + 1, group), F.lit(0.0), lambda s, v: s + v) / group for g in range(n // group)]
    return F.round(middle(F.array(*means))).cast("long")


def distinct_estimate(df: DataFrame, by: list[str], x: Column, n: int = HASHES, group: int = GROUP) -> DataFrame:
    """(by, truth, estimate). Only distinct values are hashed, and each hash keeps one number a group."""
    some = df.select(*by, x.cast("long").alias("x")).distinct()
    truth = some.groupBy(*by).agg(F.count("x").alias("truth"))
    params = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(hash_params(n))))
    every = some.where("x is not null").select(*by, F.pmod("x", F.lit(MODULUS)).alias("x"), F.explode(params).alias("p"))
    tails = every.groupBy(*by, "p.i").agg(F.max(trailing_zeros(hashed(F.col("x"), F.col("p.a"), F.col("p.b")))).alias("r"))
    held = tails.groupBy(*by).agg(F.collect_list("r").alias("r"))  # n numbers
    same = reduce(lambda s, c: s & c, (truth[c].eqNullSafe(held[c]) for c in by), F.lit(True))
    return truth.join(held, same).select(*(truth[c] for c in by), "truth", fm_estimate(F.col("r"), n, group).alias("estimate"))


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of fixed size without replacement: the rows of least hash."""
    return df.orderBy(F.pmod(F.col(key) * 2654435761 + seed, F.lit(4294967296)), key).limit(size)


def top_ranks(df: DataFrame, key: str, ranks: int = 3) -> DataFrame:
    """(key, n) of the keys with one of the highest distinct counts; ties stay."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    levels = n.select("n").distinct().orderBy(F.desc("n")).limit(ranks)
    return n.join(F.broadcast(levels), "n", "left_semi").select(key, "n")


def middle(values: Column) -> Column:
    """The element in the middle of the values in order."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
