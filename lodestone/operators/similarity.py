"""Jaccard joins, exact and by MinHash with banding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..plans.cut import once
from ..plans.lists import HELD, coded, decoded, lists, pairs


def exact(rows: DataFrame, key: str, element: str, threshold: float) -> DataFrame:
    """(a, b, sim) of all pairs of keys with a Jaccard similarity of their element sets of at least threshold > 0."""
    rows = rows.select(F.col(key).alias("k"), F.col(element).alias("e")).dropna().distinct()
    return pairs(rows, "k", "e", sizes=threshold).select("a", "b", jaccard(F.col("n"), F.col("na"), F.col("nb")).alias("sim")).where(F.col("sim") >= threshold)


def hash_params(n: int) -> list[tuple[int, int]]:
    """Reproducible (a, b) of n hash functions."""
    return [(2654435761 * (i + 1) % 999_983 + 1, 40503 * (i + 7) % 999_979) for i in range(n)]


def signatures(rows: DataFrame, key: str, element: str, modulus: int, n: int = 50) -> DataFrame:
    """(k, i, h): component i is the least (a_i * x + b_i) mod modulus over the integer elements; component 0 uses
    a = 1 and b = 0. One aggregate over the rows makes all components."""
    params = [(1, 0), *hash_params(n - 1)]
    least = rows.select(F.col(key).alias("k"), F.col(element).cast("long").alias("e")).dropna().groupBy("k").agg(*(F.min(F.pmod(F.col("e") * a + b, F.lit(modulus))).alias(f"h{i}") for i, (a, b) in enumerate(params)))
    return least.select("k", F.posexplode(F.array(*(f"h{i}" for i in range(n)))).alias("i", "h"))


def lsh(rows: DataFrame, key: str, element: str, modulus: int, threshold: float, n: int = 50, band: int = 1) -> DataFrame:
    """(a, b, sim): pairs with an equal band of their signatures and an exact Jaccard similarity of at least
    threshold > 0. Candidates are checked where they arise: common elements are counted from the lists of each key's
    elements, which costs the same for many candidates as for few, and the signatures of those similar enough are
    compared band by band, so neither candidates nor sets travel."""
    if threshold <= 0:
        raise ValueError("threshold has to be above 0")
    kind = rows.schema[key].dataType
    rows, back = coded(rows.select(F.col(key).alias("k"), F.col(element).cast("long").alias("e")).dropna().distinct(), "k")
    rows = once(rows)
    signed = lists(once(signatures(rows, "k", "e", modulus, n)), "k", "i", "h")
    starts = np.arange(0, n, band)

    def alike(a, b):
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), max(1, HELD // n)):
            s = slice(at, at + max(1, HELD // n))
            x, y = (signed.gather(*signed.find(k[s]), 2)[1].reshape(-1, n) for k in (a, b))
            out[s] = np.logical_and.reduceat(x == y, starts, axis=1).any(axis=1)
        return out

    got = pairs(rows, "k", "e", sizes=threshold, also=alike)
    got = got.select("a", "b", jaccard(F.col("n"), F.col("na"), F.col("nb")).alias("sim")).where(F.col("sim") >= threshold)
    return decoded(decoded(got, "a", back.get("k"), kind), "b", back.get("k"), kind).select("a", "b", "sim")
