"""Pairs of ids that share an element, by a self-join on the element (an inverted index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sharing(rows: DataFrame, key: str, element: str, *carry: str) -> DataFrame:
    """(a, b, element) with a < b, and each carried column c as c_a and c_b. Pairs without a common element never
    arise, unlike in a cartesian product; the rows of one element do pair up, so elements should be selective."""
    a = rows.select(F.col(element), F.col(key).alias("a"), *(F.col(c).alias(f"{c}_a") for c in carry))
    b = rows.select(F.col(element), F.col(key).alias("b"), *(F.col(c).alias(f"{c}_b") for c in carry))
    return a.join(b, element).where("a < b")
