"""Counts, top lists, averages by category, and how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overview(df: DataFrame, user: str, date: str, year: int) -> DataFrame:
    """(n_rows, n_year, n_users) in one scan; a row is of the year if its date text holds it."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(date).cast("string").contains(str(year))).alias("n_year"), F.count_distinct(user).alias("n_users"))


def year_prefix(df: DataFrame, date: str, year: int) -> DataFrame:
    return df.where(F.col(date).cast("string").startswith(str(year)))


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys with most rows, all of them if k <= 0; equal counts by key."""
    ranked = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return ranked.limit(k) if k > 0 else ranked


def top_words(df: DataFrame, words: Column, stop: DataFrame, k: int) -> DataFrame:
    counted = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.join(stop, "word", "left_anti").orderBy(F.desc("n"), "word").limit(k)


def category_average(ratings: DataFrame, business: DataFrame, key: str, categories: Column, stars: str, k: int) -> DataFrame:
    """Mean stars by category, ranked by the rounded mean, equal ones by name. Categories that are null or empty
    as a whole text are left out; several rows of one business count severally."""
    cats = business.select(key, F.explode(categories).alias("category"))
    total = ratings.groupBy(key).agg(F.sum(stars).alias("s"), F.count(stars).alias("c"))  # before the join: fewer rows meet it
    mean = total.join(cats, key).groupBy("category").agg((F.sum("s") / F.sum("c")).alias("m"))
    return mean.select("category", F.round("m", 1).alias("avg_stars")).orderBy(F.desc("avg_stars"), "category").limit(k)


def over_threshold(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n)


def partition_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """(part, n) of all n partitions after partitioning by the first character of the key, by its code modulo n; empty
    ones too. Null and empty keys are in the first."""
    first = F.pmod(F.coalesce(F.ascii(F.col(key).cast("string")), F.lit(0)), F.lit(n))
    return _counted(df.select(key).repartitionById(n, first), n)


def round_robin_counts(df: DataFrame, n: int) -> DataFrame:
    """The same after dealing the rows out in turn."""
    return _counted(df.repartition(n), n)


def _counted(parts: DataFrame, n: int) -> DataFrame:
    count = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("c"))
    return df_range(parts, n).join(count, "part", "left").select("part", F.coalesce("c", F.lit(0)).alias("n"))


def df_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))


def partitions(df: DataFrame) -> int:
    """How many partitions the rows lie in as they are."""
    return df.rdd.getNumPartitions()


def semi_pairs(facts: DataFrame, chosen: DataFrame, key: str, *out: str) -> DataFrame:
    """The distinct pairs of facts whose key is chosen."""
    return facts.join(chosen.select(key), key, "left_semi").select(*out).distinct()
