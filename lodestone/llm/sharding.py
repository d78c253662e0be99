"""Two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets of about `bucket_bytes` by a seeded hash of their content; records
that come so often that their copies would fill a sixteenth of a bucket are told apart by where they stand, too, so
the copies spread as all others do. Pass 2 puts each bucket in a canonical order, shuffles it by Fisher-Yates with a
generator seeded by (seed, bucket), and numbers the positions. The result depends on the records and the seed, not on
partitions, file order or repeated tasks; only to which buckets the copies of such a frequent record go also depends
on the input's partitions.

Defined results: every row of the input comes out once, repeated rows as often as they came; nulls in any
column are values like others, texts of any length stay whole; an empty table gives an empty result. Columns named
shard or position are replaced, all others may have any name and type, maps and nested columns too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small, written


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation; numpy's permutation is Fisher-Yates on an index array."""
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed))).permutation(n)


def _shuffle(seed: int):
    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one bucket, which is sized to fit
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        n = table.num_columns - 3  # the last are the bucket and two hashes
        bucket = table.column(n)[0].as_py()
        order = np.lexsort((table.column(n + 2).to_numpy(), table.column(n + 1).to_numpy()))
        order = order[fisher_yates(len(order), (seed, bucket))]
        table = table.select([*range(n + 1)])
        for lo in range(0, len(order), 2000):
            part = table.take(pa.array(order[lo : lo + 2000])).combine_chunks()
            part = part.append_column("position", pa.array(np.arange(lo, lo + len(part), dtype=np.int64)))
            yield from part.to_batches()

    return shuffle


def _plain(kind: T.DataType, c: Column) -> Column:
    """c in a form that can be hashed: maps as arrays of entries in order, at any depth."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_plain(kind.keyType, e["key"]).alias("k"), _plain(kind.valueType, e["value"]).alias("v")))
        return F.array_sort(F.transform(entries, lambda e: F.struct(F.xxhash64(e["k"]).alias("h"), e["v"].alias("v"))), lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _plain(kind.elementType, e)) if _has_map(kind) else c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_plain(f.dataType, c.getField(f.name)).alias(f"f{k}") for k, f in enumerate(kind)))) if _has_map(kind) else c
    return c


def _has_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)


def _bytes(kind: T.DataType, c: Column) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda s, x: s + _bytes(kind.elementType, x)), F.lit(8).cast("long"))
        return 8 + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8
    if isinstance(kind, T.MapType):
        return _bytes(T.ArrayType(kind.keyType), F.map_keys(c)) + _bytes(T.ArrayType(kind.valueType), F.map_values(c))
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, c.getField(f.name)) for f in kind), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def shuffled(df: DataFrame, seed: int = 42, bucket_bytes: int = 24 << 20) -> DataFrame:
    """df's columns with shard (int) and position (bigint) in it."""
    kinds = [f for f in df.schema if f.name.lower() not in ("shard", "position")]
    df = df.select(*(df[f"`{f.name}`"].alias(f"c{k}") for k, f in enumerate(kinds)))
    cols = [F.col(c) for c in df.columns]
    size = sum((_bytes(f.dataType, c) for f, c in zip(kinds, cols)), F.lit(8).cast("long"))
    content = [_plain(f.dataType, c) for f, c in zip(kinds, cols)]
    hashed = df.select(*cols, F.xxhash64(F.lit(seed), *content).alias("h"), F.hash(F.lit(seed + 1), *content).alias("g"))
    held = written(hashed.select("h", size.alias("b")).groupBy("h").agg(F.sum("b").alias("b"), F.count("*").alias("n")))
    buckets = max(1, -(-int(held.agg(F.sum("b")).head()[0] or 0) // bucket_bytes))
    often = held.where((F.col("n") > 1) & (F.col("b") > bucket_bytes // 16)).select("h", F.lit(True).alias("often"))
    at = F.when(F.col("often"), F.monotonically_increasing_id())
    keyed = hashed.join(small(often), "h", "left").select(*cols, F.pmod(F.xxhash64(F.lit(seed), "h", at), F.lit(buckets)).cast("int").alias("shard"), "h", "g")
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(df.columns, kinds)), T.StructField("shard", T.IntegerType()), T.StructField("position", T.LongType())])
    out = keyed.repartitionById(buckets, F.col("shard")).mapInArrow(_shuffle(seed), schema)
    return out.toDF(*(f.name for f in kinds), "shard", "position")


def write(df: DataFrame, path: str, **options) -> None:
    """One folder a shard, in shuffled order."""
    shuffled(df, **options).write.partitionBy("shard").parquet(path)
