"""The folder that all executors share, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import atexit
import pickle
import re
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many bytes, with 40 a row for a hash relation, are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 40 << 20


def folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir. Only where that is unset, as in tests, an own folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def mounted(spark: SparkSession) -> str:
    """The same as a path that every executor can open and map; the shared folder has to be mounted."""
    path = folder(spark)
    scheme, _, rest = path.partition("://")
    if not rest:
        return path
    if scheme != "file":
        raise ValueError(f"arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {scheme}://")
    return rest


def shipped(spark: SparkSession, value) -> Broadcast:
    """value for all executors, its classes with it, so they need no copy of the library. For values of a fixed size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held: Broadcast):
    return pickle.loads(held.value)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small enough; measured, not guessed."""
    row = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema), F.lit(40)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(row)).head()[0] or 0) <= limit else df


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs whose key isn't in the one column of ids. A null key is never in it."""
    name = f"_gone_{uuid.uuid4().hex[:8]}"
    gone = small(ids.toDF(name))
    return docs.join(gone, docs[key] == gone[name], "left_anti")


def unused() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def text_of(docs: DataFrame, text: str) -> Column:
    return docs[text].cast("string")
