"""Cutting lineage in loops, on storage that outlives executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir. Only where that is unset, as in tests, an own folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def mounted(spark: SparkSession) -> str:
    """The same as a path that every executor can open and map; the shared folder has to be mounted."""
    path = folder(spark)
    found = re.fullmatch(r"(?:(\w+):)?(?://)?(/.*)", path)
    if not found or found[1] not in (None, "file"):
        raise ValueError(f"arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {path}")
    return found[2]


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir. Unlike a checkpoint it is computed once, not twice,
    and is compressed."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.is_cut = True
    return out


def once(df: DataFrame) -> DataFrame:
    """df for several reads: cut, unless it is that already."""
    return df if getattr(df, "is_cut", False) else cut(df)
