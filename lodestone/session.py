"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
