"""Streams: distinct counts in sliding windows, keyword filters and reservoir samples.

Windows go by event time, so a result depends on the records, not on when they arrive."""

from __future__ import annotations

import heapq
import json
import random
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketch import GROUP, HASHES, distinct_estimate, fm_estimate, longest_tails


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def socket_lines(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """JSON lines from a socket."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def distinct_windows(df: DataFrame, ts: str, x: Column, length: str, slide: str, late: str | None = None, n: int = HASHES, group: int = GROUP) -> DataFrame:
    """(start, truth, estimate) of each window. A stream needs `late`: a record that comes later than so long after the
    latest one before is dropped, and a window is told when that time is over. Of a table nothing is dropped."""
    rows = df.select(F.col(ts).cast("timestamp").alias("ts"), x.cast("long").alias("x"))
    if not df.isStreaming:
        got = distinct_estimate(rows.select(F.window("ts", length, slide)["start"].alias("start"), "x"), ["start"], F.col("x"), n, group)
        return got.select("start", "truth", "estimate")
    if late is None:
        raise ValueError("a stream needs to know how late records may come")
    got = rows.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w")).agg(F.size(F.collect_set("x")).cast("long").alias("truth"), *longest_tails(F.col("x"), n))
    return got.select(F.col("w.start").alias("start"), "truth", fm_estimate(F.array(*(F.col(f"r{i}") for i in range(n))), n, group).alias("estimate"))


def tagged(df: DataFrame, text: str, tags: str, keywords: list[str], lang: str | None = None, language: str = "en") -> DataFrame:
    """Records with a keyword in their text and one tag at least, in one language if `lang` names its column."""
    hit = F.lower(text).rlike("|".join(keywords)) & (F.size(tags) > 0)
    return df.where(hit if lang is None else hit & (F.col(lang) == language))


def append_csv(folder: str):
    """For `run`: adds each micro-batch to the CSV files of a folder."""
    return lambda frame, _: frame.write.mode("append").option("header", True).csv(folder)


def append_lines(path: str, lines):
    """For `run`: adds the lines that `lines` makes of each micro-batch, a report of a few rows, to a text file."""

    def each(frame: DataFrame, _: int) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(r["line"] + "\n" for r in lines(frame).toLocalIterator())

    return each


def start(df: DataFrame, each, mode: str = "append", every: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to each(frame, number): every so often, or, if `every` is None, until what is there is
    worked off."""
    writer = df.writeStream.foreachBatch(each).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def run(df: DataFrame, each, mode: str = "append", checkpoint: str | None = None, timeout: float = 120) -> None:
    """Works off what is there."""
    query = start(df, each, mode, None, checkpoint)
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream has not ended")


def reservoir(df: DataFrame, tags: str, size: int = 100, seed: int = 0) -> DataFrame:
    """Reservoir sampling with state; for `run` in update mode. After each micro-batch: (seen, sample, tags), the number
    of records so far, the sampled ones' tags, and the counts of all tags ever sampled, 0 for those that left.

    Each record draws a priority by (seed, batch, partition, position), and the `size` lowest are the sample: every
    record is in it with equal probability, as if record n replaced a random one with probability size / n. So a
    partition passes on its lowest ones and a count only, and the state merges these. Records without tags are left out."""

    def lowest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        rng = random.Random(f"{seed}:{context.getLocalProperty('streaming.sql.batchId')}:{context.partitionId()}")
        seen, kept = 0, []
        for f in frames:
            for t in f["tags"]:
                seen += 1
                drawn = (-rng.random(), seen, [str(x) for x in t])
                if len(kept) < size:
                    heapq.heappush(kept, drawn)
                else:
                    heapq.heappushpop(kept, drawn)
        if seen:
            yield pd.DataFrame({"one": 0, "n": seen, "kept": [[{"priority": -p, "tags": t} for p, _, t in kept]]})

    def merge(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, kept, counts = (state.get[0], json.loads(state.get[1]), json.loads(state.get[2])) if state.exists else (0, [], {})
        for f in frames:
            seen += int(f["n"].sum())
            kept += [[k["priority"], [*k["tags"]]] for row in f["kept"] for k in row]
        kept = sorted(kept)[:size]
        now = Counter(t for _, own in kept for t in own)
        counts = {t: now.get(t, 0) for t in {*counts, *now}}
        state.update((seen, json.dumps(kept), json.dumps(counts)))
        yield pd.DataFrame({"seen": [seen], "sample": [[own for _, own in kept]], "tags": [[{"tag": t, "n": n} for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]]})

    rows = df.where(F.size(tags) > 0).select(F.col(tags).cast("array<string>").alias("tags"))
    part = rows.mapInPandas(lowest, "one int, n long, kept array<struct<priority: double, tags: array<string>>>")
    return part.groupBy("one").applyInPandasWithState(merge, "seen long, sample array<array<string>>, tags array<struct<tag: string, n: long>>", "seen long, kept string, counts string", "update", "NoTimeout")
