"""Streams against their table forms, and sketches against plain counting."""

import random
import socket
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sketch
from lodestone.operators.similarity import hash_params
from lodestone.sources import files
from lodestone.streaming import windows

D = "/root/testdata/sf0.001"


def events(spark, tmp_path, parts=4, shuffled=False):
    df = spark.read.parquet(f"{D}/events.parquet")
    rows = df.orderBy(F.rand(3) if shuffled else F.col("ts")).withColumn("k", F.row_number().over(__import__("pyspark").sql.Window.orderBy(F.rand(3) if shuffled else F.col("ts"))))
    n = df.count()
    for k in range(parts):
        rows.where((F.col("k") > k * n // parts) & (F.col("k") <= (k + 1) * n // parts)).drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, windows.source(spark, str(tmp_path / "in"), df.schema)


def test_hashes_are_exact(spark):
    rng = random.Random(1)
    xs = [0, 1, 2**31, 2**62, sketch.MODULUS - 1] + [rng.randrange(sketch.MODULUS) for _ in range(200)]
    ps = hash_params(40) + [((1 << 20) - 1, (1 << 20) - 1), (0, 5)]
    df = spark.createDataFrame([(x, a, b) for x in xs for a, b in ps], "x long, a long, b long")
    for r in df.select("*", sketch.hashed(F.col("x"), F.col("a"), F.col("b")).alias("h")).collect():
        assert r.h == (r.a * r.x - r.b) % sketch.MODULUS


def test_estimates_are_those_of_plain_counting(spark):
    df = spark.createDataFrame([("a", k * k) for k in range(300)] * 2 + [("b", k) for k in range(7)] + [(None, 5), ("b", None)], "g string, x long")

    def plain(values):
        tails = []
        for a, b in hash_params(sketch.HASHES):
            t = [bin((a * x - b) % sketch.MODULUS)[2:] for x in values]
            tails.append(max(len(s) - len(s.rstrip("0")) for s in t))
        p = sorted(2.0**r for r in tails)
        return round(sorted(sum(p[k : k + 40]) / 40 for k in range(0, 200, 40))[2])

    got = {r.g: (r.truth, r.estimate) for r in sketch.distinct_estimate(df, ["g"], F.col("x")).collect()}
    assert got == {"a": (300, plain([k * k for k in range(300)])), "b": (7, plain(range(7))), None: (1, plain([5]))}


@pytest.mark.parametrize("shuffled", [False, True])
def test_closed_windows_of_a_stream_are_those_of_the_table(spark, tmp_path, shuffled):
    """With a lateness above the span of the data nothing is dropped, whatever the order."""
    df, stream = events(spark, tmp_path, shuffled=shuffled)
    span = "400 days" if shuffled else "1 hour"
    got: list = []
    windows.run(windows.distinct_windows(stream, "ts", F.col("user_id"), "6 hours", "2 hours", span, 20, 4), lambda f, _: got.extend(tuple(r) for r in f.collect()))
    want = {tuple(r) for r in windows.distinct_windows(df, "ts", F.col("user_id"), "6 hours", "2 hours", None, 20, 4).collect()}
    assert set(got) <= want and len(set(got)) == len(got)
    assert shuffled or len(got) > 0.9 * len(want)
    with pytest.raises(ValueError, match="late"):
        windows.distinct_windows(stream, "ts", F.col("user_id"), "6 hours", "2 hours")


def test_streams_append_and_trigger(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    windows.run(stream.select("event_id"), windows.append_csv(str(tmp_path / "csv")))
    assert files.csv(spark, str(tmp_path / "csv"), "event_id long").count() == df.count()
    seen: list = []
    query = windows.start(stream.select("event_id"), lambda f, n: seen.append((n, f.count())), every="1 second")
    query.processAllAvailable()
    query.stop()
    assert sum(n for _, n in seen) == df.count() and len([n for _, n in seen if n]) == 4


def test_reservoir_samples_uniformly_and_counts_tags(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([([f"t{10 * k + i % 10}", "all"],) for i in range(200)] + [([],), (None,)], "tags array<string>").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []
    stream = windows.source(spark, str(tmp_path / "in"), "tags array<string>", 2)
    report = tmp_path / "report.txt"
    each = windows.append_lines(str(report), files.sample_lines)
    windows.run(windows.reservoir(stream, "tags", 100, 5), lambda f, n: (got.extend(f.collect()), each(f, n)), "update")
    got.sort(key=lambda r: r.seen)
    last = got[-1]
    assert last.seen == 1000 and len(last.sample) == 100
    now = Counter(t for s in last.sample for t in s)
    assert {t.tag: t.n for t in last.tags if t.n} == dict(now) and now["all"] == 100
    assert {t.tag for r in got[:-1] for t in r.tags} <= {t.tag for t in last.tags}  # those that left stay listed
    by = Counter(int(s[0][1:]) // 10 for s in last.sample)
    assert all(5 <= by[k] <= 40 for k in range(5))
    text = report.read_text().splitlines()
    assert text[0].endswith(str(got[0].seen)) and "all : 100" in text and text[-1] == ""


def test_tagged_records(spark):
    df = spark.createDataFrame([("Vote now", ["a"], "en"), ("vote", [], "en"), ("other", ["a"], "en"), ("VOTE", ["b"], "de")], "text string, tags array<string>, lang string")
    assert windows.tagged(df, "text", "tags", ["vote"]).count() == 2
    assert windows.tagged(df, "text", "tags", ["vote"], "lang").count() == 1


def test_socket_lines(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        c.sendall(b'{"a": 1}\n{"a": 2}\n')
        ready.wait(60)
        c.close()

    ready = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    got: list = []
    query = windows.start(windows.socket_lines(spark, "127.0.0.1", server.getsockname()[1], "a int"), lambda f, _: got.extend(r.a for r in f.collect()), every="1 second")
    for _ in range(60):
        if len(got) == 2:
            break
        query.awaitTermination(0.5)
    query.stop()
    ready.set()
    assert sorted(got) == [1, 2]
