"""Readers and report writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cf, cluster, explore, graph, itemsets
from lodestone.sources import files


def lines(path):
    return [x.rstrip("\n") for p in sorted(path.glob("part-*")) for x in p.open(encoding="utf-8")]


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "user_id string, stars double")
    files.write_json_lines(df, str(tmp_path / "j"))
    back = files.json_lines(spark, str(tmp_path / "j"), "user_id string, stars double")
    assert sorted(map(tuple, back.collect())) == [("a", 1.5), ("b", None)]
    files.write_model(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    (tmp_path / "map.json").write_text('{"x": 1, "y": 2}')
    assert {r.key: r.value for r in files.json_map(spark, str(tmp_path / "map.json")).collect()} == {"x": 1, "y": 2}


def test_csv_with_headers_inside(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,stars\nu1,3\nuser_id,stars\nu2,4\n")
    assert files.csv(spark, str(tmp_path / "a.csv"), "user_id string, stars string").count() == 3
    assert files.csv(spark, str(tmp_path / "a.csv"), "user_id string, stars string", "user_id").count() == 2
    (tmp_path / "b.csv").write_text("k,v\n1,2.5\n")
    assert files.csv_inferred(spark, str(tmp_path / "b.csv")).dtypes == [("k", "int"), ("v", "double")]
    files.write_single_csv(files.csv_inferred(spark, str(tmp_path / "b.csv")), str(tmp_path / "out"))
    assert lines(tmp_path / "out") == ["k,v", "1,2.5"]


def test_points_and_chunks_in_order_of_names(spark, tmp_path):
    for k in (2, 0, 1):
        (tmp_path / f"data{k}.txt").write_text("".join(f"{10 * k + i},{k}.5,{i}\n" for i in range(3)))
    got = files.chunks(spark, str(tmp_path))
    assert [sorted((r.id, r.vec) for r in c.collect()) for c in got] == [[(str(10 * k + i), [k + 0.5, float(i)]) for i in range(3)] for k in range(3)]
    (tmp_path / "wide.txt").write_text("7," + ",".join(["1"] * 3000) + "\n")
    assert len(files.points(spark, str(tmp_path / "wide.txt")).head().vec) == 3000


def test_stop_words(spark, tmp_path):
    (tmp_path / "s").write_text("the\n\n of \nthe\n")
    assert {r.word for r in files.stop_words(spark, str(tmp_path / "s")).collect()} == {"the", "of"}


def test_reports(spark, tmp_path):
    one = spark.createDataFrame([(3, None, "x")], "b int, c int, a string")
    files.write_lines(files.object_line(one), str(tmp_path / "o"))
    assert [*json.loads(lines(tmp_path / "o")[0])] == ["a", "b", "c"]
    sets = spark.createDataFrame([(1, ["b"], 3), (1, ["a"], 4), (2, ["a", "b"], 2)], "size int, items array<string>, support long")
    files.write_lines(files.itemset_report(sets, sets.where("size = 1")), str(tmp_path / "i"))
    assert lines(tmp_path / "i") == ["Candidates:", "('a'),('b')", "", "('a', 'b')", "", "Frequent Itemsets:", "('a'),('b')", ""]
    compared = itemsets.compare(sets, sets.where("size = 1"))
    assert [r.line for r in files.comparison_lines(compared).collect()] == ["First: 3", "Second: 2", "Intersection: 2"] and not compared.head().equal
    assert itemsets.compare(sets, sets).head().equal
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "a string, b string")
    assert [r.line for r in files.betweenness_lines(graph.betweenness(edges)).collect()] == ["('B', 'C'), 4.0", "('A', 'B'), 3.0", "('C', 'D'), 3.0"]
    members = spark.createDataFrame([("c", 1), ("a", 1), ("b", 2)], "id string, community int")
    assert [r.line for r in files.community_lines(members).collect()] == ["'b'", "'a', 'c'"]
    labels = spark.createDataFrame([(10, 1), (9, -1)], "id long, cluster int")
    assert files.label_object(labels).head().line == '{"9":-1,"10":1}'
    rated = spark.createDataFrame([(1, 2.0), (2, 4.0)], "item int, stars double")
    means = cf.averages(rated, "item", "stars")
    got = json.loads(files.averages_object(means.where("id <> 'UNK'"), means.where("id = 'UNK'")).head().json)
    assert got == {"1": 2.0, "2": 4.0, "UNK": 3.0}


def test_bfr_report(spark):
    pts = spark.createDataFrame([(k, [float(k % 3 * 50 + k / 99), 0.0]) for k in range(90)], "id long, vec array<double>")
    out, report = cluster.bfr([pts.where("id % 2 = 0"), pts.where("id % 2 = 1")], 3)
    got = [r.line for r in files.chunk_lines(report).collect()]
    assert got[0].startswith("round_id,nof_cluster_discard") and len(got) == 3 and got[2].startswith("2, 3, ")
    assert sorted(r.id for r in out.collect()) == list(range(90))


def test_compressed_sets_keep_all_their_points(spark):
    """A far group that only later chunks hold: it is compressed, summed in Spark and ends in the nearest cluster."""
    base = [(k, [float(k % 2 * 40) + (k * 7 % 13) / 10, (k * 5 % 11) / 10]) for k in range(120)]
    far = [(1000 + k, [200 + (k % 5) / 10, 300 + (k % 7) / 10]) for k in range(60)]
    one, two, three = (spark.createDataFrame(x, "id long, vec array<double>") for x in (base, far[:30], far[30:]))
    out, report = cluster.bfr([one, two, three], 2)
    got = {r.id: r.cluster for r in out.collect()}
    assert len(got) == 180 and out.count() == 180 and len({got[1000 + k] for k in range(60)}) == 1
    rows = report.orderBy("chunk").collect()
    assert rows[-1].n_compressed == 60 and all(r.n_discard + r.n_compressed + r.retained == n for r, n in zip(rows, (120, 150, 180)))


def test_partitions(spark):
    df = spark.createDataFrame([(f"{c}{k}",) for c in "abc" for k in range(7)] + [(None,), ("",)], "k string")
    got = {r.part: r.n for r in explore.partition_counts(df, "k", 5).collect()}
    assert got == {0: 2, 1: 0, 2: 7, 3: 7, 4: 7}
    assert [r.n for r in explore.round_robin_counts(df, 4).collect()].count(0) == 0
    assert explore.partitions(df.repartition(3)) == 3
    assert explore.top_counts(df, "k", 0).count() == 23 and explore.top_counts(df, "k", -1).count() == 23 and explore.top_counts(df, "k", 2).count() == 2


def test_predictable_pairs_are_those_with_a_like_item(spark):
    r = [(1, "a", 5.0), (1, "b", 3.0), (2, "a", 1.0), (2, "c", 2.0), (3, "d", 4.0), (4, "b", 2.0), (4, "c", 2.0)]
    m = [("a", "b", 0.9), ("c", "e", 0.4)]
    like = {p for a, b, _ in m for p in ((a, b), (b, a))}
    test = [(u, i) for u in (*range(1, 5), 9) for i in "abcdez"] * 2
    want = {(u, i) for u, i in test if any(v == u and (i, j) in like for v, j, _ in r)}
    args = spark.createDataFrame(test, "user long, item string"), spark.createDataFrame(r, "user long, item string, stars double"), spark.createDataFrame(m, "a string, b string, sim double")
    got = [(x.user, x.item) for x in cf.predictable(*args).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert cf.predictable(args[0].limit(0), *args[1:]).isEmpty() and cf.predictable(*args[:2], args[2].limit(0)).isEmpty()


def test_coverage_biases_and_hybrid(spark):
    r = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(12) for i in range(8) if (u * i) % 7], "user long, item long, stars double")
    got = cf.coverage(r.where("item < 4"), r).head()
    assert (got.matched, got.total) == (r.where("item < 4").count(), r.count())
    pred = cf.factorized(r, r.select("user", "item").union(spark.createDataFrame([(99, 1), (1, 99)], "user long, item long")))
    mean = r.agg(F.avg("stars")).head()[0]
    rows = {(x.user, x.item): x.pred for x in pred.collect()}
    fitted = sum((rows[x.user, x.item] - x.stars) ** 2 for x in r.collect())
    assert fitted < 0.5 * sum((mean - x.stars) ** 2 for x in r.collect()) and abs(rows[99, 1] - mean) < 3
    m = spark.createDataFrame([(1, 2, 0.5), (1, 3, -1.0), (1, 4, 0.5)], "a long, b long, sim double")
    given = spark.createDataFrame([(2, 7, 4.0), (3, 7, 2.0), (4, 7, 4.0), (2, 8, 5.0)], "user long, item long, stars double")
    test = spark.createDataFrame([(1, 7), (1, 8)], "user long, item long")
    out = {x.item: x.pred for x in cf.hybrid(test, given, m, test.withColumn("pred", F.lit(3.3))).collect()}
    assert out == {7: pytest.approx((4 * 0.5 + 4 * 1.0 + 4 * 0.5) / 2), 8: 3.3}
