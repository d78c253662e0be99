"""The library's own operators: small goldens worked out by hand, and a differential test of the miners."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import text as X
from lodestone.operators import cf, cluster, graph, itemsets, sketch


def test_text_functions(spark):
    df = spark.createDataFrame([("Las Vegas",), ("Montréal",)], "c string")
    assert [r[0] for r in df.select(X.utf8_mod(F.col("c"), 10_000)).collect()] == [8307, 8892]
    got = spark.range(1).select(X.trailing_zeros(F.lit(20)), X.trailing_zeros(F.lit(0)), X.plain_words(F.lit("A (b), a\nC")), X.letters(F.lit("A1 b\nc"))).head()
    assert list(got) == [2, 1, ["a", "b", "a", "c"], ["a", "bc"]]


def test_miners_agree(spark):
    rows = pd.DataFrame({"k": np.repeat(np.arange(120), 5), "i": np.random.default_rng(1).integers(0, 9, 600)})
    df = spark.createDataFrame(rows)
    found = [{(tuple(r["items"]), r["support"]) for r in f(df, "k", "i", 12).collect()} for f in (itemsets.apriori, itemsets.fp_growth, itemsets.son)]
    assert found[0] == found[1] == found[2] and max(len(i) for i, _ in found[0]) > 1
    edge = spark.createDataFrame([(k, "a" if k < 7 else "b") for k in range(25)], "k int, i string")
    assert {tuple(r[1]) for r in itemsets.fp_growth(edge, "k", "i", 7).collect()} == {("a",), ("b",)}
    assert itemsets.local_threshold(7, 25, 25) == 7


def test_graph_goldens(spark):
    two = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("D", "E"), ("D", "F"), ("D", "G"), ("E", "F"), ("F", "G")], "a string, b string")
    assert {r.id: r.community for r in graph.components(two).collect()} == {**dict.fromkeys("ABC", "A"), **dict.fromkeys("DEFG", "D")}
    path = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "a string, b string")
    assert {(r.a, r.b): r.value for r in graph.betweenness(path).collect()} == {("A", "B"): 3, ("B", "C"): 4, ("C", "D"): 3}


def test_girvan_newman_splits_at_the_bridge(spark):
    bridge = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "D"), ("D", "E"), ("D", "F"), ("E", "F")], "a string, b string")
    got = {r.id: r.community for r in graph.girvan_newman(bridge).collect()}
    assert got == {**dict.fromkeys("ABC", "A"), **dict.fromkeys("DEF", "D")}


def test_clusters(spark):
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(g * 100 + k, [float(g * 50 + rng.normal()), float(rng.normal())]) for g in range(3) for k in range(60)], "id long, vec array<double>")
    labels, centers = cluster.kmeans(pts, 3)
    assert len(centers) == 3 and {frozenset(r.id for r in v) for v in _by(labels.collect())} == {frozenset(range(g * 100, g * 100 + 60)) for g in range(3)}
    out, report = cluster.bfr([pts.where("id % 2 = 0"), pts.where("id % 2 = 1")], 3)
    rows = out.collect()
    assert len({r.id for r in rows}) == len(rows) == 180 and report.count() == 2
    three = spark.createDataFrame([(k, [float(k + j) for j in range(1, 4)]) for k in range(3)], "id long, vec array<double>")
    s = cluster.statistics(three, three.select("id", F.lit(0).alias("cluster"))).head()
    assert s.centroid == [2, 3, 4] and s.variance == pytest.approx([2 / 3] * 3)
    assert cluster.nmi(out.withColumn("t", F.floor(F.col("id") / 100)), "cluster", "t").head()[0] > 0.8


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster, []).append(r)
    return out.values()


def test_ratings_without_variance(spark):
    r = spark.createDataFrame([(u, i, 3.0) for u in range(4) for i in range(2)], "user long, item long, stars double")
    assert cf.model(r, "item", "user", 3).count() == 0
    assert cf.histogram(spark.createDataFrame([(0.4,), (7.2,)], "err double")).orderBy("bucket").collect()[-1].bucket == 8


def test_bloom_has_no_false_negatives(spark):
    known = spark.createDataFrame([(f"city {k}",) for k in range(50)] + [("",), (None,)], "c string")
    got = {r.c: r.verdict for r in sketch.bloom_probe(known, known, "c").collect()}
    assert got.pop("") == 0 and got.pop(None) == 0 and set(got.values()) == {1}


def test_graph_queries_take_every_pair(spark, tmp_path):
    """16 suppliers on a ring with chords: more edges than the largest cap had, against brute force."""
    rows = [(k, x) for k, (x, y) in enumerate((x, y) for x in range(16) for y in range(x + 1, 16)) for x in (x, y)] + [(900, 20), (900, 21), (901, 22), (901, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    q = catalog.queries()
    assert {r.id: r.degree for r in q["degree"](spark, str(tmp_path)).collect()} == {**dict.fromkeys(range(16), 15), 20: 1, 21: 1}
    for name in ("components", "label_propagation"):
        got = {r.id: r.community for r in q[name](spark, str(tmp_path)).collect()}
        assert set(got) == {*range(16), 20, 21} and len({got[k] for k in range(16)}) == 1 and not {got[20], got[21]} & {got[0]}
    assert {(r.a, r.b): r.value for r in q["betweenness"](spark, str(tmp_path)).collect()} == {**{(a, b): 1 for a in range(16) for b in range(a + 1, 16)}, (20, 21): 1}


def test_girvan_newman_query_takes_every_pair(spark, tmp_path):
    """Two cliques of five joined by one edge: 21 edges, more than the cap of 12."""
    pairs = [(x, y) for g in (0, 5) for x in range(g, g + 5) for y in range(x + 1, g + 5)] + [(4, 5)]
    spark.createDataFrame([(k, x) for k, p in enumerate(pairs) for x in p], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.id: r.community for r in catalog.queries()["girvan_newman"](spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5)}


def test_predictions_are_for_every_pair_of_the_facts(spark):
    d = "/root/testdata/sf0.001"
    line, order = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    want = {(r[0], r[1]) for r in line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").collect()}
    for name in ("cf_item_predict", "cf_user_predict", "svd_predict"):
        rows = catalog.queries()[name](spark, d).collect()
        assert len(rows) == len(want) and {(r.user, r.item) for r in rows} == want and all(r.pred is not None for r in rows)


def test_itemset_queries_have_no_largest_size(spark, tmp_path):
    brands = [f"b{k}" for k in range(7)]
    held = [(0, 1, 2, 3, 4, 5)] * 3 + [(1, 2, 3, 4, 6), (0, 6)]
    spark.createDataFrame([(k, b) for k, basket in enumerate(held) for b in basket], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(list(enumerate(brands)), "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k,) for k in range(len(held))], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    count = Counter(c for basket in held for n in range(1, 8) for c in combinations(basket, n))
    want = {(len(c), ",".join(brands[k] for k in c), n) for c, n in count.items() if n >= 2}
    assert max(n for n, _, _ in want) == 6
    for name in ("freq_itemsets", "freq_itemsets_son", "freq_itemsets_fp"):
        assert {tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == want
