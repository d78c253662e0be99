"""Sums over pairs from mapped lists, against plain versions: no plan joins or groups pairs."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cf, cluster, content, graph, itemsets, similarity
from lodestone.plans import lists


def _ratings(spark, users=40, items=25, n=400, ids=lambda k: k):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"user": rng.integers(0, users, n), "item": rng.integers(0, items, n), "stars": rng.integers(1, 6, n).astype(float)}).drop_duplicates(["user", "item"])
    rows["user"], rows["item"] = [ids(k) for k in rows["user"]], [ids(k) for k in rows["item"]]
    return rows, spark.createDataFrame(rows)


def _plain(rows, of, by, least, keep=lambda s: s > 0):
    out = {}
    held = {k: dict(zip(g[by], g["stars"])) for k, g in rows.groupby(of)}
    for a in held:
        for b in held:
            both = sorted(held[a].keys() & held[b].keys())
            if a != b and len(both) >= least:
                x, y = np.array([held[a][e] for e in both]), np.array([held[b][e] for e in both])
                v = round(float(((x - x.mean()) * (y - y.mean())).sum() / np.sqrt(((x - x.mean()) ** 2).sum() * ((y - y.mean()) ** 2).sum())), 6) if x.std() > 1e-6 and y.std() > 1e-6 else 0.0
                if keep(v):
                    out[a, b] = v
    return out


def _flat(df):
    """The plan of df, which must read no pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return plan


def test_item_predictions_need_no_join_of_pairs(spark, monkeypatch):
    rows, r = _ratings(spark)
    sim, held = _plain(rows, "item", "user", 3), {u: dict(zip(g["item"], g["stars"])) for u, g in rows.groupby("user")}
    for bound in (1 << 20, 50):  # lists in one step, and in several for each key
        monkeypatch.setattr(lists, "HELD", bound)
        got = cf.predict_items(r.select("user", "item"), r, cf.Like("item", "user", 3))
        assert _flat(got).count("Join") <= 4  # of the tested pairs, each once; never of item with item
        for x in got.collect():
            near = sorted((-sim[x.item, b], b) for b in held[x.user] if (x.item, b) in sim)[:5]
            want = sum(-s * held[x.user][b] for s, b in near) / sum(-s for s, _ in near) if near else rows[rows["item"] == x.item]["stars"].mean()
            assert x.pred == pytest.approx(want, abs=1e-4)


def _count_pairs(rows, of, by):
    held = {k: set(g[by]) for k, g in rows.groupby(of)}
    return {(a, b): (len(held[a] & held[b]), len(held[a]), len(held[b])) for a in held for b in held if a < b and held[a] & held[b]}


def test_lsh_candidates_do_not_travel(spark):
    rows, r = _ratings(spark)
    want = {(a, b): c / (na + nb - c) for (a, b), (c, na, nb) in _count_pairs(rows, "item", "user").items()}
    for band in (1, 3):  # seven components, so the last band is short
        sig = {}
        for x in similarity.signatures(r, "item", "user", 40, 7).collect():
            sig.setdefault(x.k, {})[x.i] = x.h
        hit = {p for p in want if any(all(sig[p[0]][i] == sig[p[1]][i] for i in range(g, min(g + band, 7))) for g in range(0, 7, band))}
        got = similarity.lsh(r, "item", "user", 40, 0.2, 7, band)
        assert "Join" not in _flat(got)
        assert {(x.a, x.b): x.sim for x in got.collect()} == {p: want[p] for p in hit if want[p] >= 0.2}


def _paths(edges):
    """Brandes' sums in plain Python."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = dict.fromkeys(edges, 0.0)
    for root in near:
        dist, sigma, order = {root: 0}, {root: 1.0}, [root]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    x = credit[w] * sigma[v] / sigma[w]
                    credit[v] += x
                    out[min(v, w), max(v, w)] += x / 2
    return out


def test_betweenness_makes_no_row_for_a_root_and_node(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 30, (70, 2)) if p[0] != p[1]}) + [(90, 91), (91, 95)]
    df, want = spark.createDataFrame(edges, "a long, b long"), _paths(edges)
    for bound in (4096, 8):  # as matrices, and along lists
        monkeypatch.setattr(graph, "DENSE", bound)
        made = graph.betweenness(df)
        assert "root" not in made._jdf.queryExecution().executedPlan().toString()
        got = {(x.a, x.b): x.value for x in made.collect()}
        assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], abs=1e-8) for e in want)


def test_label_propagation_groups_no_edges(spark):
    rng = np.random.default_rng(4)
    edges = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (150, 2)) if p[0] != p[1]})
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {v: v for v in near}
    for _ in range(3):
        votes = {v: pd.Series([label[w] for w in near[v]]).value_counts() for v in near}
        label = {v: int(min(c.index[c == c.max()])) for v, c in votes.items()}
    for name in (int, lambda v: f"n{v:02d}"):
        got = graph.label_propagation(spark.createDataFrame([(name(a), name(b)) for a, b in edges], ["a", "b"]), 3)
        assert "Aggregate" not in _flat(got)
        assert {x.id: x.community for x in got.collect()} == {name(v): name(c) for v, c in label.items()}


def test_profiles_are_united_without_shuffling_terms(spark):
    profile = spark.createDataFrame([("x", t) for t in "abc"] + [("y", t) for t in "cd"] + [("z", "e")], "source string, term string")
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (3, "none"), (None, "z")], "u long, source string")
    got = content.user_profiles(pairs, profile, "u", "source")
    assert "Join" not in _flat(got)
    assert sorted(map(tuple, got.collect())) == [(1, t) for t in "abcd"] + [(2, "c"), (2, "d")]
    own = content.own_scores(pairs, profile, "u", "source")
    assert "Join" not in _flat(own)
    want = content.scores(pairs, got, profile, "u", "source")
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in want.collect()} != set()


def test_kmeans_rounds_are_single_jobs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) + np.repeat(np.arange(3), 100)[:, None] * 3
    pts = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    monkeypatch.setattr(type(pts), "toPandas", lambda self: pytest.fail("a round makes a table"))
    labels, centers = cluster.kmeans(pts, 3)
    c = [x[0]]
    while len(c) < 3:
        c.append(x[np.min([((x - v) ** 2).sum(axis=1) for v in c], axis=0).argmax()])
    c = np.array(c)
    for _ in range(100):
        lab = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[lab == j].mean(axis=0) for j in range(3)])
    assert np.allclose(centers, c) and {r.id: r.cluster for r in labels.collect()} == dict(enumerate(lab.tolist()))


def test_factor_predictions_are_joined_with_nothing(spark):
    rows, r = _ratings(spark)
    test = r.select("user", "item").union(spark.createDataFrame([(99, 1), (99, 999)], "user long, item long"))
    got = cf.factorized(r, test)
    assert "Join" not in _flat(got)
    pred = {(x.user, x.item): x.pred for x in got.collect()}
    mean, item, _ = cf.biases(r)
    gm, bi = mean.head()[0], {x.item: x.bi for x in item.collect()}
    assert pred[99, 999] == pytest.approx(gm) and pred[99, 1] == pytest.approx(gm + bi[1])
    err = [pred[u, i] - s for u, i, s in rows.itertuples(index=False)]
    assert len(pred) == len(rows) + 2 and np.sqrt(np.mean(np.square(err))) < rows["stars"].std()


def test_itemset_levels_join_no_baskets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"k": np.repeat(np.arange(150), 6), "i": [f"b{x}" for x in rng.integers(0, 12, 900)]}).drop_duplicates()
    df = spark.createDataFrame(rows)
    count = Counter(c for _, g in rows.groupby("k") for n in range(1, 7) for c in combinations(sorted(g["i"]), n))
    joined, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *a, **k: joined.append(1) or join(self, *a, **k))
    got = itemsets.apriori(df, "k", "i", 8)
    assert len(joined) == 1  # items with their numbers, at no later level
    assert {(tuple(r["items"]), r["support"]) for r in got.collect()} == {(c, n) for c, n in count.items() if n >= 8}
    assert max(r["size"] for r in got.collect()) > 2


def test_predictions_equal_those_of_a_given_model(spark):
    """What is alike, found on the way, against models that are joined as tables."""
    rows, r = _ratings(spark)
    test = r.select("user", "item").union(spark.createDataFrame([(1, 999), (99, 1), (2, 3)], "user long, item long")).distinct()
    users = _plain(rows, "user", "item", 2)
    made = cf.model(r, "user", "item", 2)
    assert "Join" not in _flat(made)
    assert {(x.a, x.b): x.sim for x in made.collect()} == pytest.approx({p: s for p, s in users.items() if p[0] < p[1]}, abs=2e-6)
    flat = lambda df: {(x.user, x.item): x.pred for x in df.collect()}
    assert flat(cf.predict_users(test, r, cf.Like("user", "item", 2))) == pytest.approx(flat(cf.predict_users(test, r, made)))
    strong, mean = cf.model(r, "user", "item", 2, keep=cf.strong), test.withColumn("pred", F.lit(3.3))
    assert flat(cf.hybrid(test, r, cf.Like("user", "item", 2, keep=cf.strong), mean)) == pytest.approx(flat(cf.hybrid(test, r, strong, mean)))
    got = cf.coverage(cf.predictable(test, r, cf.Like("item", "user", 3)), r).head()
    assert got == cf.coverage(cf.predictable(test, r, cf.model(r, "item", "user", 3)), r).head() and got.matched > 0


def test_shared_elements_are_counted_without_a_join(spark):
    rows, r = _ratings(spark, ids=lambda k: f"id{k:03d}")
    want = _count_pairs(rows, "item", "user")
    got = graph.co_occurrence(r.withColumn("user", F.col("user")), "item", "user")
    assert {(x.a, x.b): x.common for x in got.collect()} == {p: c for p, (c, _, _) in want.items()}
    numbers = similarity.exact(r.select(F.substring("item", 3, 3).cast("int").alias("item"), F.substring("user", 3, 3).cast("int").alias("user")), "item", "user", 0.2)
    assert "Join" not in _flat(numbers)
    assert {(f"id{x.a:03d}", f"id{x.b:03d}"): x.sim for x in numbers.collect()} == {p: c / (na + nb - c) for p, (c, na, nb) in want.items() if c / (na + nb - c) >= 0.2}
