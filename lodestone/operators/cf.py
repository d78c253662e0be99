"""Collaborative filtering: Pearson models, predictions, averages and errors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import once
from ..plans.lists import Cells, Sums, by_key, chunks, coded, decoded, lists, sent


def ratings(df: DataFrame, user: str, item: str, stars: str) -> DataFrame:
    """(user, item, stars): the mean of repeated ratings."""
    return df.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(stars).cast("double").alias("stars")).dropna().groupBy("user", "item").agg(F.avg("stars").alias("stars"))


class Like:
    """What makes two of `of` alike: the Pearson correlation over what both rated, at least `least` of it, 0 if one has
    no variance there, rounded to six digits and kept if `keep` says so. `jaccard` also asks for that similarity of the
    rated sets."""

    def __init__(self, of: str, by: str, least: int, jaccard: float | None = None, keep: Callable | None = None):
        self.of, self.by, self.least, self.jaccard, self.keep = of, by, least, jaccard, keep or (lambda sim: sim > 0)

    def sized(self, r: DataFrame) -> DataFrame:
        return r if self.jaccard is None else r.join(r.groupBy(self.of).agg(F.count("*").cast("double").alias("_size")), self.of)

    def similar(self, chunk, s) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sums are of alike ones, and their correlations."""
        n = s.n
        vx, vy = s.sxx - s.sx * s.sx / n, s.syy - s.sy * s.sy / n
        ok = (vx > 1e-9) & (vy > 1e-9)
        v = np.where(ok, (s.sxy - s.sx * s.sy / n) / np.sqrt(np.where(ok, vx * vy, 1.0)), 0.0)
        v = np.copysign(np.floor(np.abs(v) * 1e6 + 0.5) / 1e6, v) + 0.0
        at = self.keep(v)
        if self.jaccard is not None:
            rated = ~np.isnan(chunk.rows[0])
            size = np.bincount(chunk.k[rated], minlength=len(chunk.ids))[s.k]
            at &= n / (size + s.cb - n) >= self.jaccard
        return at, v


def model(r: DataFrame, of: str, by: str, least: int, jaccard: float | None = None, keep: Callable | None = None) -> DataFrame:
    """(a, b, sim) of all that are alike, a < b (see `Like`)."""
    like, kind = Like(of, by, least, jaccard, keep), r.schema[of].dataType
    r, back = coded(r.select(of, by, F.col("stars").cast("double").alias("stars")).dropna(), of, by)
    r = once(like.sized(once(r))) if jaccard is not None else once(r)
    more = ["_size"] * (jaccard is not None)
    of_by = lists(r, by, of, "stars", *more)

    def work(batches):
        for c in chunks(of_by, batches, 2 + len(more)):
            s = Sums(c, least, True, True, bool(more))
            at, sim = like.similar(c, s)
            yield from sent({"a": c.ids[s.k[at]], "b": s.b[at], "sim": sim[at]})

    rows = r.select(F.col(of).cast("long").alias(of), F.col(by).cast("long").alias(by), "stars")
    got = by_key(rows, of, by, "stars").mapInArrow(work, "a long, b long, sim double")
    return decoded(decoded(got, "a", back.get(of), kind), "b", back.get(of), kind).select("a", "b", "sim")


def strong(sim="sim"):
    """For a column or an array."""
    sim = F.col(sim) if isinstance(sim, str) else sim
    return (sim >= 0.5) | (sim <= -0.8)


def _from_alike(test: DataFrame, r: DataFrame, like: Like, neighbours: int | None = None, centred: bool = False, top: float | None = None) -> DataFrame:
    """(user, item, n, p) of the tested pairs for which something alike was rated: of an item, what the user rated that
    is like it; of a user, who rated the item and is like them. n of them count, p is their mean weighted by the size
    of the similarity: the `neighbours` most alike, equal ones by id, or all. `centred` takes the deviation from
    each one's own mean; with `top`, a negative similarity turns a rating round on the scale of 1 to top.

    Similarities and predictions come from the same lists, key by key, so neither the model nor its join with the
    ratings is ever written down."""
    of, by, kinds = like.of, like.by, {c: r.schema[c].dataType for c in ("user", "item")}
    r = r.select("user", "item", F.col("stars").cast("double").alias("stars")).dropna()
    wanted = test.select("user", "item").dropna().distinct().withColumn("_test", F.lit(1.0))
    whole_ = once(r.join(wanted, ["user", "item"], "full").withColumn("_test", F.coalesce("_test", F.lit(0.0))))
    rows, back = coded(whole_, "user", "item")
    rows = once(rows) if back else whole_
    rated = rows.where("stars is not null").select("user", "item", "stars")
    carried = rated
    if centred:
        carried = carried.join(rated.groupBy(of).agg(F.avg("stars").alias("_mean")), of)
    carried = like.sized(carried)
    more = ["_mean"] * centred + ["_size"] * (like.jaccard is not None)
    of_by = lists(once(carried) if more else rated, by, of, "stars", *more)

    def work(batches):
        for c in chunks(of_by, batches, 2 + len(more)):
            stars, wanted = c.rows[0], c.rows[1] > 0
            known = ~np.isnan(stars)
            s = Sums(c, like.least, False, True, like.jaccard is not None, None if known.all() else known)
            at, sim = like.similar(c, s)
            k, b, sim = s.k[at], s.b[at], sim[at]
            if not len(k):
                continue
            alike = Cells(k, b, len(c.ids))
            weight = np.empty(len(alike.codes))
            weight[alike.cell] = sim
            m = len(stars)
            n, num, den = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            for row, own, got in c.steps():
                cell = alike.find(own, got[0])
                hit = (cell >= 0) & wanted[row]
                row, w, y = row[hit], weight[cell[hit]], got[1][hit]
                if neighbours is not None:
                    # b ascends within a row, so a stable order leaves equal ones by id
                    order = np.argsort((row << 22) - np.rint(w * 1e6).astype(np.int64), kind="stable")
                    first = np.flatnonzero(np.diff(row[order], prepend=-1))
                    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                    order = order[rank < neighbours]
                    row, w, y = row[order], w[order], y[order]
                    hit = np.flatnonzero(hit)[order]
                if centred:
                    y = y - got[2][hit]
                if top is not None:
                    y = np.where(w < 0, top + 1 - y, y)
                n += np.bincount(row, minlength=m)
                num += np.bincount(row, y * np.abs(w) if top is not None else y * w, m)
                den += np.bincount(row, np.abs(w), m)
            out = np.flatnonzero(n)
            yield from sent({of: c.ids[c.k[out]], by: c.elements[out], "n": n[out], "p": np.divide(num[out], den[out], out=np.full(len(out), np.nan), where=den[out] > 0)})

    keyed = rows.select(F.col(of).cast("long").alias(of), F.col(by).cast("long").alias(by), "stars", "_test")
    got = by_key(keyed, of, by, "stars", "_test").mapInArrow(work, f"{of} long, {by} long, n long, p double")
    for c in ("user", "item"):
        got = decoded(got, c, back.get(c), kinds[c])
    return got.select("user", "item", "n", F.when(~F.isnan("p"), F.col("p")).alias("p"))


def both_ways(m: DataFrame) -> DataFrame:
    return m.select("a", "b", "sim").unionAll(m.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _rated_alike(test: DataFrame, r: DataFrame, m: DataFrame) -> DataFrame:
    """(user, item, b, stars, sim): what the user of a pair rated that is like its item."""
    # what the user rated first: far less than all that is like the item
    rated = test.select("user", "item").distinct().join(r.select("user", F.col("item").alias("b"), "stars"), "user")
    return rated.join(both_ways(m).withColumnRenamed("a", "item"), ["item", "b"])


def predictable(test: DataFrame, r: DataFrame, m: DataFrame | Like) -> DataFrame:
    """(user, item): the pairs that an item model m predicts, without means to fall back on."""
    if isinstance(m, Like):
        return _from_alike(test, r, m).select("user", "item")
    return _rated_alike(test, r, m).select("user", "item").distinct()


def predict_items(test: DataFrame, r: DataFrame, m: DataFrame | Like, neighbours: int = 5) -> DataFrame:
    """(user, item, pred): from the user's rated items most like the item; else the item's mean, else that of all. m
    is a model, or says what is alike; then none is made."""
    best = _from_alike(test, r, m, neighbours) if isinstance(m, Like) else _best_items(test, r, m, neighbours)
    mean = r.groupBy("item").agg(F.avg("stars").alias("im"))
    return test.join(best.select("user", "item", "p"), ["user", "item"], "left").join(mean, "item", "left").crossJoin(F.broadcast(r.agg(F.avg("stars").alias("gm")))).select(*test.columns, F.coalesce("p", "im", "gm").alias("pred"))


def _best_items(test: DataFrame, r: DataFrame, m: DataFrame, neighbours: int) -> DataFrame:
    near = _rated_alike(test, r, m)
    rank = F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc("sim"), "b"))
    return near.withColumn("k", rank).where(F.col("k") <= neighbours).groupBy("user", "item").agg(F.try_divide(F.sum(F.col("stars") * F.col("sim")), F.sum(F.abs("sim"))).alias("p"))


def predict_users(test: DataFrame, r: DataFrame, m: DataFrame | Like, neighbours: int = 5) -> DataFrame:
    """(user, item, pred): the user's mean plus the weighted deviations of like users who rated the item. m as for
    predict_items."""
    mean = r.groupBy("user").agg(F.avg("stars").alias("um"))
    best = _from_alike(test, r, m, neighbours, centred=True).select("user", "item", F.col("p").alias("d")) if isinstance(m, Like) else _best_users(test, r, m, neighbours, mean)
    return test.join(best, ["user", "item"], "left").join(mean, "user", "left").crossJoin(F.broadcast(r.agg(F.avg("stars").alias("gm")))).select(*test.columns, (F.coalesce("um", "gm") + F.coalesce("d", F.lit(0.0))).alias("pred"))


def _best_users(test: DataFrame, r: DataFrame, m: DataFrame, neighbours: int, mean: DataFrame) -> DataFrame:
    near = test.select("user", "item").distinct().join(both_ways(m).withColumnRenamed("a", "user"), "user").join(r.select(F.col("user").alias("b"), "item", "stars"), ["b", "item"]).join(mean.toDF("b", "bm"), "b")
    rank = F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc("sim"), "b"))
    return near.withColumn("k", rank).where(F.col("k") <= neighbours).groupBy("user", "item").agg(F.try_divide(F.sum((F.col("stars") - F.col("bm")) * F.col("sim")), F.sum(F.abs("sim"))).alias("d"))


def averages(df: DataFrame, item: str, stars: str) -> DataFrame:
    """(id, avg) of each item, and a row UNK with the mean of all."""
    own = df.groupBy(F.col(item).cast("string").alias("id")).agg(F.avg(stars).alias("avg")).where("id is not null")
    return own.unionAll(df.agg(F.lit("UNK").alias("id"), F.avg(stars).alias("avg")))


def errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(err) of all pairs in both; repeated pairs of the truth are averaged."""
    t = truth.groupBy("user", "item").agg(F.avg("stars").alias("stars"))
    return pred.join(t, ["user", "item"]).select(F.abs(F.col("pred") - F.col("stars")).alias("err"))


def rmse(err: DataFrame) -> DataFrame:
    return err.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))


def histogram(err: DataFrame, least: int = 6) -> DataFrame:
    """(bucket, n) by the error rounded up; buckets 0 to least - 1 are always there, larger ones where they occur."""
    got = err.groupBy(F.ceil("err").cast("long").alias("bucket")).agg(F.count("*").alias("c"))
    return err.sparkSession.range(least).toDF("bucket").join(got, "bucket", "full").select("bucket", F.coalesce("c", F.lit(0)).alias("n"))


def coverage(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(matched, total): the pairs of the truth, and how many of them are predicted."""
    t = truth.select("user", "item").distinct()
    hit = pred.select("user", "item").distinct().withColumn("hit", F.lit(1))
    return t.join(hit, ["user", "item"], "left").agg(F.count("hit").alias("matched"), F.count("*").alias("total"))


def biases(r: DataFrame, item_reg: float = 10.0, user_reg: float = 15.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean (gm), each item's deviation (item, bi) and each user's deviation beyond those (user, bu), shrunk."""
    mean = r.agg(F.avg("stars").alias("gm"))
    off = r.crossJoin(F.broadcast(mean)).withColumn("d", F.col("stars") - F.col("gm"))  # one row
    item = off.groupBy("item").agg((F.sum("d") / (F.count("*") + item_reg)).alias("bi"))
    user = off.join(item, "item").groupBy("user").agg((F.sum(F.col("d") - F.col("bi")) / (F.count("*") + user_reg)).alias("bu"))
    return mean, item, user


def factorized(r: DataFrame, test: DataFrame, rank: int = 10, rounds: int = 10, reg: float = 0.1) -> DataFrame:
    """(user, item, pred): biased factors, mean + item's bias + user's bias + p * q. The factors come from alternating
    least squares on what the biases leave, not from stochastic gradient steps, so they are not numerically those of
    such a model. Unknown users or items have no part of their own. Biases and factors are looked up in mapped lists, so
    ratings and predictions are joined with nothing."""
    from pyspark.ml.recommendation import ALS

    r = once(r)
    mean, item, user = biases(r)
    gm = mean.head()[0]
    if gm is None:
        return test.select(F.col("user").cast("int"), F.col("item").cast("int"), F.lit(None).cast("double").alias("pred")).distinct()
    zero = F.lit(0).alias("_key")
    held = [once(side.select(F.col(c).cast("long").alias(c), zero, F.col(b).alias("bias"))) for side, c, b in ((user, "user", "bu"), (item, "item", "bi"))]
    bias = [lists(h, c, "_key", "bias") for h, c in zip(held, ("user", "item"))]

    def looked_up(of, ids, n):
        """n columns of each id, 0 where it is unknown."""
        part, start, size = of.find(ids)
        out = np.zeros((len(ids), n))
        out[size > 0] = np.stack(of.gather(part, start, size, n + 1)[1:], axis=1)
        return out

    def left(batches):
        for b in batches:
            u, i, stars = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            yield from sent({"user": u.astype(np.int32), "item": i.astype(np.int32), "rest": (stars - gm - looked_up(bias[1], i, 1)[:, 0] - looked_up(bias[0], u, 1)[:, 0]).astype(np.float32)})

    ids = [F.col(c).cast("int").cast("long").alias(c) for c in ("user", "item")]
    rest = once(r.select(*ids, "stars").dropna().mapInArrow(left, "user int, item int, rest float"))
    als = ALS(userCol="user", itemCol="item", ratingCol="rest", rank=rank, maxIter=rounds, regParam=reg, seed=7, coldStartStrategy="nan")
    fitted = als.fit(rest)
    names = [f"f{k}" for k in range(rank)]
    factors = []
    for side, c, got in zip(held, ("user", "item"), (fitted.userFactors, fitted.itemFactors)):
        rows = side.join(got.select(F.col("id").cast("long").alias(c), *(F.col("features")[k].cast("double").alias(f) for k, f in enumerate(names))), c, "left")
        factors.append(lists(once(rows.select(c, "_key", "bias", *names).na.fill(0.0)), c, "_key", "bias", *names))

    def predict(batches):
        for b in batches:
            u, i = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            p, q = (looked_up(of, x, rank + 1) for of, x in zip(factors, (u, i)))
            yield from sent({"user": u.astype(np.int32), "item": i.astype(np.int32), "pred": gm + p[:, 0] + q[:, 0] + (p[:, 1:] * q[:, 1:]).sum(axis=1)})

    return test.select(*ids).dropna().distinct().mapInArrow(predict, "user int, item int, pred double")


def hybrid(test: DataFrame, r: DataFrame, m: DataFrame | Like, other: DataFrame, least: int = 3, top: float = 5.0) -> DataFrame:
    """(user, item, pred): the mean of what like users gave, weighted by the size of the similarity, where a negative
    one turns a rating round on the scale of 1 to `top`; with fewer than `least` of them the prediction of `other`."""
    if isinstance(m, Like):
        own = _from_alike(test, r, m, top=top)
    else:
        own = _own_hybrid(test, r, m, top)
    return test.join(own.where(F.col("n") >= least).select("user", "item", "p"), ["user", "item"], "left").join(other.select("user", "item", F.col("pred").alias("q")), ["user", "item"], "left").select("user", "item", F.coalesce("p", "q").alias("pred"))


def _own_hybrid(test: DataFrame, r: DataFrame, m: DataFrame, top: float) -> DataFrame:
    near = test.select("user", "item").distinct().join(both_ways(m).withColumnRenamed("a", "user"), "user").join(r.select(F.col("user").alias("b"), "item", "stars"), ["b", "item"])
    given = F.when(F.col("sim") < 0, top + 1 - F.col("stars")).otherwise(F.col("stars"))
    return near.groupBy("user", "item").agg(F.count("*").alias("n"), F.try_divide(F.sum(given * F.abs("sim")), F.sum(F.abs("sim"))).alias("p"))
