"""K-Means, BFR over chunks, cluster statistics and normalised mutual information.

Points are rows (id, vec array<double>). Centroids and summaries are k rows of d numbers, so they travel to the
points; points never come to the driver but for seeds and the bounded samples that BFR draws."""

from __future__ import annotations

import os
import uuid
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, mounted


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def assign(points: DataFrame, centers: np.ndarray, carry: bool = False) -> DataFrame:
    """(id, cluster, dist): the closest centre, the first of equal ones; with `carry` also vec."""

    def near(frames):
        for f in frames:
            if len(f):
                x = _matrix(f["vec"])
                d = np.sqrt(np.maximum(((x[:, None, :] - centers) ** 2).sum(axis=2), 0))
                yield pd.DataFrame({"id": f["id"], "cluster": d.argmin(axis=1).astype("int32"), "dist": d.min(axis=1), **({"vec": f["vec"]} if carry else {})})

    return points.select("id", "vec").mapInPandas(near, f"id {points.schema['id'].dataType.simpleString()}, cluster int, dist double" + ", vec array<double>" * carry)


def sums(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, n, sum, sumsq) by dimension, added in Spark."""
    rows = labels.select("id", "cluster").join(points.select("id", F.posexplode("vec").alias("j", "x")), "id")
    cell = rows.groupBy("cluster", "j").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return cell.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "s", "q"))).alias("c")).select("cluster", "n", F.transform("c", lambda c: c["s"]).alias("sum"), F.transform("c", lambda c: c["q"]).alias("sumsq"))


def statistics(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, n, centroid, variance)"""
    s = sums(points, labels)
    mean = F.transform("sum", lambda x: x / F.col("n"))
    return s.select("cluster", "n", mean.alias("centroid"), F.zip_with("sumsq", mean, lambda q, m: F.greatest(q / F.col("n") - m * m, F.lit(0.0))).alias("variance"))


#: Points of a task in the rounds, and of a step within it.
TASK, STEP = 20_000, 2_048


class Points:
    """Vectors in mapped files of the shared folder, by ascending id, and work on each file in a task of its own."""

    def __init__(self, points: DataFrame):
        """points: (id, vec array<double>), read several times."""
        self.spark = points.sparkSession
        root = mounted(self.spark)

        def write(batches):
            name, n, first = f"{root}/{uuid.uuid4().hex}", 0, None
            for b in batches:
                if b.num_rows:
                    os.makedirs(root, exist_ok=True)
                    first = b.column(0)[:1] if first is None else first
                    with open(name, "ab") as f:
                        b.column(1).flatten().to_numpy(zero_copy_only=False).tofile(f)
                    n += b.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([first, pa.array([name]), pa.array([n])], names=["id", "path", "n"])

        kind = points.schema["id"].dataType.simpleString()
        parts = -(-points.count() // TASK) or 1
        self.files = [(r["path"], r["n"]) for r in points.select("id", "vec").repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(write, f"id {kind}, path string, n long").orderBy("id").collect()]

    def each(self, work) -> list:
        """work(steps of vectors) of each file, in their order."""

        def run(file):
            path, n = file
            x = np.memmap(path, np.float64, "r").reshape(n, -1)
            return work(np.asarray(x[at : at + STEP]) for at in range(0, n, STEP))

        return self.spark.sparkContext.parallelize(self.files, len(self.files)).map(run).collect() if self.files else []


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The squared distances of points and centres."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        d = x - c
        out[:, j] = (d * d).sum(axis=1)
    return out


def farthest_first(points: DataFrame | Points, k: int) -> np.ndarray:
    """The point of least id, then again and again the one farthest from those chosen; equal ones by id."""
    points = points if isinstance(points, Points) else Points(points)
    if not points.files:
        return np.zeros((0, 0))

    def farthest(steps):
        best = None
        for x in steps:
            d = np.sqrt(_squares(x, centers).min(axis=1)) if len(centers) else -np.arange(len(x))
            if best is None or d.max() > best[0]:
                best = d.max(), x[d.argmax()].copy()
        return best

    centers = np.zeros((0, 0))
    centers = np.array([points.each(farthest)[0][1]])
    while len(centers) < k:
        dist, far = max(points.each(farthest), key=lambda r: r[0])
        if dist <= 0:
            break
        centers = np.vstack([centers, far])
    return centers


def kmeans(points: DataFrame, k: int, rounds: int = 1000, tolerance: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds from farthest-first seeds until no centre moves: labels (id, cluster, dist) and centres. An
    empty cluster keeps its centre. The points are laid down once in mapped files; each round is one job over these,
    which sends k sums a file."""
    points = cut(points.select("id", F.col("vec").cast("array<double>").alias("vec")))
    held = Points(points)
    centers = farthest_first(held, k)

    def sums_of(steps):
        n, s = np.zeros(len(centers), int), np.zeros(centers.shape)
        for x in steps:
            c = _squares(x, centers).argmin(axis=1)
            one = np.zeros((len(centers), len(x)))
            one[c, np.arange(len(x))] = 1
            n += np.bincount(c, minlength=len(n))
            s += one @ x
        return n, s

    for _ in range(rounds if len(centers) else 0):
        got = held.each(sums_of)
        n, s = sum(g[0] for g in got), sum(g[1] for g in got)
        new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centers)
        moved, centers = np.abs(new - centers).max(), new
        if moved <= tolerance:
            break
    return assign(points, centers), centers


def _kmeans(x: np.ndarray, k: int, rounds: int = 1000) -> np.ndarray:
    """The same for a bounded sample in memory: labels."""
    if len(x) <= k:
        return np.arange(len(x))
    chosen = [0]
    dist = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    c = x[chosen].astype(float)
    for _ in range(rounds):
        lab = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() == 0:
            break
        c = new
    return lab


class Summary:
    """N, SUM and SUMSQ of one cluster."""

    def __init__(self, x: np.ndarray):
        self.n, self.sum, self.sumsq = len(x), x.sum(axis=0), (x**2).sum(axis=0)

    def add(self, n, s, q) -> None:
        self.n, self.sum, self.sumsq = self.n + n, self.sum + s, self.sumsq + q

    @property
    def mean(self) -> np.ndarray:
        return self.sum / self.n

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.sumsq / self.n - self.mean**2, 1e-9))


def _nearest(x: np.ndarray, summaries: list[Summary], alpha: float) -> np.ndarray:
    """The summary of least Mahalanobis distance if that is within alpha * sqrt(d), else -1."""
    if not summaries or not len(x):
        return np.full(len(x), -1)
    d = np.stack([np.sqrt((((x - s.mean) / s.deviation) ** 2).sum(axis=1)) for s in summaries], axis=1)
    best = d.argmin(axis=1)
    return np.where(d.min(axis=1) <= alpha * np.sqrt(x.shape[1]), best, -1)


def bfr(chunks: list[DataFrame], k: int, sample: int = 2000, factor: int = 3, few: int = 10, alpha: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Bradley-Fayyad-Reina over chunks of points in order: (id, cluster) with -1 for outliers, and the counts after
    each chunk (chunk, n_discard, discard, n_compressed, compressed, retained). The discard set comes from a
    hash-ordered sample of the first chunk; each chunk is then assigned and summed in Spark, to the discard and the
    compressed sets alike; only points far from all come to the driver, the retained set that BFR keeps in memory by
    design. A compressed set is a summary and the numbers of those that were joined to it; which points are in it
    stays a table."""
    spark = chunks[0].sparkSession
    ds: list[Summary] = []
    cs: list[tuple[Summary, list[int]]] = []
    rs: list[tuple] = []
    done, loose, report, numbers = [], [], [], count()
    kind = chunks[0].schema["id"].dataType.simpleString()
    for number, chunk in enumerate(chunks):
        chunk = cut(chunk.select("id", F.col("vec").cast("array<double>").alias("vec")).dropna())
        if number == 0:
            drawn = chunk.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas().sort_values("id")
            x = _matrix(drawn["vec"])
            lab = _kmeans(x, factor * k)
            size = np.bincount(lab)
            inlier = size[lab] > few if (size > few).any() else np.ones(len(x), bool)
            lab = _kmeans(x[inlier], k)
            ds = [Summary(x[inlier][lab == j]) for j in range(lab.max() + 1) if (lab == j).any()]
            ids = drawn["id"].to_numpy()
            keep = [j for j in range(lab.max() + 1) if (lab == j).any()]
            done.append(spark.createDataFrame(pd.DataFrame({"id": ids[inlier], "cluster": [keep.index(j) for j in lab]}), f"id {kind}, cluster int"))
            rs = [(i, v) for i, v in zip(ids[~inlier].tolist(), x[~inlier])]
            chunk = chunk.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"id": ids}), f"id {kind}")), "id", "left_anti")
        now, comp = ds, [c for c, _ in cs]

        def place(frames, now=now, comp=comp):
            for f in frames:
                if len(f):
                    x = _matrix(f["vec"])
                    a = _nearest(x, now, alpha)
                    b = np.where(a < 0, _nearest(x, comp, alpha), -1)
                    yield pd.DataFrame({"id": f["id"], "vec": f["vec"], "ds": a.astype("int32"), "cs": b.astype("int32")})

        placed = cut(chunk.mapInPandas(place, f"id {kind}, vec array<double>, ds int, cs int"))
        done.append(placed.where("ds >= 0").select("id", F.col("ds").alias("cluster")))
        for name, into in (("ds", ds), ("cs", comp)):
            held = placed.where(f"{name} >= 0")
            for r in sums(held, held.select("id", F.col(name).alias("cluster"))).collect() if into else ():
                into[r["cluster"]].add(r["n"], np.array(r["sum"]), np.array(r["sumsq"]))
        if cs:
            first = F.array(*(F.lit(own[0]) for _, own in cs))
            loose.append(placed.where("cs >= 0").select("id", first[F.col("cs")].alias("number")))
        rs += [(r["id"], np.array(r["vec"])) for r in placed.where("ds < 0 and cs < 0").orderBy("id").collect()]
        if rs:
            x = np.stack([v for _, v in rs])
            lab = _kmeans(x, factor * k)
            size = np.bincount(lab)
            for j in np.flatnonzero(size > 1):
                cs.append((Summary(x[lab == j]), [next(numbers)]))
                loose.append(spark.createDataFrame([(rs[i][0], cs[-1][1][0]) for i in np.flatnonzero(lab == j)], f"id {kind}, number int"))
            rs = [rs[i] for i in np.flatnonzero(size[lab] == 1)]
        _merge(cs, alpha)
        report.append((number, sum(s.n for s in ds), len(ds), sum(s.n for s, _ in cs), len(cs), len(rs)))
    out = spark.createDataFrame([(i, int(_nearest(v[None], ds, alpha)[0])) for i, v in rs], f"id {kind}, cluster int")
    where = [(n, int(np.argmin([np.linalg.norm(s.mean - d.mean) for d in ds]))) for s, own in cs for n in own]
    if loose:
        last = F.broadcast(spark.createDataFrame(where, "number int, cluster int"))  # one row a compressed set
        done.append(reduce(DataFrame.unionAll, loose).join(last, "number").select("id", "cluster"))
    return reduce(DataFrame.unionAll, [out, *done]), spark.createDataFrame(report, "chunk int, n_discard long, discard int, n_compressed long, compressed int, retained int")


def _merge(cs: list, alpha: float) -> None:
    """Joins the closest two summaries, by the larger of both Mahalanobis distances, while they are near."""
    while len(cs) > 1:
        mean, dev = np.stack([s.mean for s, _ in cs]), np.stack([s.deviation for s, _ in cs])
        d = np.sqrt((((mean[:, None] - mean) / dev) ** 2).sum(axis=2))
        d = np.maximum(d, d.T) + np.diag(np.full(len(cs), np.inf))
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] > alpha * np.sqrt(mean.shape[1]):
            return
        (a, x), (b, y) = cs[min(i, j)], cs.pop(max(i, j))
        a.add(b.n, b.sum, b.sumsq)
        x += y


def nmi(pairs: DataFrame, u: str, v: str) -> DataFrame:
    """(nmi): mutual information over the mean of both entropies; 1 if both have one class only."""
    joint = pairs.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna().groupBy("u", "v").agg(F.count("*").cast("double").alias("c"))
    n = joint.agg(F.sum("c").alias("n"))

    def entropy(key, name):
        p = F.col("c") / F.col("n")
        return joint.groupBy(*key).agg(F.sum("c").alias("c")).crossJoin(F.broadcast(n)).agg((-F.sum(p * F.ln(p))).alias(name))

    h = entropy(["u"], "hu").crossJoin(entropy(["v"], "hv")).crossJoin(entropy(["u", "v"], "huv"))
    both = F.col("hu") + F.col("hv")
    return h.select(F.when(both <= 1e-12, 1.0).otherwise(2 * (both - F.col("huv")) / both).alias("nmi"))
