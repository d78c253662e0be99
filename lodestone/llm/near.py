"""MinHash near-duplicates by a chosen-path set similarity join.

Each text becomes a MinHash signature of `size` components over its word n-grams, 8 bits of each. The join grows
independent trees: in a node, components are drawn by a hash of the node's path, SPREAD/threshold of them on average and
one at least (the root draws `roots`), and the node's documents branch by their values there, so a pair at the threshold
expects SPREAD common children a node, and however deep the tree is, it dies out with a probability q = exp(-SPREAD (1 -
q)) at most. From that and the roots follows how many trees reach the target `recall` for a pair at the threshold.
Nodes of at most `leaf` documents are compared exhaustively. The first branching is a Spark shuffle by path; nodes
above `split` documents branch once more by a shuffle until all are below it or `depth` is reached, the rest of each
tree is grown inside a worker.

Only who is joined matters, not each pair: a comparison is skipped only if its two documents are joined
already, which leaves the components as they are. Documents with equal signatures enter the trees as one.

The similarity is the share of equal components: an unbiased estimate of the Jaccard similarity of the n-gram
sets (but for 1/256 of what is missing to 1, which the bound allows for), with a standard error below 0.5/sqrt(size).

Defined results: null and empty texts and null ids are never duplicates. A text without words counts as one
n-gram, the whole text. Texts with fewer words than n are one n-gram; texts of any length are read whole. Of repeated
rows with one id, the id is one document (its least signature). The member with the least id stays; ids are of any type
that can be ordered. Empty tables give empty results. `duplicates` has its own columns only, `deduplicated` those it
got, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import without, written


#: Common children that a pair at the threshold expects in a node.
SPREAD = 2.0


def trees_for(recall: float, threshold: float, roots: int) -> int:
    """Independent trees that find a pair at the threshold with probability `recall`."""
    dies = 0.0
    for _ in range(200):
        dies = math.exp(-SPREAD * (1 - dies))
    found = (1 - (1 - threshold) ** roots) * (1 - dies)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def needed(threshold: float, size: int) -> int:
    """Equal components of a pair at the threshold; 8 bits are equal by chance in one of 256."""
    return math.ceil((threshold + (1 - threshold) / 256) * size - 1e-9)


def drawn(path: int, size: int, chance: float) -> np.ndarray:
    """The components of a node, one at least."""
    with np.errstate(over="ignore"):
        draw = K.mix(np.arange(size, dtype=K.U) * K.U(0xD6E8FEB86659FD93) + K.U(path))
    some = np.flatnonzero(draw.astype(np.float64) < chance * 2.0**64)
    return some if len(some) else np.array([int(draw.argmin())])


def _signatures(n: int, size: int, draws: list[int]):
    """Rows of (id, signature in 8 bits a component, paths of the roots)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = K.seeds(2 * size, 0x5EED)
        xor, mul = (seed[:size] >> K.U(32)).astype(np.uint32), (seed[size:] >> K.U(32)).astype(np.uint32) | np.uint32(1)
        salt = K.seeds(len(draws), 0xB00)
        for batch in batches:
            texts = K.strings(batch.column(1))
            for lo, hi in K.chunks(texts):
                part = texts[lo:hi]
                w = K.Words(part)
                grams, first = w.grams(n)
                blank = np.flatnonzero((np.diff(first) == 0) & (np.diff(w.at) > 0))
                if len(blank):  # texts without words: one n-gram, from all bytes
                    value = K.hashes(w.bytes, w.at[:-1][blank], w.at[1:][blank])
                    grams = np.insert(grams, first[blank], value)
                    count = np.diff(first)
                    count[blank] = 1
                    first = np.concatenate([[0], np.cumsum(count)])
                rows = np.flatnonzero(np.diff(first) > 0)
                if not len(rows):
                    continue
                at, short = first[rows], (grams >> K.U(32)).astype(np.uint32)
                sig = np.empty((len(rows), size), np.uint32)
                for c in range(size):
                    sig[:, c] = np.minimum.reduceat((short ^ xor[c]) * mul[c], at)
                with np.errstate(over="ignore"):
                    paths = K.mix(sig[:, draws].astype(K.U) * K.U(0x9E3779B97F4A7C15) + salt).view(np.int64)
                packed = (sig ^ (sig >> np.uint32(11)) ^ (sig >> np.uint32(22))).astype(np.uint8).tobytes()
                width = size
                blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, width * len(rows) + 1, width, dtype=np.int32)), pa.py_buffer(packed)])
                roots = pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, len(draws), dtype=np.int32)), pa.array(paths.ravel()))
                yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(lo + rows)), blob, roots], ["id", "sig", "roots"])

    return sign


def _joined(sig: np.ndarray, need: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows of sig that agree in `need` components, found exhaustively."""
    left, edges = np.arange(len(sig)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (sig[left] == sig[x]).sum(axis=1) >= need
            new = left[near]
            edges += [(x, int(y)) for y in new]
            queue += new.tolist()
            left = left[~near]
    return edges


def _alike(sig: np.ndarray) -> np.ndarray:
    """Each row's mean share of equal components with the rows of its node, itself included."""
    total = np.zeros(len(sig))
    for c in range(sig.shape[1]):
        _, back, count = np.unique(sig[:, c], return_inverse=True, return_counts=True)
        total += count[back]
    return total / (len(sig) * sig.shape[1])


def _peel(sig, rows, heavy, need, edges) -> None:
    """Compares each heavy row with all rows of the node that aren't joined to it yet."""
    own, label = sig[rows], np.arange(len(rows))
    for x in heavy:
        other = np.flatnonzero(label != label[x])
        if not len(other):
            return
        near = other[(own[other] == own[x]).sum(axis=1) >= need]
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            edges += [(int(rows[x]), int(rows[near[f]])) for f in first]
            label[np.isin(label, groups)] = label[x]


def _grow(sig, rows, path, need, leaf, depth, chance, edges) -> None:
    """One node of a tree. A small one is compared exhaustively. In another, rows that are like the average of
    the node would follow it down every branch: they are compared with the whole node and leave it; the others
    branch by the chosen components."""
    if len(rows) <= leaf or depth == 0:
        edges += [(int(rows[a]), int(rows[b])) for a, b in _joined(sig[rows], need)]
        return
    size = sig.shape[1]
    heavy = _alike(sig[rows]) >= 0.5 * need / size
    if heavy.any():
        _peel(sig, rows, np.flatnonzero(heavy), need, edges)
        rows = rows[~heavy]
        if len(rows) <= leaf:
            return _grow(sig, rows, path, need, leaf, depth, chance, edges)
    for c in drawn(path, size, chance):
        order = np.argsort(sig[rows, c], kind="stable")
        v = sig[rows[order], c]
        cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                with np.errstate(over="ignore"):
                    child = int(K.mix(np.array([K.U(path) * K.U(0x9E3779B97F4A7C15) + K.U(int(c) << 16 | int(v[a]))], K.U))[0])
                _grow(sig, rows[order[a:b]], child, need, leaf, depth - 1, chance, edges)


def _compare(size: int, threshold: float, leaf: int, depth: int):
    """Edges of each node; the nodes arrive sorted by path, a node may cross batches."""
    need = needed(threshold, size)

    def nodes(path, ids, sig):
        cut = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a == 2:
                if (sig[a] == sig[a + 1]).sum() >= need:
                    yield ids[a], ids[a + 1]
            elif b - a > 2:
                edges: list = []
                _grow(sig, np.arange(a, b), int(path[a].view(K.U)), need, leaf, depth, SPREAD / (threshold * size), edges)
                for x, y in edges:
                    yield ids[x], ids[y]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            data = batch.column(2)
            sig = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), size)
            held.append((path, ids, sig))
            last = path[-1]
            if path[0] == last:
                continue
            if len(held) > 1:
                path, ids, sig = (np.concatenate(x) for x in zip(*held))
            end = int(np.flatnonzero(path != last)[-1]) + 1
            yield from _edges(nodes(path[:end], ids[:end], sig[:end]))
            held = [(path[end:], ids[end:], sig[end:])]
        if held:
            path, ids, sig = (np.concatenate(x) for x in zip(*held))
            yield from _edges(nodes(path, ids, sig))

    return compare


def _edges(found) -> Iterator[pa.RecordBatch]:
    found = list(found)
    if found:
        pair = np.array(found, dtype=np.int64)
        pair = np.unique(np.sort(pair, axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the least node of each connected component, by alternating large- and small-star
    steps; each round is written to the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # many edges of a node meet its one row, so a node with very many is split, never gathered
        new = both.join(least, "a").where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return new.where("a <> b").unionAll(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()

    now = written(edges.where("a <> b").distinct())
    mark = None
    while True:
        now = written(star(star(now, True), False))
        new = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, threshold: float = 0.5, recall: float = 0.99, size: int = 256, roots: int = 2, leaf: int = 64, split: int = 50_000, depth: int = 12) -> DataFrame:
    """(doc_id, kept_id) for each document that goes, with the one of its group that stays."""
    trees = trees_for(recall, threshold, roots)
    draws = [(5 * i + 1) % size for i in range(trees * roots)]
    kind = docs.schema[doc_id].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    rows = docs.select(docs[doc_id].cast("long" if whole else kind).alias("id"), docs[text].cast("string").alias("t")).where("id is not null and t <> ''")
    schema = T.StructType([T.StructField("id", T.LongType() if whole else kind), T.StructField("sig", T.BinaryType()), T.StructField("roots", T.ArrayType(T.LongType()))])
    signed = written(rows.mapInArrow(_signatures(n, size, draws), schema))
    if not whole:  # the trees carry numbers in place of the ids
        names = written(signed.select(F.col("id").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()))
        signed = signed.withColumnRenamed("id", "name").join(names, "name").select("id", "sig", "roots")
    alike = signed.groupBy(F.xxhash64("sig").alias("h"), F.crc32("sig").alias("g")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    same = signed.select("id", F.xxhash64("sig").alias("h"), F.crc32("sig").alias("g")).join(alike.where("copies > 1").select("h", "g", F.col("id").alias("b")), ["h", "g"]).select(F.col("id").alias("a"), "b").where("a <> b")
    member = signed.select("id", F.xxhash64("sig").alias("h"), F.crc32("sig").alias("g"), F.explode("roots").alias("path")).join(alike.select("h", "g", "id"), ["h", "g", "id"]).select("path", "id").distinct()
    nodes = _branched(member, signed, split, size, threshold, depth)
    pairs = nodes.mapInArrow(_compare(size, threshold, leaf, depth), "a long, b long")
    group = components(pairs)  # of the representatives; equal signatures follow theirs
    root = group.select(F.col("node").alias("b"), "root")
    group = group.unionAll(same.join(root, "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root")))
    if not whole:
        every = group.unionAll(group.select("root", "root").distinct()).join(names, F.col("node") == F.col("id")).select("root", "name")
        least = every.groupBy("root").agg(F.min("name").alias("least"))
        return every.join(least, "root").where("name <> least").select(F.col("name").alias("doc_id"), F.col("least").alias("kept_id"))
    return group.select(F.col("node").cast(kind).alias("doc_id"), F.col("root").cast(kind).alias("kept_id"))


def _branched(member: DataFrame, signed: DataFrame, split: int, size: int, threshold: float, depth: int) -> DataFrame:
    """(path, id, sig) sorted by path, without lone documents; nodes above `split` are branched by a shuffle."""
    ready, chance = None, SPREAD / (threshold * size)

    @F.pandas_udf("array<int>")
    def draw(path):
        return path.map(lambda p: drawn(p & 0xFFFFFFFFFFFFFFFF, size, chance).tolist())

    for level in range(depth + 1):
        member = written(member)
        count = member.groupBy("path").agg(F.count("*").alias("c")).where("c > 1")
        kept = member.join(count, "path")
        big = written(count.where(F.col("c") > split).select("path").withColumn("i", draw("path")))
        last = level == depth or big.isEmpty()
        fits = (kept if last else kept.where(F.col("c") <= split)).select("path", "id")
        ready = fits if ready is None else ready.unionAll(fits)
        if last:
            break
        high = member.join(big, "path").join(signed.select("id", "sig"), "id").withColumn("i", F.explode("i"))
        member = high.select(F.xxhash64("path", "i", F.expr("substring(sig, i + 1, 1)")).alias("path"), "id").distinct()
    return ready.join(signed.select("id", "sig").dropDuplicates(["id"]), "id").select("path", "id", "sig").repartition("path").sortWithinPartitions("path", "id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, with one document of each group. Null ids and empty texts stay."""
    return without(docs, duplicates(docs, doc_id, text, **options).select("doc_id"), doc_id)
