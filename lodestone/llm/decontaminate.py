"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item has a tiny Jaccard similarity to the long document that quotes it, so both sides are cut
into like sizes first. Items fall into classes by their number q of distinct word n-grams: class c holds
2^(c-1) < q <= 2^c. For each class a document is read as windows of two adjacent blocks of 2^c n-grams, one
window a block, so that every run of up to 2^c n-grams lies inside one window. In a window a containment t of
an item means a Jaccard similarity of t*q / (q + 2^(c+1) - t*q) >= t / (5 - t) at least: a bound free of the
document's length, from which `hashes` follows. A document and an item are candidates if one window has the
item's MinHash in any component; a candidate is verified by containment, over the document's whole set of n-grams: by
their hashes first, and what passes by the words themselves.

The items are indexed in blocks of `block` items each, files in the shared folder. A document is never shuffled; it is
scanned once for every `at_once` blocks, which are what a worker holds in memory, however many items there are.

Defined results: null or empty texts and items without words match nothing; texts of any length are searched whole. An
item of fewer than n words is one run of all its words. Repeated document or item rows give one result row, items of
equal texts one each. Null document or item ids are reported as null ids. Empty tables give empty results.
`contaminated` has its own columns only, `decontaminated` those it got, whatever their names.
"""

from __future__ import annotations

import math
import os
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import mounted

MIN_CLASS = 3


def hashes_for(threshold: float, miss: float = 1e-5) -> int:
    """Components after which an item at the threshold is missed with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold / (5 - threshold)))


def _params(k: int) -> tuple[np.ndarray, np.ndarray]:
    s = K.seeds(2 * k, 0xC0FFEE)
    return (s[:k] >> K.U(32)).astype(np.uint32), (s[k:] >> K.U(32)).astype(np.uint32) | np.uint32(1)


_WORD = re.compile(K.WORD)


def exact(text: pa.Scalar, n: int) -> frozenset:
    """The runs of n words of a text, or the one of all its words."""
    w = _WORD.findall(pc.utf8_lower(text).as_py())
    return frozenset(" ".join(w[k : k + n]) for k in range(max(len(w) - n, 0) + 1)) if w else frozenset()


def _index(n: int, hashes: int, folder: str):
    """Writes each block of items as one file; the rows say which."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = _params(hashes)
        parts: dict[int, list] = {}
        for batch in batches:
            texts = K.strings(batch.column(2))
            w = K.Words(texts)
            for m in range(1, n + 1):
                rows = np.flatnonzero(np.minimum(np.diff(w.first), n) == m)
                if not len(rows):
                    continue
                grams, first = K.distinct(*w.grams(m, short=False))
                for r in rows:
                    own = grams[first[r] : first[r + 1]]
                    size = len(own)
                    sig = np.min(((own >> K.U(32)).astype(np.uint32)[:, None] ^ xor) * mul, axis=0)
                    level = max(MIN_CLASS, int(size - 1).bit_length())
                    parts.setdefault(batch.column(0)[int(r)].as_py(), []).append((batch.column(1)[int(r)].as_py(), m, level, own, sig, exact(texts[int(r)], m)))
        for block, items in parts.items():
            path = f"{folder}/{block}"
            with open(f"{path}.{os.getpid()}", "wb") as f:
                pickle.dump(items, f, 5)
            os.replace(f"{path}.{os.getpid()}", path)  # a repeated task writes the same again
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return build


class _Block:
    """One block of items, ready to be searched: for each n-gram length and class a table by component."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.items = pickle.load(f)
        self.tables = {}
        for m, level in sorted({(i[1], i[2]) for i in self.items}):
            own = np.array([k for k, i in enumerate(self.items) if (i[1], i[2]) == (m, level)])
            sigs = np.stack([self.items[k][4] for k in own])
            shift = np.uint32(32 - min(22, max(10, int(len(own) * 64).bit_length())))
            by = []
            for c in range(sigs.shape[1]):
                order = np.argsort(sigs[:, c], kind="stable")
                seen = np.zeros(1 << (32 - int(shift)), dtype=bool)
                seen[sigs[:, c] >> shift] = True
                by.append((seen, sigs[order, c], own[order]))
            self.tables[m, level] = (shift, by)


def _search(n: int, hashes: int, threshold: float, paths: list[str], schema: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = _params(hashes)
        blocks = None
        for batch in batches:
            texts = K.strings(batch.column(1))
            out: list[list] = [[], [], [], []]
            for lo, hi in K.chunks(texts):
                blocks = blocks or [_Block(p) for p in paths]
                w = K.Words(texts[lo:hi])
                for m in sorted({key[0] for b in blocks for key in b.tables}):
                    grams, first = w.grams(m, short=False)
                    if not len(grams):
                        continue
                    for block in blocks:
                        at, words = (-1, 0), frozenset()
                        for row, item in sorted(_candidates(grams, first, m, block, xor, mul)):
                            ident, _, _, own, _, runs = block.items[item]
                            doc = grams[first[row] : first[row + 1]]
                            if np.isin(own, doc).sum() < threshold * len(own) - 1e-9:
                                continue
                            if (row, m) != at:
                                at, words = (row, m), exact(texts[lo + row], m)
                            shared = len(runs & words)
                            if shared >= threshold * len(runs) - 1e-9:
                                for to, v in zip(out, (lo + row, ident, shared, len(runs))):
                                    to.append(v)
            if out[0]:
                ids = batch.column(0).take(pa.array(out[0], pa.int64()))
                share = pa.array(np.array(out[2]) / np.array(out[3]))
                yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), pa.array(out[1], schema.field(1).type), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), share], schema=schema)

    return search


def _candidates(grams, first, m, block, xor, mul):
    """Pairs of a row and an item that have an equal MinHash in one window."""
    levels = sorted(level for mm, level in block.tables if mm == m)
    if not levels:
        return set()
    size = np.diff(first)
    cut = {}  # for each class: starts of the blocks, and whether the next block is of the same row
    for level in levels:
        count = (size + (1 << level) - 1) >> level
        row = np.repeat(np.arange(len(size)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = first[row] + (at << level)
        same = np.zeros(len(row), dtype=bool)
        same[:-1] = row[1:] == row[:-1]
        cut[level] = (row, start, same)
    short = (grams >> K.U(32)).astype(np.uint32)
    # blocks of a class are unions of blocks of the one below, counted from the start of the row
    base = cut[levels[0]]
    inner = {level: np.searchsorted(base[1], cut[level][1]) for level in levels[1:]}
    found = set()
    for c in range(len(xor)):
        least = np.minimum.reduceat((short ^ xor[c]) * mul[c], base[1])
        for level in levels:
            row, _, same = cut[level]
            low = least if level == levels[0] else np.minimum.reduceat(least, inner[level])
            window = low.copy()
            both = np.flatnonzero(same)
            window[both] = np.minimum(low[both], low[both + 1])
            shift, by = block.tables[m, level]
            seen, values, items = by[c]
            hit = np.flatnonzero(seen[window >> shift])
            if len(hit):
                v = window[hit]
                a, b = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                for r, x, y in zip(row[hit[b > a]], a[b > a], b[b > a]):
                    found.update((int(r), int(items[k])) for k in range(x, y))
    return found


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.6, block: int = 20_000, at_once: int = 4) -> DataFrame:
    """(doc_id, item_id, shared, size, containment) of every document and item with containment >= threshold."""
    spark, folder = docs.sparkSession, mounted(docs.sparkSession)
    os.makedirs(folder)
    hashes = hashes_for(threshold)
    index = items.select(items[item_id].alias("i"), items[item_text].cast("string").alias("t"))
    blocks = max(1, -(-index.count() // block))
    index = index.select(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int").alias("b"), "i", "t").distinct().repartition(blocks, "b").sortWithinPartitions("b", "i", "t")
    paths = sorted({r.path for r in index.mapInArrow(_index(n, hashes, folder), "path string").collect()})
    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("shared", T.LongType()), T.StructField("size", T.LongType()), T.StructField("containment", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(docs[doc_id].alias("i"), docs[text].cast("string").alias("t"))
    parts = [rows.mapInArrow(_search(n, hashes, threshold, paths[k : k + at_once], to_arrow_schema(kind)), kind) for k in range(0, max(len(paths), 1), at_once)]
    return reduce(DataFrame.unionAll, parts).distinct()


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, without those that contain an item. Documents with a null id stay."""
    from .shared import without, written

    found = written(contaminated(docs, items, doc_id, text, **options).select("doc_id").distinct())
    return without(docs, found, doc_id)


