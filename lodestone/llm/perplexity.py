"""An interpolated modified Kneser-Ney n-gram model and the perplexity of texts under it.

Words. A first pass counts words by their hashes and numbers them, common ones first, so n-grams travel as small
numbers that compress well. The list of words lies in the shared folder and is memory-mapped.

Counting. Workers add up the n-grams of some millions of words in memory; what they hand over are sorted, compressed
blocks, scattered by a hash of the whole n-gram, so no common word or context makes a task larger than others. A bucket
adds its counts, writes them as a table, and hands two sums for each shorter n-gram on to the next lower order: of how
many distinct n-grams it is the end (its continuation count), and for how many of which counts it is the context
(their total, and the numbers of those seen once, twice and more). Both are sums over disjoint sets, so they add up
wherever the n-grams lie. Nothing is sampled, pruned or clipped.

Tables. Each bucket of an order is one file of sorted hash arrays: the n-grams by slot, of 32 on average, and within it
by the low 32 bits of their hash, with counts and sums in a byte each where they are among the 255 commonest of the
bucket, else in a list behind. Two n-grams of one bucket, slot and hash count as one: about one in 10^8.

Scoring. Workers memory-map the tables, `MAPS` at a time, look up the distinct n-grams of some megabytes of text in
sorted order, and combine the orders: p_k = max(c - D(c), 0) / total + backoff * p_(k-1); below the unigrams lies
1 / (V + 1). D has three values, from the counts of counts of each order. A missing file is an error.

A bucket holds about `bucket_words` words of the corpus. The shared folder has to be mounted on all executors.

Defined results: null and empty texts and those without words are not counted, and get n_tokens 0 and null
log_prob and perplexity. Each text ends in one end token, which is counted and scored; texts of any length are taken
whole. Repeated rows count as often as they come. An empty table gives a model under which every word has the
probability 1. The result has its own columns only, whatever the names of others.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import mounted

BEGIN, END = K.U(0x1B873593CC9E2D51), K.U(0x85EBCA6B27D4EB2F)
G = K.U(0x9E3779B97F4A7C15)
#: Rows that a counting worker gathers before it hands them over.
HELD = 2_500_000
SCORE_BYTES = 4 << 20
#: Files that a scoring worker keeps mapped.
MAPS = 256
WORD_BUCKETS = 4096
SLOT = 32
BLOCK = "bucket int, kind int, n long, data binary"
#: Sums of an n-gram: its count; and as a context the total and the numbers of successors seen once, twice and more.
SUMS = 5


def tokens(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts that have any, each text with an end token, and the bounds of each text."""
    count = np.diff(w.first)
    size = np.where(count > 0, count + 1, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    token = np.empty(first[-1], K.U)
    end = first[1:][size > 0] - 1
    rest = np.ones(len(token), dtype=bool)
    rest[end] = False
    token[end], token[rest] = END, w.hash
    return token, first


def ngrams(token: np.ndarray, first: np.ndarray, order: int, begin) -> list[np.ndarray]:
    """The n-gram that ends at each token, as one array for each place; `begin` fills the places before a text."""
    at = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for back in range(order - 1, -1, -1):
        column = np.empty_like(token)
        column[back:] = token[: len(token) - back] if back else token
        column[at < back] = begin
        out.append(column)
    return out


def hashed(words: list[np.ndarray]) -> np.ndarray:
    """One hash of each n-gram of word hashes."""
    with np.errstate(over="ignore"):
        out = K.mix(words[0] + G)
        for w in words[1:]:
            out = K.mix(out * G + w)
    return out


def place(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where in all buckets a hash lies, with 40 bits of its place in its own; in the order of the hashes."""
    return (h >> K.U(24)) * K.U(buckets)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (place(h, buckets) >> K.U(40)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def joined(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns as few 64-bit numbers in the same order."""
    bits = max(max((int(c.max()) for c in columns if len(c)), default=0).bit_length(), 1)
    out = []
    for k in range(0, len(columns), per := 64 // bits):
        key = columns[k].astype(K.U)
        for c in columns[k + 1 : k + per]:
            key = key << K.U(bits) | c.astype(K.U)
        out.append(key)
    return out


def added(columns: list[np.ndarray], sums: list[np.ndarray] | None = None, ordered: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct rows in order with their summed values, or with how often they come."""
    keys = joined(columns)
    order = slice(None) if ordered else np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    first = at if ordered else order[at]
    total = [np.diff(at, append=len(new))] if sums is None else [np.add.reduceat(s[order], at) if len(at) else s for s in sums]
    return [c[first] for c in columns], total


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, as far as there are any: like bytes lie together."""
    top = int(x.max()) if len(x) else 0
    wide = max(1, (top.bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :wide].T).tobytes()


def _unplane(raw: memoryview, n: int, at: int, kind) -> tuple[np.ndarray, int]:
    wide = raw[at]
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :wide] = np.frombuffer(raw, np.uint8, wide * n, at + 1).reshape(wide, n).T
    return out.reshape(-1).view(kind), at + 1 + wide * n


def packed(columns: list[np.ndarray], sums: list[np.ndarray]) -> bytes:
    """Rows in order as one compressed block: the first column as steps."""
    step = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    data = b"".join([_planes(step), *map(_planes, columns[1:]), *(_planes(s.astype(K.U)) for s in sums)])
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, columns: int, sums: int, kind) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw, at, out = memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)), 0, []
    for k in range(columns + sums):
        x, at = _unplane(raw, n, at, kind if k < columns else K.U)
        out.append(x if k or not columns else np.cumsum(x, dtype=kind))
    return out[:columns], [s.astype(np.int64) for s in out[columns:]]


def _row(bucket: int, kind: int, n: int, data: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["bucket", "kind", "n", "data"])


def _blocks(columns, sums, words, buckets: int, width: int = 1) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks by the bucket of their hash. words: the hash of each numbered word."""
    bucket = bucket_of(hashed([words[c] for c in columns]), buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        own = order[cut[b] : cut[b + 1]]
        yield _row(int(b), -width, len(own), packed([c[own] for c in columns], [s[own] for s in sums]))


def _gathered(batches: Iterator[pa.RecordBatch], columns: int, sums: int, kind, out: list) -> Iterator[pa.RecordBatch]:
    """Puts (bucket, columns, sums) of all blocks into `out` and passes other rows on. Of more than one sum, a block
    has the first or the others."""
    parts, bucket = [], -1
    for batch in batches:
        for b, k, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            if k > 0:
                yield _row(b, k, n)
            else:
                bucket = b
                own, more = unpacked(data, n, columns, -k, kind)
                none = np.zeros(n, np.int64)
                parts.append((own, more if -k == sums else [*more, *[none] * (sums - 1)] if k == -1 else [none, *more]))
    if parts:
        out += [bucket, [np.concatenate(x) for x in zip(*(p[0] for p in parts))], [np.concatenate(x) for x in zip(*(p[1] for p in parts))]]


def _replace(path: str, *parts: np.ndarray) -> None:
    """One file of all arrays; a repeated task writes the same again."""
    new = f"{path}.{os.getpid()}"
    with open(new, "wb") as f:
        for a in parts:
            f.write(np.ascontiguousarray(a).data if len(a) else b"")
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(new, path)


# the list of words


def _count_words(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.array([BEGIN, END]), np.full(2, 1 << 32))], 0  # these come first

        def hand() -> Iterator[pa.RecordBatch]:
            (words,), (n,) = added(*([np.concatenate(x)] for x in zip(*held)))
            cut = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                yield _row(int(b), -1, int(cut[b + 1] - cut[b]), packed([words[cut[b] : cut[b + 1]]], [n[cut[b] : cut[b + 1]]]))

        for batch in batches:
            texts = K.strings(batch.column(0))
            for lo, hi in K.chunks(texts):
                held.append(np.unique(K.Words(texts[lo:hi]).hash, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield from hand()
                    held, size = [], 0
        if held:
            yield from hand()

    return count


def _merge_words(folder: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list = []
        yield from _gathered(batches, 1, 1, K.U, got)
        if got:
            (words,), (n,) = added(got[1], got[2])
            _replace(f"{folder}/words-{got[0]}", words, n)
            level = np.log2(n).astype(int)
            for k in np.unique(level):
                yield _row(got[0], 1 + int(k), int((level == k).sum()))

    return merge


def _number_words(folder: str, start: dict[int, int], number: dict[tuple[int, int], int], kind):
    """Writes a bucket's words, their numbers, and the words by number, each at its place in one file of all."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if b not in start:
                    continue
                raw = np.fromfile(f"{folder}/words-{b}", np.int64).reshape(2, -1)
                words, level = raw[0].view(K.U), np.log2(raw[1]).astype(int)
                ids = np.empty(len(words), kind)
                files = {name: os.open(f"{folder}/{name}", os.O_RDWR | os.O_CREAT) for name in ("word", "number", "by-number")}
                for k in np.unique(level):
                    own = np.flatnonzero(level == k)
                    at = number[b, int(k)]
                    ids[own] = np.arange(at, at + len(own))
                    os.pwrite(files["by-number"], words[own].tobytes(), 8 * at)
                os.pwrite(files["word"], words.tobytes(), 8 * start[b])
                os.pwrite(files["number"], ids.tobytes(), ids.itemsize * start[b])
                for f in files.values():
                    os.close(f)
            yield batch

    return write


class Numbers:
    """The number of each word of the corpus."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def open(self) -> Numbers:
        self.word, self.number, self.words = (np.memmap(f"{self.folder}/{name}", kind, "r") for name, kind in (("word", K.U), ("number", self.kind), ("by-number", K.U)))
        return self

    def of(self, token: np.ndarray) -> np.ndarray:
        some, back = np.unique(token, return_inverse=True)
        return np.asarray(self.number[np.searchsorted(self.word, some)])[back]


def numbered(rows: DataFrame, folder: str, buckets: int) -> Numbers:
    """Counts the words of all texts and numbers them by the size of their count."""
    spark, buckets = rows.sparkSession, min(WORD_BUCKETS, buckets // 16 + 1)
    found = rows.mapInArrow(_count_words(buckets), BLOCK).repartitionById(buckets, F.col("bucket")).mapInArrow(_merge_words(folder), BLOCK)
    have = found.select("bucket", "kind", "n").collect()  # 64 sizes of at most WORD_BUCKETS buckets
    size: dict[int, int] = {}
    for r in have:
        size[r.bucket] = size.get(r.bucket, 0) + r.n
    start, at = {}, 0
    for b in sorted(size):
        start[b], at = at, at + size[b]
    kind = "uint32" if at < 1 << 32 else "uint64"
    number, at = {}, 0
    for r in sorted(have, key=lambda r: (-r.kind, r.bucket)):
        number[r.bucket, r.kind - 1], at = at, at + r.n
    spark.range(0, buckets, 1, buckets).mapInArrow(_number_words(folder, start, number, kind), "id long").count()
    if not have:
        for name in ("word", "number", "by-number"):
            open(f"{folder}/{name}", "wb").write(b"\0" * 8)
    return Numbers(folder, kind)


# the tables


def _bytes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """values [n, columns] as one byte a row: the rows it stands for, the bytes, and which rows don't fit with their values."""
    one = values.astype(K.U)
    if one.shape[1] == 1:
        byte = np.minimum(one[:, 0], 255).astype(np.uint8)
        rest = np.flatnonzero(byte == 255)
        return np.arange(255, dtype=K.U)[:, None], byte, rest, one[rest]
    with np.errstate(over="ignore"):
        key = one[:, 0].copy()
        for k in range(1, one.shape[1]):
            key = K.mix(key * G) + one[:, k]
    some, at, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-count, kind="stable")[:255]
    code = np.full(len(some), 255, np.uint8)
    code[common] = np.arange(len(common))
    byte = code[back]
    rest = np.flatnonzero(byte == 255)
    return one[at[common]], byte, rest, one[rest]


class Table:
    """The n-grams of one bucket with their sums, mapped."""

    @staticmethod
    def write(path: str, h: np.ndarray, values: np.ndarray, buckets: int = 1) -> None:
        slots = max(1, len(h) // SLOT)
        slot = Table.slot(h, slots, buckets)
        order = np.argsort(slot << K.U(32) | h.astype(np.uint32))
        stand, byte, rest, more = _bytes_of(values[order])
        head = np.array([len(h), slots, len(stand), len(rest), values.shape[1]], np.int64)
        first = np.concatenate([[0], np.cumsum(np.bincount(slot.astype(np.int64), minlength=slots))])
        _replace(path, head, first.astype(np.uint32), h.astype(np.uint32)[order], byte, stand, rest.astype(np.int64), more)

    @staticmethod
    def slot(h: np.ndarray, slots: int, buckets: int) -> np.ndarray:
        """In the order of the hashes, so hashes in order are looked up along the file."""
        return (((place(h, buckets) & K.U((1 << 40) - 1)) >> K.U(8)) * K.U(slots)) >> K.U(32)

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, self.slots, k, m, width = raw[:40].view(np.int64).tolist()
        at, parts = 40, []
        for count, kind in ((self.slots + 1, np.uint32), (n, np.uint32), (n, np.uint8), (k * width, K.U), (m, np.int64), (m * width, K.U)):
            size = count * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        self.first, self.low, self.byte, stand, self.rest, more = parts
        self.stand, self.more = np.concatenate([stand.reshape(k, width), np.zeros((1, width), K.U)]), more.reshape(m, width)

    def find(self, h: np.ndarray, buckets: int = 1) -> np.ndarray:
        """[len(h), columns]; 0 where there is none."""
        slot, want = self.slot(h, self.slots, buckets).astype(np.int64), h.astype(np.uint32)
        lo, end = self.first[slot].astype(np.int64), self.first[slot + 1].astype(np.int64)
        size = end - lo
        for step in (1 << k for k in reversed(range(int(size.max(initial=0)).bit_length()))):  # skips what is smaller
            on = lo + (step - 1)
            skip = (on < end) & (self.low[np.minimum(on, len(self.low) - 1)] < want)
            lo += step * skip
        out = np.zeros((len(h), self.stand.shape[1]))
        hit = np.flatnonzero(lo < end)
        hit = hit[self.low[lo[hit]] == want[hit]]
        byte = self.byte[lo[hit]]
        values = self.stand[np.minimum(byte, len(self.stand) - 1)]
        rare = np.flatnonzero(byte == 255)
        values[rare] = self.more[np.searchsorted(self.rest, lo[hit[rare]])]
        out[hit] = values
        return out


def _count(order: int, buckets: int, numbers: Numbers):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own = [], 0, None

        def hand() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield from _blocks(*added(columns), own.words, buckets)

        for batch in batches:
            texts = K.strings(batch.column(0))
            for lo, hi in K.chunks(texts):
                own = own or numbers.open()
                token, first = tokens(K.Words(texts[lo:hi]))
                held.append(ngrams(own.of(token), first, order, own.of(np.array([BEGIN]))[0]))
                size += len(token)
                if size > HELD:
                    yield from hand()
                    held, size = [], 0
        if size:
            yield from hand()

    return count


def _merge(k: int, order: int, folder: str, buckets: int, numbers: Numbers):
    """One bucket of order k: writes its table; hands over the sums of the next order and the counts of counts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list = []
        width = 1 if k == order else SUMS
        yield from _gathered(batches, k, width, numbers.kind, got)
        if not got:
            Table.write(f"{folder}/{k}-{TaskContext.get().partitionId()}", np.zeros(0, K.U), np.zeros((0, width), np.int64))
            return
        words = numbers.open().words
        bucket, columns, sums = got
        columns, sums = added(columns, sums)
        Table.write(f"{folder}/{k}-{bucket}", hashed([words[c] for c in columns]), np.stack(sums, axis=1), buckets)
        count = sums[0]
        real = np.flatnonzero(count > 0)  # others are only contexts
        count = count[real]
        for j, n in enumerate([*((count == i).sum() for i in range(1, 5)), len(count), count.sum()]):
            yield _row(bucket, 100 * k + j, int(n))
        if k > 1:
            real = [c[real] for c in columns]
            yield from _blocks(*added(real[1:]), words, buckets, 1)
            seen = [count, *((count == i).astype(np.int64) for i in (1, 2)), (count > 2).astype(np.int64)]
            yield from _blocks(*added(real[:-1], seen, ordered=True), words, buckets, SUMS - 1)

    return merge


class Model:
    """Where the tables are, and the discounts and sizes of each order."""

    def __init__(self, folder: str, order: int, buckets: int, facts: dict[int, list[int]]):
        self.folder, self.order, self.buckets = folder, order, buckets
        self.discount = {k: discounts(f[:4]) for k, f in facts.items()}
        self.types = {k: f[4] for k, f in facts.items()}
        self.tokens = {k: f[5] for k, f in facts.items()}
        n = facts[1]
        self.base = float(self.discount[1] @ np.array([0, n[0], n[1], n[4] - n[0] - n[1]])) / max(n[5], 1)
        self.maps: OrderedDict = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"maps": OrderedDict()}

    def table(self, k: int, bucket: int) -> Table:
        if (k, bucket) not in self.maps:
            self.maps[k, bucket] = Table(f"{self.folder}/{k}-{bucket}")
            if len(self.maps) > MAPS:
                self.maps.popitem(last=False)
        self.maps.move_to_end((k, bucket))
        return self.maps[k, bucket]

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """The sums of any hashes."""
        some, back = np.unique(h, return_inverse=True)
        out = np.zeros((len(some), 1 if k == self.order else SUMS))
        cut = np.searchsorted(bucket_of(some, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)) if self.tokens[self.order] else ():
            out[cut[b] : cut[b + 1]] = self.table(k, int(b)).find(some[cut[b] : cut[b + 1]], self.buckets)
        return out[back]

    def log_probs(self, words: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Natural logarithms, one for each n-gram of word hashes of the full order. first: the first one of each text."""
        p = stat = None
        for k in range(1, self.order + 1):
            gram = hashed(words[self.order - k :])
            sums = self.find(k, gram)
            c = sums[:, 0]
            c = np.maximum(c - self.discount[k][np.minimum(c, 3).astype(int)], 0)
            if k == 1:
                p = c / max(self.tokens[1], 1) + (self.base / (self.types[1] + 1) if self.tokens[1] else 1.0)
            else:
                total = np.maximum(stat[:, 0], 1)
                held = sum(stat[:, j] * self.discount[k][j] for j in (1, 2, 3))
                p = c / total + np.where(stat[:, 0] > 0, held / total, 1.0) * p
            if k < self.order:  # the context of a word is the n-gram before it; that of a text's first one is all BEGIN
                stat = np.concatenate([sums[:1, 1:], sums[:-1, 1:]])
                stat[first] = self.find(k, hashed([np.array([BEGIN])] * k))[0, 1:]
        return np.log(p)


def discounts(n: list[int]) -> np.ndarray:
    """(0, D1, D2, D3+) from the numbers of n-grams seen 1 to 4 times; 0.5 a step where they are too few."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 4 * y]
    return np.clip(np.array(d), [0, 0.05, 0.1, 0.15], [0, 1, 2, 3])


def fit(docs: DataFrame, text: str = "text", order: int = 3, bucket_words: int = 2_000_000) -> Model:
    """Counts all texts. order >= 2."""
    spark = docs.sparkSession
    folder = mounted(spark)
    os.makedirs(folder)
    rows = docs.select(docs[text].cast("string").alias("t")).where("t <> ''")
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).head()[0] or 0
    buckets = max(1, int(size // (6 * bucket_words)) + 1)
    numbers = numbered(rows, folder, buckets)
    blocks = rows.mapInArrow(_count(order, buckets, numbers), BLOCK)
    for k in range(order, 0, -1):
        blocks = blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(_merge(k, order, folder, buckets, numbers), BLOCK)
    got = {r.kind: r.n for r in blocks.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return Model(folder, order, buckets, {k: [got.get(100 * k + j, 0) for j in range(6)] for k in range(1, order + 1)})


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.strings(batch.column(1))
            for lo, hi in K.chunks(texts, SCORE_BYTES):
                token, first = tokens(K.Words(texts[lo:hi]))
                total = K.by_row(model.log_probs(ngrams(token, first, model.order, BEGIN), first[:-1][np.diff(first) > 0]) if len(token) else np.zeros(0), first, np.add)
                n = np.diff(first)
                none = n == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(total, mask=none), pa.array(np.exp(-total / np.maximum(n, 1)), mask=none)], ["doc_id", "n_tokens", "log_prob", "perplexity"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    return docs.select(docs[doc_id].alias("i"), docs[text].cast("string").alias("t")).mapInArrow(score, schema)
