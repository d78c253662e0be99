"""Pairs of keys that share elements, summed up without a row for each pair and element.

The rows of each element lie together in files of the shared folder, which workers map (`Lists`). A task takes the rows
of a range of keys, looks up the lists of their elements and adds up what each key shares with others, key by key, in
arrays of a bounded size. What is shuffled and written is in proportion to the rows; the pairs cost time only. Mapped
files are page cache, not memory of the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import cut, mounted, once

#: Rows of a task, list entries that are held at once, rows of an Arrow batch.
TASK, HELD, BATCH = 100_000, 1 << 20, 1 << 16


def tasks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1] and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Lists:
    """Of each integer element, its rows (key, *carry) by ascending key."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.paths, self.firsts = [p for p, _ in parts], np.array([f for _, f in parts], dtype=np.int64)
        self.mapped: dict = {}

    def __getstate__(self):
        return {"paths": self.paths, "firsts": self.firsts, "mapped": {}}

    def column(self, part: int, name) -> np.ndarray:
        if (part, name) not in self.mapped:
            self.mapped[part, name] = np.asarray(np.memmap(f"{self.paths[part]}.{name}", dtype=np.float64 if name not in ("0", "ids", "starts") else np.int64, mode="r"))
        return self.mapped[part, name]

    def find(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part, start and size of the list of each element; none has size 0."""
        part = np.searchsorted(self.firsts, e, side="right") - 1
        start, size = np.zeros(len(e), np.int64), np.zeros(len(e), np.int64)
        for p in np.unique(part[part >= 0]).tolist():
            at = np.flatnonzero(part == p)
            ids, starts = self.column(p, "ids"), self.column(p, "starts")
            k = np.minimum(np.searchsorted(ids, e[at]), len(ids) - 1)
            start[at], size[at] = starts[k], np.where(ids[k] == e[at], starts[k + 1] - starts[k], 0)
        return part, start, size

    def gather(self, part: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> list[np.ndarray]:
        """The first n columns of these lists, one list after the other."""
        used = np.unique(part[size > 0]).tolist()
        if len(used) == 1:
            at = _ranges(start, size)
            return [self.column(used[0], str(c))[at] for c in range(n)]
        out = [np.empty(size.sum(), np.float64 if c else np.int64) for c in range(n)]
        begin = np.cumsum(size) - size
        for p in used:
            own = np.flatnonzero((part == p) & (size > 0))
            at, to = _ranges(start[own], size[own]), _ranges(begin[own], size[own])
            for c in range(n):
                out[c][to] = self.column(p, str(c))[at]
        return out


def _numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def lists(rows: DataFrame, element: str, key: str, *carry: str) -> Lists:
    """The lists of rows, whose columns are integers, and doubles to carry along."""
    root = mounted(rows.sparkSession)

    def write(batches):
        import os
        import uuid
        from contextlib import ExitStack

        at, last, ids, starts, name = 0, None, [], [], f"{root}/{uuid.uuid4().hex}"
        with ExitStack() as stack:
            files = None
            for b in batches:
                if not b.num_rows:
                    continue
                if files is None:
                    os.makedirs(root, exist_ok=True)
                    files = [stack.enter_context(open(f"{name}.{c}", "wb")) for c in range(b.num_columns - 1)]
                e = _numpy(b.column(0))
                new = np.flatnonzero(np.concatenate([[e[0] != last], e[1:] != e[:-1]]))
                ids.append(e[new])
                starts.append(new + at)
                for f, c in zip(files, b.columns[1:]):
                    _numpy(c).tofile(f)
                at, last = at + len(e), e[-1]
        if at:
            np.concatenate(ids).tofile(f"{name}.ids")
            np.append(np.concatenate(starts), at).tofile(f"{name}.starts")
            yield pa.RecordBatch.from_pydict({"path": [name], "first": [int(ids[0][0])]})

    n = tasks(rows)
    chosen = rows.select(F.col(element).cast("long").alias("e"), F.col(key).cast("long").alias("k"), *(F.col(c).cast("double") for c in carry))
    parts = chosen.repartitionByRange(n, "e").sortWithinPartitions("e", "k").mapInArrow(write, "path string, first long").collect()
    return Lists(sorted(((r["path"], r["first"]) for r in parts), key=lambda p: p[1]))


def by_key(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """The rows of each key together, in ascending order, in tasks of about TASK rows; a key is never divided."""
    return rows.select(key, *more).repartitionByRange(tasks(rows), key).sortWithinPartitions(key, *more[:1])


def whole(batches) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first one, in runs that end where a key ends."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = [_numpy(x) for x in b.columns]
        if held and held[-1][0][-1] == c[0][-1]:
            held.append(c)
            continue
        at = int(np.searchsorted(c[0], c[0][-1]))
        held.append([x[:at] for x in c])
        if sum(len(h[0]) for h in held):
            yield [np.concatenate(x) for x in zip(*held)]
        held = [[x[at:] for x in c]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


class Chunk:
    """Some keys with all their rows: ids of the keys, and for each row the number k of its key, its element, its other
    columns and where the list of the element lies. Long lists of one key are taken in several steps."""

    def __init__(self, of: Lists, columns: int, ids, k, elements, rows, part, start, size):
        self.of, self.columns, self.ids, self.k, self.elements, self.rows, self.part, self.start, self.size = of, columns, ids, k, elements, rows, part, start, size
        self.held = None

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(row, key's number, list columns) of each entry of the lists but the key itself."""
        end = np.cumsum(self.size)
        if self.held is None:
            step = end // HELD if len(end) and end[-1] > HELD else np.zeros(len(end), np.int64)
            cuts = np.flatnonzero(np.diff(step, prepend=-1)).tolist() + [len(end)]
            for i, j in zip(cuts, cuts[1:]):
                row = np.repeat(np.arange(i, j), self.size[i:j])
                if not len(row):
                    continue
                got = self.of.gather(self.part[i:j], self.start[i:j], self.size[i:j], self.columns)
                k = self.k[row]
                other = got[0] != self.ids[k]
                out = row[other], k[other], [g[other] for g in got]
                if len(cuts) == 2:
                    self.held = out
                yield out
        else:
            yield self.held


def chunks(of: Lists, batches, columns: int) -> Iterator[Chunk]:
    for c in whole(batches):
        part, start, size = of.find(c[1])
        first = np.flatnonzero(np.diff(c[0], prepend=c[0][0] - 1))
        work = np.add.reduceat(size, first)
        step = (np.cumsum(work) - work) // HELD
        cuts = np.flatnonzero(np.diff(step, prepend=-1)).tolist() + [len(first)]
        for i, j in zip(cuts, cuts[1:]):
            at, to = first[i], first[j] if j < len(first) else len(c[0])
            s = slice(at, to)
            yield Chunk(of, columns, c[0][first[i:j]], np.repeat(np.arange(j - i), np.diff(np.append(first[i:j], to))), c[1][s], [x[s] for x in c[2:]], part[s], start[s], size[s])


class Cells:
    """Numbers for the pairs (k, b) that occur, k < n: in a table if they lie close, else by sorting."""

    def __init__(self, k: np.ndarray, b: np.ndarray, n: int):
        self.names = None
        self.low = int(b.min()) if len(b) else 0
        self.span = int(b.max()) - self.low + 1 if len(b) else 1
        if n * self.span >= 1 << 62:  # any ids: numbered first
            self.names = np.unique(b)
            self.low, self.span = 0, len(self.names)
        code = self._code(k, b)
        self.dense = n * self.span <= max(4 * len(b), HELD)
        if self.dense:
            count = np.bincount(code, minlength=n * self.span)
            self.codes = np.flatnonzero(count)
            self.table = np.full(n * self.span, -1, np.int64)
            self.table[self.codes] = np.arange(len(self.codes))
            self.count, self.cell = count[self.codes], self.table[code]
        else:
            self.codes, self.cell, self.count = np.unique(code, return_inverse=True, return_counts=True)

    def _code(self, k, b):
        return k * self.span + (b - self.low if self.names is None else np.searchsorted(self.names, b))

    def find(self, k: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of other pairs, -1 for those that don't occur here."""
        if self.names is not None:
            at = np.minimum(np.searchsorted(self.names, b), len(self.names) - 1)
            inside, b = self.names[at] == b, at
        else:
            inside = (b >= self.low) & (b < self.low + self.span)
            b = b - self.low
        code = np.where(inside, k * self.span + b, 0)
        if self.dense:
            return np.where(inside, self.table[code], -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(inside & (self.codes[at] == code), at, -1)

    @property
    def k(self) -> np.ndarray:
        return self.codes // self.span

    @property
    def b(self) -> np.ndarray:
        b = self.codes % self.span
        return b + self.low if self.names is None else self.names[b]


class Sums:
    """What key number k shares with b, over the elements of both: n of them, the sums of the values (sx, sy, sxy, sxx,
    syy) and b's size cb."""

    NAMES = ("n", "sx", "sy", "sxy", "sxx", "syy")

    def __init__(self, chunk: Chunk, least: int, half: bool, valued: bool, sized: bool, chosen: np.ndarray | None = None):
        found = []
        for row, k, got in chunk.steps():
            if chosen is not None:
                at = chosen[row]
                row, k, got = row[at], k[at], [g[at] for g in got]
            if half:
                at = got[0] > chunk.ids[k]
                row, k, got = row[at], k[at], [g[at] for g in got]
            found.append(self._add(chunk, row, k, got, 1 if chunk.held is None else least, valued, sized))
        if not found:
            found = [self._add(chunk, np.zeros(0, int), np.zeros(0, int), [np.zeros(0, np.int64)] + [np.zeros(0)] * (chunk.columns - 1), 1, valued, sized)]
        if len(found) > 1:
            all_ = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
            c = Cells(all_["k"], all_["b"], len(chunk.ids))
            found = [{"k": c.k, "b": c.b} | {name: np.bincount(c.cell, all_[name], len(c.codes)) for name in self.NAMES if name in all_}]
            if sized:
                found[0]["cb"] = np.zeros(len(c.codes))
                found[0]["cb"][c.cell] = all_["cb"]
        at = found[0]["n"] >= least
        for name, x in found[0].items():
            setattr(self, name, x[at])

    @staticmethod
    def _add(chunk, row, k, got, least, valued, sized) -> dict:
        c = Cells(k, got[0], len(chunk.ids))
        keep = c.count >= least
        out = {"k": c.k[keep], "b": c.b[keep], "n": c.count[keep]}
        cell = c.cell
        if not keep.all():
            at = keep[cell]
            row, got, cell = row[at], [g[at] for g in got], (np.cumsum(keep) - 1)[cell[at]]
        m = len(out["n"])
        if valued:
            x, y = chunk.rows[0][row], got[1]
            out |= {name: np.bincount(cell, w, m) for name, w in zip(Sums.NAMES[1:], (x, y, x * y, x * x, y * y))}
        if sized:
            out["cb"] = np.zeros(m)
            out["cb"][cell] = got[-1]
        return out


def sent(columns: dict) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + BATCH]) for x in columns.values()], names=list(columns))


def coded(rows: DataFrame, *columns: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """rows with integers for columns of other types, which keep their order; the tables (column, code) to go back."""
    back = {}
    for c in columns:
        if not isinstance(rows.schema[c].dataType, T.IntegralType):
            back[c] = cut(rows.select(c).distinct().orderBy(c).select(c, F.monotonically_increasing_id().alias("code")))
            rows = rows.join(back[c], c).drop(c).withColumnRenamed("code", c)
    return rows, back


def decoded(df: DataFrame, column: str, names: DataFrame | None, kind: T.DataType) -> DataFrame:
    """df with what the integers of the column stand for."""
    if names is None:
        return df.withColumn(column, F.col(column).cast(kind))
    code, name = names.columns[1], names.columns[0]
    held = names.select(F.col(code).alias(column), F.col(name).alias("_name"))
    return df.join(held, column).withColumn(column, F.col("_name")).drop("_name")


def pairs(rows: DataFrame, key: str, element: str, least: int = 1, sizes: float | None = None, also: Callable | None = None) -> DataFrame:
    """(a, b, n): the pairs of keys a < b that share at least `least` > 0 elements, and how many; rows are distinct.
    `sizes` also gives na and nb, how many each has, and leaves out Jaccard similarities below that. `also` says of
    arrays of integer keys a and b which pairs to keep."""
    kind = rows.schema[key].dataType
    rows, back = coded(rows.select(key, element).dropna(), key, element)
    rows = once(rows)
    if sizes is not None:
        rows = once(rows.join(rows.groupBy(key).agg(F.count("*").cast("double").alias("_size")), key))
    more = ["_size"] if sizes is not None else []
    of = lists(rows, element, key, *more)

    def work(batches):
        for c in chunks(of, batches, 1 + len(more)):
            s = Sums(c, least, True, False, bool(more))
            out = {"a": c.ids[s.k], "b": s.b, "n": s.n.astype(np.int64)}
            if more:
                size = np.bincount(c.k, minlength=len(c.ids))[s.k]
                at = s.n / (size + s.cb - s.n) >= sizes
                out = {name: x[at] for name, x in (out | {"na": size, "nb": s.cb.astype(np.int64)}).items()}
            if also is not None:
                at = also(out["a"], out["b"])
                out = {name: x[at] for name, x in out.items()}
            yield from sent(out)

    cast = rows.select(F.col(key).cast("long").alias(key), F.col(element).cast("long").alias(element))
    got = by_key(cast, key, element).mapInArrow(work, "a long, b long, n long" + ", na long, nb long" * bool(more))
    names = back.get(key)
    return decoded(decoded(got, "a", names, kind), "b", names, kind).select(*got.columns)
