"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece of text exactly one vocabulary token can end its encoding: the one whose
predecessor, the last token of the shorter prefix, may stand before it, that is, no merge of lower rank would have
crossed the border between the two. The table of these last tokens holds the encodings of all prefixes at once:
appending bytes extends it without touching what is there, and after an edit only the entries from the edit on are
redone, until as many entries as the longest token has bytes agree with the old ones.

Pieces come from the vocabulary's splitting pattern, so the result is that of the ordinary merge loop. Workers keep
the encodings of pieces they have met, MEMO at most. The vocabulary is a file of ranks whose path is a parameter.

Defined results: a null text has null ids, an empty one no ids; a text without blanks is one piece and costs time in
proportion to its bytes. Decoding null gives null, no ids the empty text; bytes that are not UTF-8 are replaced by
U+FFFD; null, negative and unknown ids raise an error. Every row gives one row, repeated ones too; an empty table gives
an empty result. Columns named ids or n_tokens are replaced, all others may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import opened, shipped, unused

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000


def load(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [ranks[k] for k in range(len(ranks))]


def split_table(tokens: list[bytes]) -> list[tuple[int, int]]:
    """The two tokens that each token was merged from; (t, t) for single bytes."""
    rank = {t: k for k, t in enumerate(tokens)}
    out = []
    for k, t in enumerate(tokens):
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            best = min((rank.get(parts[i] + parts[i + 1], k), i) for i in range(len(parts) - 1))
            if best[0] >= k:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out.append((rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (k, k))
    return out


class Encoder:
    """Encodes pieces of bytes. tokens and splits: from load and split_table."""

    def __init__(self, tokens: list[bytes], splits: list[tuple[int, int]], pattern: str = PATTERN):
        self.tokens, self.splits, self.pattern = tokens, splits, pattern
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.merge = {s: k for k, s in enumerate(splits) if s[0] != k}
        self.longest = max(map(len, tokens))
        self.allowed: dict[tuple[int, int], bool] = {}
        # by last two bytes: the lengths of tokens that end so, the longest first
        ends: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b stays apart from a when both lie side by side: undoes the merges of both from the
        last on, and looks for one across the border that would have come before the merge undone."""
        got = self.allowed.get((a, b))
        if got is not None:
            return got
        x, y, limit, ok = a, b, 1 << 60, None
        while ok is None:
            made = self.merge.get((x, y))
            if made is not None and made < limit:
                ok = False
            elif x > y:
                limit, x = x, self.splits[x][1]
                if x == limit:
                    limit, y = y + 1, self.splits[y][0]
                    if y + 1 == limit:
                        ok = True
            else:
                limit, y = y + 1, self.splits[y][0]
                if y + 1 == limit:
                    limit, x = x, self.splits[x][1]
                    if x == limit:
                        ok = True
        if len(self.allowed) > 4_000_000:
            self.allowed.clear()
        self.allowed[a, b] = ok
        return ok

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that ends the encoding of data[:end]; last[i] is that of data[:i + 1] for all i < end - 1."""
        rank = self.rank
        for n in self.ends.get(data[end - 2 : end], ()) if end > 1 else ():
            if n <= end:
                t = rank.get(data[end - n : end])
                if t is not None and (n == end or self.may_follow(last[end - n - 1], t)):
                    return t
        return rank[data[end - 1 : end]]

    def table(self, data: bytes) -> list[int]:
        last: list[int] = []
        for end in range(1, len(data) + 1):
            last.append(self.last_token(data, end, last))
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        out.reverse()
        return out

    def piece(self, data: bytes) -> list[int]:
        t = self.rank.get(data)
        return [t] if t is not None else self.walk(self.table(data))


class Prefixes:
    """The growing and changing encoding of one piece."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, encoder.table(data)

    def append(self, data: bytes) -> None:
        """Exact: the entries so far stay as they are."""
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self.encoder.last_token(self.data, end, self.last))

    def edit(self, at: int, removed: int, added: bytes) -> int:
        """Replaces data[at:at + removed]; the number of entries that had to be redone."""
        old, shift = self.last, len(added) - removed
        self.data = self.data[:at] + added + self.data[at + removed :]
        self.last, same = old[:at], 0
        for end in range(at + 1, len(self.data) + 1):
            t = self.encoder.last_token(self.data, end, self.last)
            self.last.append(t)
            k = end - 1 - shift
            same = same + 1 if end > at + len(added) and k >= at + removed and old[k] == t else 0
            if same >= self.encoder.longest:
                self.last += old[k + 1 :]
                return end - at
        return len(self.data) - at

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes, or of all."""
        return self.encoder.walk(self.last[:end])


def classes() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 white space, 3 other, as the splitting pattern sees them."""
    import regex

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, 3, np.uint8)
    for k, p in enumerate((r"\p{L}", r"\p{N}", r"\s")):
        found = "".join(regex.findall(p, text)).encode("utf-32-le")
        out[np.frombuffer(found, "<u4")] = k
    return out


def cuts(byte: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN start in texts of UTF-8 that lie one after another; at: their bounds."""
    n = len(byte)
    cls = kind[np.minimum(byte, 127)]
    lead = np.flatnonzero(byte >= 0xC0)
    char = (byte & 0xC0) != 0x80
    width = np.ones(n, np.int8)
    if len(lead):
        b = np.concatenate([byte, np.zeros(3, np.uint8)])
        c = [b[lead + k].astype(np.int64) & 63 for k in range(4)]
        first = b[lead].astype(np.int64)
        two, three = first < 0xE0, first < 0xF0
        point = np.where(two, (first & 31) << 6 | c[1], np.where(three, (first & 15) << 12 | c[1] << 6 | c[2], (first & 7) << 18 | c[1] << 12 | c[2] << 6 | c[3]))
        k = kind[np.minimum(point, 0x10FFFF)]
        size = np.where(two, 2, np.where(three, 3, 4))
        cls[lead], width[lead] = k, size
        for j in (1, 2, 3):
            more = size > j
            cls[lead[more] + j] = k[more]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True  # texts never share a piece
    start = edge.copy()
    start[1:n] |= (cls[1:] != cls[:-1]) & char[1:]
    space = np.flatnonzero((cls == 2) & char)
    after = space + width[space]
    last = ~edge[after]
    last[last] = cls[after[last]] != 2
    start[space[last]] = True  # the last space before other text stands apart,
    glued = after[last & (byte[space] == 32)]
    start[glued] = False  # and goes with that text if it is a blank
    tick = np.flatnonzero((byte == 39) & start[:n])
    if len(tick):
        b = np.concatenate([byte, np.zeros(3, np.uint8)])
        x, y = b[tick + 1], b[tick + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & ~edge[np.minimum(tick + 1, n)]
        pair = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & ~edge[np.minimum(tick + 1, n)] & ~edge[np.minimum(tick + 2, n)]
        for hit, size in ((one, 2), (pair, 3)):
            start[tick[hit] + 1] = False
            start[tick[hit] + size] = True
    return np.flatnonzero(start[:n])


class Batch:
    """The prefix tables of many short pieces at once, byte by byte. LONG and longer pieces go one by one."""

    LONG = 64

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.size = np.array([len(t) for t in encoder.tokens], np.int64)
        self.v = len(encoder.tokens)
        self.hash, self.id = self._sorted(_tokens(encoder.tokens))
        self.single = np.zeros(256, np.int64)
        for k, t in enumerate(encoder.tokens):
            if len(t) == 1:
                self.single[t[0]] = k
        split = np.array(encoder.splits, np.int64)
        self.left, self.right = split[:, 0].copy(), split[:, 1].copy()
        made = np.flatnonzero(self.left != np.arange(self.v))
        self.pair, order = self._sorted(self.left[made] * self.v + self.right[made])
        self.made = made[order]
        self.ends = np.zeros(65536, np.uint64)  # by last two bytes: a bit for each length below 64
        for k, lengths in encoder.ends.items():
            self.ends[k[0] << 8 | k[1]] = sum(1 << n for n in lengths if n < 64)
        self.starts = np.zeros(65536, np.uint64)  # the same by first two bytes
        for t in encoder.tokens:
            if 1 < len(t) < 64:
                self.starts[t[0] << 8 | t[1]] |= np.uint64(1 << len(t))
        self.seen = np.full(1 << 20, -1, np.int64)
        self.apart = np.zeros(1 << 20, dtype=bool)

    @staticmethod
    def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x, kind="stable")
        return x[order], order

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Encoder.may_follow for arrays, with a direct-mapped cache."""
        key = a * self.v + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.seen[slot] != key)
        out = self.apart[slot]
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            ok = self._decide(a[miss][first], b[miss][first])
            self.seen[slot[miss][first]] = new
            at = slot[miss][first]
            held = self.seen[at] == new  # of two new pairs in one slot the later one holds it
            self.apart[at[held]] = ok[held]
            out[miss] = ok[back]
        return out

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), 1 << 60, np.int64)
        while len(live):
            key = x * self.v + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            crossed = (self.pair[at] == key) & (self.made[at] < limit)
            done = crossed.copy()
            big = x > y
            # undo the later merge of the two; a single byte passes the turn to the other side
            nx = np.where(big, self.right[x], x)
            nl = np.where(big, x, y + 1)
            ny = np.where(big, y, self.left[y])
            stuck = np.where(big, nx == nl, ny + 1 == nl)
            sl = np.where(big, y + 1, x)
            sy, sx = np.where(stuck & big, self.left[y], ny), np.where(stuck & ~big, self.right[x], nx)
            limit = np.where(stuck, sl, nl)
            end = stuck & np.where(big, sy + 1 == limit, sx == limit)
            out[live[end & ~crossed]] = True
            done |= end
            x, y = sx, sy
            keep = ~done
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
        return out

    def encode(self, byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and their number for each piece."""
        size = end - start
        count = np.zeros(len(size), np.int64)
        parts: list = []
        for lo in range(0, len(size), 20_000):
            parts.append(self._encode(byte, start[lo : lo + 20_000], size[lo : lo + 20_000], count[lo : lo + 20_000]))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), count

    def _encode(self, byte, start, size, count) -> np.ndarray:
        order = np.argsort(-np.minimum(size, self.LONG), kind="stable")
        long = np.flatnonzero(size >= self.LONG)
        order = order[size[order] < self.LONG]
        s, n = start[order], size[order]
        widest = int(n.max()) if len(n) else 0
        last = np.zeros((len(s), widest), np.int64)
        prefix = _prefix(byte, s, n, widest)
        live = len(s)
        for e in range(1, widest + 1):
            while n[live - 1] < e:
                live -= 1
            at = s[:live]
            got = self.single[byte[at + e - 1]]
            open_ = np.arange(live)
            if e > 1:
                bits = self.ends[byte[at + e - 2].astype(np.int64) << 8 | byte[at + e - 1]]
                for m in range(e, 1, -1):
                    bit = np.uint64(1 << m)
                    own = open_[bits[open_] & bit != 0]
                    own = own[self.starts[byte[at[own] + e - m].astype(np.int64) << 8 | byte[at[own] + e - m + 1]] & bit != 0]
                    if not len(own):
                        continue
                    h = _between(prefix, own, e - m, e)
                    k = np.minimum(np.searchsorted(self.hash, h), self.v - 1)
                    hit = self.hash[k] == h
                    own, t = own[hit], self.id[k[hit]]
                    if m < e and len(own):
                        ok = self.may_follow(last[own, e - m - 1], t)
                        own, t = own[ok], t[ok]
                    if len(own):
                        got[own] = t
                        rest = np.ones(live, dtype=bool)
                        rest[own] = False
                        open_ = open_[rest[open_]]
                        if not len(open_):
                            break
            last[:live, e - 1] = got
        # walk back through all tables at once
        out = np.zeros((len(s), widest), np.int32)
        at, number = n.copy(), np.zeros(len(s), np.int64)
        live = np.flatnonzero(at > 0)
        while len(live):
            t = last[live, at[live] - 1]
            number[live] += 1
            out[live, widest - number[live]] = t
            at[live] -= self.size[t]
            live = live[at[live] > 0]
        count[order] = number
        single = {int(i): self.encoder.piece(byte[start[i] : start[i] + size[i]].tobytes()) for i in long}
        for i, ids in single.items():
            count[i] = len(ids)
        first = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(first[-1], np.int32)
        for k in range(widest):
            own = np.flatnonzero(number > k)
            flat[first[order[own]] + k] = out[own, widest - number[own] + k]
        for i, ids in single.items():
            flat[first[i] : first[i + 1]] = ids
        return flat


_BASE = K.U(0x9E3779B97F4A7C15)
_WIDE = 64
with np.errstate(over="ignore"):
    _FWD, _INV = (np.cumprod(np.array([1, *[b] * _WIDE], K.U), dtype=K.U) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))


def _tokens(tokens: list[bytes]) -> np.ndarray:
    """A hash of each token below _WIDE bytes that _between can take from running sums; 0 for longer ones."""
    with np.errstate(over="ignore"):
        return np.array([K.mix(np.array([((np.frombuffer(t, np.uint8).astype(K.U) + K.U(1)) * _FWD[: len(t)]).sum(dtype=K.U)], K.U))[0] if len(t) < _WIDE else K.U(0) for t in tokens], K.U)


def _prefix(byte, s, n, widest) -> np.ndarray:
    """[pieces, widest + 1]: running sums of each piece from its own start."""
    out = np.zeros((len(s), widest + 1), K.U)
    with np.errstate(over="ignore"):
        for e in range(widest):
            own = np.flatnonzero(n > e)
            out[own, e + 1] = out[own, e] + (byte[s[own] + e].astype(K.U) + K.U(1)) * _FWD[e]
    return out


def _between(prefix, own, a, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix((prefix[own, b] - prefix[own, a]) * _INV[a])


class _Known:
    """The encodings of pieces met so far, by their hashes in order."""

    def __init__(self, batch: Batch):
        self.batch = batch
        self.clear()

    def clear(self) -> None:
        self.hash, self.first, self.count, self.flat = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, byte, start, end) -> tuple[np.ndarray, np.ndarray]:
        """As Batch.encode; each distinct piece is encoded once."""
        h, at, back = np.unique(K.hashes(byte, start, end), return_index=True, return_inverse=True)
        k = np.searchsorted(self.hash, h)
        new = np.ones(len(h), dtype=bool)
        inside = k < len(self.hash)
        new[inside] = self.hash[k[inside]] != h[inside]
        flat, count = self.batch.encode(byte, start[at[new]], end[at[new]])
        first = np.cumsum(count) - count + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        self.hash, self.first, self.count = (np.insert(a, k[new], b) for a, b in ((self.hash, h[new]), (self.first, first), (self.count, count)))
        k = np.searchsorted(self.hash, h)[back]
        n = self.count[k]
        total = np.cumsum(n)
        out = self.flat[np.repeat(self.first[k] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        if len(self.hash) > MEMO:
            self.clear()
        return out, n


def _by_pattern(pattern: str):
    """Where the pieces of any pattern start and end."""
    import regex

    find = regex.compile(pattern).finditer

    def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, at = K.raw(texts)
        start, end = [], []
        for base, text in zip(at, texts.to_pylist()):
            for m in find(text):
                a = base + len(text[: m.start()].encode())
                start.append(a)
                end.append(a + len(m[0].encode()))
        return np.array(start, np.int64), np.array(end, np.int64)

    return split


class Vocabulary:
    """What workers need to encode: made once on the driver, of a fixed size."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.tokens, self.pattern = load(path), pattern
        self.splits = split_table(self.tokens)
        self.classes = classes()


def encoded(docs: DataFrame, vocabulary: str | Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) with ids (array<int>) and n_tokens; columns of these names are replaced."""
    held = shipped(docs.sparkSession, Vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_tokens")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(held)
        known = _Known(Batch(Encoder(v.tokens, v.splits, v.pattern)))
        other = None if v.pattern == PATTERN else _by_pattern(v.pattern)
        for batch in batches:
            column = batch.column(len(keep))
            texts = K.strings(column)
            for lo, hi in K.chunks(texts):
                byte, at = K.raw(texts[lo:hi])
                if other:
                    start, end = other(texts[lo:hi])
                else:
                    start = cuts(byte, at, v.classes)
                    end = np.concatenate([start[1:], [len(byte)]]) if len(start) else start
                flat, n = known.ids(byte, start, end)
                total = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, at)]
                null = column.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), ids, pa.array(np.diff(total), mask=null)], [*keep, "ids", "n_tokens"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.select(*(docs[c] for c in keep), docs[text].cast("string").alias(unused())).mapInArrow(encode, schema)


def decoded(df: DataFrame, vocabulary: str | Vocabulary, ids: str = "ids", to: str = "text") -> DataFrame:
    """df with the column `to`: the texts of the ids. Bytes that are not UTF-8 are replaced by U+FFFD."""
    held = df.sparkSession.sparkContext.broadcast(load(vocabulary) if isinstance(vocabulary, str) else vocabulary.tokens)

    @F.pandas_udf("binary")
    def decode(column):
        import pandas as pd

        words = held.value
        size = np.array([len(t) for t in words])
        flat, every = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size)
        null = column.isna().to_numpy()
        rows = [np.asarray(r) if len(r) else np.zeros(0, np.int64) for r in column[~null]]
        out = np.full(len(column), None, object)
        if not rows:
            return pd.Series(out)
        key = np.concatenate(rows)
        if key.dtype.kind not in "iu" or len(key) and (key.min() < 0 or key.max() >= len(words)):
            raise ValueError("an id is null or not one of the vocabulary")
        key = key.astype(np.int64)
        n = size[key]
        ends = np.cumsum(n)
        byte = flat[np.repeat(every[key] - ends, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])]
        out[~null] = [byte[a:b] for a, b in zip(cut, cut[1:])]
        return pd.Series(out)

    @F.pandas_udf("string")
    def readable(column):
        return column.map(lambda b: None if b is None else b.decode("utf-8", "replace"))

    binary = decode(df[ids].cast("array<int>"))
    return df.withColumn(to, readable(binary))
