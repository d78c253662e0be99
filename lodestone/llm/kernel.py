"""Vectorised text kernel shared by the operators of this subpackage.

Texts arrive as Arrow strings; everything below works on their raw UTF-8 bytes with numpy, a few
megabytes at a time, so a worker's memory does not depend on the size of a batch. One document is never split: its
words and n-grams take about 20 times its bytes while it is worked on.

A *word* is a maximal run of letters, digits and other characters of the lower-cased text that are neither ASCII marks,
white space nor the marks of Latin-1 and of the blocks for punctuation; each character of a script that is written
without blanks (Han, kana, Thai, Lao, Khmer, Burmese) is a word by itself.

Null texts behave as empty ones: they have no words. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_GRAM = U(0xD6E8FEB86659FD93)
#: Bytes of text handled at once.
CHUNK_BYTES = 2 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Code point ranges of characters that part words, and of those that are words by themselves.
APART = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
ALONE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_RANGES = sorted([(a, b, 1) for a, b in APART] + [(a, b, 2) for a, b in ALONE])
_FROM, _TO, _SORT = (np.array(x) for x in zip((0, -1, 0), *_RANGES))
#: The words of a lower-cased text as a regular expression, in Python's form and in RE2's.
WORD, WORD_RE2 = (
    "[{1}]|[^\\x00-/:-`{{-\\x7f{0}{1}]+".format(*("".join(f"{form % a}-{form % b}" for a, b in x) for x in (APART, ALONE)))
    for form in ("\\U%08x", "\\x{%x}")
)
#: Ranges of more bytes are hashed by BLAKE2.
LONG = 1024
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n reproducible odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * _BASE + U(salt)) | U(1)


def hashes(byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes by its content, eight bytes at a time."""
    size = end - start
    padded = np.concatenate([byte, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(byte) + 1, "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        out = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U) * _BASE))
        live, k = np.flatnonzero((size > 8) & (size <= LONG)), 0
        while len(live):
            k += 8
            rest = size[live] - k
            out[live] = mix((eight[start[live] + k] & _MASK[np.minimum(rest, 8)]) ^ (out[live] * _GRAM))
            live = live[rest > 8]
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(byte[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def points(byte: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of the characters whose first bytes, 0xC0 or more, stand at `lead`."""
    b = np.concatenate([byte, np.zeros(3, np.uint8)])
    c0, c1, c2, c3 = (b[lead + k].astype(np.int64) & (255, 63, 63, 63)[k] for k in range(4))
    return np.where(c0 < 0xE0, (c0 & 31) << 6 | c1, np.where(c0 < 0xF0, (c0 & 15) << 12 | c1 << 6 | c2, (c0 & 7) << 18 | c1 << 12 | c2 << 6 | c3))


def strings(column: pa.Array) -> pa.Array:
    """A plain 64-bit-offset string array in which nulls are empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets (n + 1) of each, without copying."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    byte = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return byte[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each, one row at least."""
    _, at = raw(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """The words of some texts: `hash`, `doc` (row of each word), `first` (first word of each row,
    n + 1 of them) and their byte positions `start` and `end` in the lower-cased `bytes`."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(texts)
        self.bytes, self.at = raw(low)
        n = len(self.bytes)
        inside = _WORD[self.bytes]
        lead = np.flatnonzero(self.bytes >= 0xC0)
        point = points(self.bytes, lead)
        k = np.searchsorted(_FROM, point, "right") - 1
        sort = np.where(point <= _TO[k], _SORT[k], 0)
        apart, alone = lead[sort == 1], lead[sort == 2]
        width = 1 + (self.bytes[apart] >= 0xC0) + (self.bytes[apart] >= 0xE0) + (self.bytes[apart] >= 0xF0)
        for j in range(4):
            inside[apart[width > j] + j] = False
        new = np.zeros(n + 1, dtype=bool)
        new[:n] = inside
        new[1:n] &= ~inside[: max(n - 1, 0)]
        if len(alone):
            after = alone + 3 + (self.bytes[alone] >= 0xF0)
            new[alone] = True
            new[after[after < n]] |= inside[after[after < n]]
        cut = self.at[self.at < n]
        new[cut] |= inside[cut]
        self.start = np.flatnonzero(new)
        stop = np.zeros(n + 1, dtype=bool)
        stop[1:] = inside
        stop[:n] &= ~inside | new[:n]
        self.end = np.flatnonzero(stop)
        self.hash = hashes(self.bytes, self.start, self.end)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))

    def grams(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside a text, and their first bounds by text (rows + 1).
        With `short`, a text of 1 to n - 1 words gives one run of all its words."""
        h, first = self.hash, self.first
        size = np.diff(first)
        total = len(h)
        with np.errstate(over="ignore"):
            if total < n:
                whole = np.zeros(0, U)
            else:
                whole = h[: total - n + 1].copy()
                for k in range(1, n):
                    whole *= _GRAM
                    whole += h[k : total - n + 1 + k]
            left = np.repeat(first[1:], size)
            left -= np.arange(total)  # words left in the text
            ok = np.flatnonzero(left >= n)
            del left
            out = mix(whole[ok] + U(n))
            count = np.maximum(size - n + 1, 0)
            lone = np.flatnonzero((size > 0) & (size < n)) if short else np.zeros(0, np.int64)
            if len(lone):
                value = np.empty(len(lone), U)
                for k in range(1, n):
                    of = lone[size[lone] == k]
                    if len(of):
                        acc = h[first[of]].copy()
                        for j in range(1, k):
                            acc = acc * _GRAM + h[first[of] + j]
                        value[size[lone] == k] = mix(acc + U(k))
                at = np.concatenate([[0], np.cumsum(count)])
                out = np.insert(out, at[lone], value)
                count[lone] = 1
        return out, np.concatenate([[0], np.cumsum(count)])


def by_row(values: np.ndarray, first: np.ndarray, op=np.minimum, empty=0) -> np.ndarray:
    """op over the values of each row; `empty` for rows without any."""
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = op.reduceat(values, first[full])
    return out


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, and their bounds."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(first)))
