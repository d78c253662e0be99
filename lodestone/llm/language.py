"""Language identification of mixed-language text.

A model is fitted on labelled documents: smoothed log-probabilities of byte trigrams inside words, one table a
language, and the scripts each language is written in. A word is scored by the sum over its trigrams, but only
for the languages that its script leaves; a further state `und` scores every trigram alike and wins where no
language explains the text. Viterbi finds the best labels of the words of a text under a penalty for each switch.

Most texts are in one language. A text needs no dynamic program if the best constant labelling is optimal, and
that holds if, against it, no run of words gains more than half the penalty for any other label: k labelled runs
cost at least k - 1 switches and gain at most k/2 penalties. All other texts go through the dynamic program, many
at a time, word by word.

Defined results: a null or empty text or one without words has lang null, no spans and is rejected. Ties go to
the language first by name. Every row gives one row, repeated ones too; a null label is not used in fitting; a very long
text is labelled whole. Empty tables give empty results and a model that knows no language and rejects all. `identify`
replaces columns that are named like its results; `identified` returns the columns it got, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import opened, shipped, unused

SLOTS = 1 << 17
#: Upper ends of code point ranges and the script below each; unknown ranges are script 0.
SCRIPTS = [(0x24F, 1), (0x36F, 0), (0x3FF, 2), (0x52F, 3), (0x58F, 4), (0x5FF, 5), (0x77F, 6), (0x8FF, 0), (0x97F, 7), (0xDFF, 8), (0xE7F, 9), (0x10FF, 10), (0x11FF, 11), (0x1DFF, 0), (0x1EFF, 1), (0x1FFF, 2), (0x303F, 0), (0x30FF, 12), (0x33FF, 0), (0x9FFF, 13), (0xABFF, 0), (0xD7FF, 11), (0x10FFFF, 0)]
_ENDS = np.array([e for e, _ in SCRIPTS])
_KIND = np.array([k for _, k in SCRIPTS], dtype=np.int8)
N_SCRIPTS = 14


def grams(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each byte's trigram within its word, and the first one of each word (words + 1)."""
    size = w.end - w.start
    first = np.concatenate([[0], np.cumsum(size)])
    pos = np.repeat(w.start - first[:-1], size) + np.arange(first[-1])
    b = w.bytes[pos].astype(np.uint32)
    left = np.zeros(len(b), np.uint32)
    left[1:] = b[:-1]
    right = np.zeros(len(b), np.uint32)
    right[:-1] = b[1:]
    left[first[:-1]] = 0
    right[first[1:] - 1] = 0
    return ((left << np.uint32(16) | b << np.uint32(8) | right) * np.uint32(0x9E3779B1)) >> np.uint32(15), first


def scripts(w: K.Words) -> np.ndarray:
    """The script of each word: that of its first character beyond ASCII, else Latin; -1 for numbers."""
    out = np.full(len(w.start), -1, np.int8)
    if not len(out):
        return out
    letter = (w.bytes >= 97) & (w.bytes <= 122)
    count = np.concatenate([[0], np.cumsum(letter)])
    out[count[w.end] > count[w.start]] = 1
    lead = np.flatnonzero(w.bytes >= 0xC0)
    if len(lead):
        b = np.concatenate([w.bytes, np.zeros(3, np.uint8)]).astype(np.int64)
        c0, c1, c2 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63
        point = np.where(c0 < 0xE0, (c0 & 31) << 6 | c1, np.where(c0 < 0xF0, (c0 & 15) << 12 | c1 << 6 | c2, 0x10000))
        kind = _KIND[np.searchsorted(_ENDS, point)]
        word = np.searchsorted(w.start, lead, "right") - 1
        word, at = np.unique(word, return_index=True)
        out[word] = kind[at]
    return out


class Model:
    """langs, log-probabilities [slots, langs + 1] (the last is und) and the languages of each script."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed

    def score(self, w: K.Words) -> np.ndarray:
        """[words, langs + 1]"""
        slot, first = grams(w)
        if not len(first) - 1:
            return np.zeros((0, self.table.shape[1]))
        out = np.add.reduceat(self.table[slot], first[:-1], axis=0).astype(np.float64)
        kind = scripts(w)
        out[kind < 0] = 0  # numbers say nothing
        out[~self.allowed[kind] & (kind >= 0)[:, None]] -= 1e3
        return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", max_rows: int = 20_000, margin: float = 0.5) -> Model:
    """Fits on at most about max_rows labelled rows, drawn by a hash of the text. The counts of trigrams are
    summed in Spark; what comes to the driver is one array of SLOTS numbers a language. `margin` is where the
    score of und lies between the mean score in the right language (1) and that of an unseen trigram (0)."""
    rows = docs.select(docs[lang].cast("string").alias("l"), docs[text].cast("string").alias("t")).where("l is not null and t <> ''")
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_003)) < int(1_000_003 * max_rows / total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = K.strings(batch.column(1))
            for lo, hi in K.chunks(texts):
                w = K.Words(texts[lo:hi])
                slot, first = grams(w)
                kind = scripts(w)
                doc = w.doc
                for name in set(names[lo:hi]):
                    own = (names[lo:hi] == name)[doc] & (kind >= 0)
                    to = seen.setdefault(name, (np.zeros(SLOTS, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                    to[0][:] += np.bincount(slot[np.repeat(own, np.diff(first))], minlength=SLOTS)
                    to[1][:] += np.bincount(kind[own], minlength=N_SCRIPTS)
        for name, (a, b) in seen.items():
            at, bt = np.flatnonzero(a), np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + len(bt))), pa.array(np.concatenate([at, bt + SLOTS])), pa.array(np.concatenate([a[at], b[bt]]))], ["l", "slot", "n"])

    found = rows.mapInArrow(count, "l string, slot long, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["l"].unique())
    table = np.zeros((SLOTS, len(langs) + 1), np.float32)
    allowed = np.zeros((N_SCRIPTS, len(langs) + 1), dtype=bool)
    allowed[:, -1] = True
    floor, mean = [], []
    for k, name in enumerate(langs):
        own = found[found["l"] == name]
        n = np.zeros(SLOTS + N_SCRIPTS)
        n[own["slot"].to_numpy()] = own["n"].to_numpy()
        c, s = n[:SLOTS], n[SLOTS:]
        p = (c + 0.1) / (c.sum() + 0.1 * SLOTS)
        table[:, k] = np.log(p)
        floor.append(np.log(0.1 / (c.sum() + 0.1 * SLOTS)))
        mean.append((c / max(c.sum(), 1)) @ np.log(p))
        allowed[:, k] = s > 0.01 * s.sum()
    if langs:
        table[:, -1] = np.mean(floor) + margin * (np.mean(mean) - np.mean(floor))
    return Model(langs, table, allowed)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best labels of each sequence; all sequences advance together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order])
    if not len(size) or not size[0]:
        return [np.zeros(0, np.int16) for _ in scores]
    n, states = len(order), scores[0].shape[1]
    back = np.empty((size.sum(), states), np.int16)  # by step: the previous label of each state
    flat = np.concatenate([scores[i] for i in order])
    first = np.concatenate([[0], np.cumsum(size)])
    best = flat[first[:-1]].copy()
    final = best.copy()
    keep = np.broadcast_to(np.arange(states, dtype=np.int16), (n, states))
    alive = n
    for t in range(1, int(size[0])):
        while size[alive - 1] <= t:
            alive -= 1
        now = best[:alive]
        top = now.argmax(axis=1)
        jump = now[np.arange(alive), top] - penalty
        stay = now >= jump[:, None]
        at = first[:alive] + t
        back[at] = np.where(stay, keep[:alive], top[:, None])
        best[:alive] = np.where(stay, now, jump[:, None]) + flat[at]
    out: list = [None] * n
    for k, i in enumerate(order):
        label = np.empty(size[k], np.int16)
        s = int(best[k].argmax())
        for t in range(size[k] - 1, -1, -1):
            label[t] = s
            if t:
                s = back[first[k] + t, s]
        out[i] = label
    return out


def labels(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; first: the first word of each text (texts + 1)."""
    size = np.diff(first)
    full = np.flatnonzero(size > 0)
    out = np.zeros(len(score), np.int16)
    if not len(full):
        return out
    total = np.zeros((len(size), score.shape[1]))
    total[full] = np.add.reduceat(score, first[full], axis=0)
    top = total.argmax(axis=1)
    out[:] = np.repeat(top, size)
    doc = np.repeat(np.arange(len(size)), size)
    gain = score - score[np.arange(len(score)), out][:, None]
    hard = np.zeros(len(size), dtype=bool)
    for s in range(score.shape[1]):
        run = np.concatenate([[0], np.cumsum(gain[:, s])])
        run = run[1:] - np.repeat(run[first[:-1]], size)  # gain since the start of the text
        span = 2 * np.abs(run).max() + 1
        low = _low(run, first, doc, span)
        hard[full] |= np.maximum.reduceat(run - low, first[full]) > penalty / 2
    which = np.flatnonzero(hard)
    for d, label in zip(which, viterbi([score[first[d] : first[d + 1]] for d in which], penalty)):
        out[first[d] : first[d + 1]] = label
    return out


def _low(run: np.ndarray, first: np.ndarray, doc: np.ndarray, span: float) -> np.ndarray:
    """The least of 0 and the running sums before each word of its text. Later texts lie lower by `span`, so one
    running minimum serves all of them."""
    before = np.empty(len(run))
    before[1:] = run[:-1]
    before[np.arange(len(run)) == first[doc]] = 0
    return np.minimum.accumulate(before - doc * span) + doc * span


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("lang", T.StringType())]))
RESULT = [T.StructField("lang_found", T.StringType()), T.StructField("lang_share", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("rejected", T.BooleanType())]


def _label(model, penalty: float, column: int, filtered: bool = False):
    """Adds the result to each row in place of the column of texts, the last; or, `filtered`, drops rejected rows."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(model)
        names = [*m.langs, "und"]
        for batch in batches:
            texts = K.strings(batch.column(column).cast(pa.string()))
            for lo, hi in K.chunks(texts):
                w = K.Words(texts[lo:hi])
                score = m.score(w)
                got = labels(score, w.first, penalty)
                n = hi - lo
                weight = np.zeros((n, len(names)))
                np.add.at(weight, (w.doc, got), 1)  # by words: one long key is one word
                count = np.diff(w.first)
                top, all_ = weight.argmax(axis=1), weight.sum(axis=1)
                none = count == 0
                rejected = none | (top == len(names) - 1)
                if filtered:
                    yield batch.slice(lo, n).filter(pa.array(~rejected))
                    continue
                new = np.ones(len(got), dtype=bool)
                new[1:] = (got[1:] != got[:-1]) | (w.doc[1:] != w.doc[:-1])
                at = np.flatnonzero(new)
                end = np.concatenate([at[1:], [len(got)]]) if len(at) else at
                d = w.doc[at]
                offsets = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
                word = pa.array(names)
                spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array((at - w.first[d]).astype(np.int32)), pa.array((end - w.first[d]).astype(np.int32)), word.take(pa.array(got[at]))], ["first_word", "end_word", "lang"]))
                lang = word.take(pa.array(top, mask=none))
                share = pa.array(weight[np.arange(n), top] / np.maximum(all_, 1), mask=none)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[: len(batch.columns) - 1]), lang, share, pa.array(count.astype(np.int64)), spans, pa.array(rejected)], [*batch.schema.names[:-1], *(f.name for f in RESULT)])

    return label


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, penalty: float = 12.0) -> DataFrame:
    """The columns `keep` (all, if None) with lang_found, lang_share (of the words), n_words, spans (runs of
    words in one language; words count from 0) and rejected (no words, or und leads)."""
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c not in {f.name for f in RESULT}]
    held = shipped(docs.sparkSession, model)  # a fixed size: SLOTS rows
    rows = docs.select(*(docs[c] for c in keep), docs[text].cast("string").alias(unused()))
    schema = T.StructType([*(docs.schema[c] for c in keep), *RESULT])
    return rows.mapInArrow(_label(held, penalty, len(keep)), schema)


def identified(docs: DataFrame, model: Model, text: str = "text", penalty: float = 12.0) -> DataFrame:
    """docs, all columns, without rejected documents."""
    return docs.mapInArrow(_label(shipped(docs.sparkSession, model), penalty, docs.columns.index(text), True), docs.schema)
