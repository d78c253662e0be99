"""Quality rules: a learned decision list.

Statistics of each text (counts and shares of words, symbols, repeats, lines) are computed once, over whole
texts. From labelled rows, sequential covering learns rules for low quality: a rule grows by the threshold
condition of most information gain on two thirds of the rows still uncovered, until it covers no good document or
no condition helps; it is pruned from its end on the other third; it joins the list if its precision there is at
least `precision`; the rows it covers leave. The list becomes one ordered conditional expression in Spark. There are as many
rules and conditions as help; what bounds the work are parameters: thresholds are tried at `steps` quantiles of a
statistic, a rule is sought while `least` bad rows are uncovered, and at most about `max_rows` labelled rows are learned
from. `short_share` is the share of words of at most three bytes.

Defined results: a null or empty text has statistics of 0; its decision is that of the rules for them; a text of any
length is measured whole. Rows without a label, or with a null one, are not learned from; without labelled rows of both
classes the list is empty and every document stays; empty tables give empty results. Among equal conditions the first by
name, then the lowest threshold, is taken. An id with several labels counts as low quality if any of them says so.
Every row of docs gives one row, repeated ones too. Of the columns only the id stays, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import written

STATS = ("caps_share", "digit_share", "line_repeat", "mark_share", "mean_word", "n_lines", "n_words", "pipe_share", "repeat_next", "short_share", "word_variety")
_CLASS = np.zeros((256, 5), np.float64)
_CLASS[65:91, 0] = 1  # capitals
_CLASS[48:58, 1] = 1  # digits
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = 1  # marks
_CLASS[124, 3] = 1  # |
_CLASS[[9, 10, 13, 32], 4] = 1  # white space


def statistics(texts: pa.Array) -> np.ndarray:
    """[rows, STATS]"""
    byte, at = K.raw(texts)
    n = len(texts)
    size = np.maximum(np.diff(at), 1)
    share = {}
    for k, name in enumerate(("caps", "digit", "mark", "pipe", "space")):
        total = np.concatenate([[0], np.cumsum(_CLASS[:, k].astype(bool)[byte])])
        share[name] = (total[at[1:]] - total[at[:-1]]).astype(float)
    w = K.Words(texts)
    words = np.diff(w.first)
    many = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    total = np.concatenate([[0], np.cumsum(length)])
    same = np.zeros(len(w.hash) + 1)
    if len(w.hash) > 1:
        same[2:] = np.cumsum((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
    kinds, first = K.distinct(w.hash, w.first)
    short = np.concatenate([[0], np.cumsum(length <= 3)])
    # lines: their hashes from sums over the bytes
    feed = np.flatnonzero(byte == 10)
    row = np.searchsorted(at, feed, "right") - 1
    full = np.flatnonzero(np.diff(at) > 0)
    start = np.sort(np.concatenate([at[:-1][full], feed + 1]))
    stop = np.sort(np.concatenate([at[1:][full], feed]))
    owner = np.sort(np.concatenate([full, row]))
    long = stop > start
    line, owner = K.hashes(byte, start[long], stop[long]), owner[long]
    bound = np.searchsorted(owner, np.arange(n + 1))
    lines = np.diff(bound)
    unique = np.diff(K.distinct(line, bound)[1])
    out = {
        "caps_share": share["caps"] / size,
        "digit_share": share["digit"] / size,
        "line_repeat": 1 - unique / np.maximum(lines, 1),
        "mark_share": share["mark"] / size,
        "mean_word": (total[w.first[1:]] - total[w.first[:-1]]) / many,
        "n_lines": lines.astype(float),
        "n_words": words.astype(float),
        "pipe_share": share["pipe"] / size,
        "repeat_next": (same[w.first[1:]] - same[np.minimum(w.first[:-1] + 1, w.first[1:])]) / many,
        "short_share": (short[w.first[1:]] - short[w.first[:-1]]) / many,
        "word_variety": np.diff(first) / many,
    }
    out["line_repeat"][lines == 0] = 0
    return np.stack([np.round(out[s], 6) for s in STATS], axis=1) if n else np.zeros((0, len(STATS)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = K.strings(batch.column(1))
        for lo, hi in K.chunks(texts):
            s = statistics(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(len(STATS)))], ["doc_id", *STATS])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics)"""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("i"), docs[text].cast("string").alias("t")).mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATS))


Rule = list  # of (statistic, "<=" or ">", threshold)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, sign, cut in rule:
        v = x[:, STATS.index(k)]
        out &= (v <= cut) if sign == "<=" else (v > cut)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, steps: int) -> Rule:
    """Adds the condition of most information gain (positives kept times the fall in their code length)."""
    rule: Rule = []
    here = np.ones(len(x), dtype=bool)
    while True:
        p, n = (here & bad).sum(), (here & ~bad).sum()
        if not p or not n:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(STATS):
            v = x[here, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, steps), method="lower"))[:-1]
            if not len(cuts):
                continue
            order = np.argsort(v, kind="stable")
            good = np.concatenate([[0], np.cumsum(~bad[here][order])])
            real = np.concatenate([[0], np.cumsum(bad[here][order])])
            at = np.searchsorted(v[order], cuts, "right")
            for sign, a, b in (("<=", real[at], good[at]), (">", p - real[at], n - good[at])):
                gain = a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1e-9)) - now)
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (gain[i], (name, sign, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        here &= covers([best[1]], x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, steps: int = 65, least: int = 5) -> list[tuple[Rule, float]]:
    """The decision list as (rule, precision on the pruning rows), in order."""
    out: list[tuple[Rule, float]] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while (left & bad & ~prune).sum() >= least:
        g, q = left & ~prune, left & prune
        rule = _grow(x[g], bad[g], steps)
        best: tuple[float, Rule] = (-2.0, [])
        for size in range(len(rule), 0, -1):
            c = covers(rule[:size], x[q])
            p, n = (c & bad[q]).sum(), (c & ~bad[q]).sum()
            worth = (p - n) / max(p + n, 1)
            if worth >= best[0] and p + n:
                best = (worth, rule[:size])
        if not best[1]:
            break
        c = covers(best[1], x[q])
        p, n = (c & bad[q]).sum(), (c & ~bad[q]).sum()
        if (p + 1) / (p + n + 2) < precision:
            break
        out.append((best[1], float(p / (p + n))))
        left &= ~covers(best[1], x)
    return out


def expression(rules: list[tuple[Rule, float]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, (rule, _) in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & ((F.col(name) <= cut) if sign == "<=" else (F.col(name) > cut))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def decided(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", max_rows: int = 100_000, precision: float = 0.9, steps: int = 65, least: int = 5) -> DataFrame:
    """(doc_id, statistics, rule, keep): one row a document, decided by the list learned from at most about
    max_rows labelled documents, drawn by a hash of their ids."""
    stats = written(measured(docs, doc_id, text))
    marks = labels.select(labels[label_id].alias("i"), labels[label].cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"))
    total = marks.count()  # at most about max_rows of them are broadcast
    if total > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < int(1_000_003 * max_rows / total))
    rows = stats.join(F.broadcast(marks), stats["doc_id"] == marks["i"]).select("i", "y", *STATS).toPandas()
    rows = rows.assign(o=(rows["i"].rank(method="dense").astype("int64") * 2654435761) % 4294967296).sort_values(["o", *STATS], kind="stable") if len(rows) else rows
    rules = learn(rows[list(STATS)].to_numpy(dtype=float).reshape(-1, len(STATS)), rows["y"].to_numpy() == 0, precision, steps, least) if len(rows) else []
    return stats.withColumn("rule", expression(rules)).withColumn("keep", F.col("rule") == 0)
