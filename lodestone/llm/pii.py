"""Personal data by weak supervision.

Candidate spans come from wide patterns, each matched by itself. Labelers of three sorts vote on each candidate, +1, -1
or 0: strict patterns (shape, checksum, ranges), gazetteers (top-level domains, issuer prefixes, area codes, countries,
names of secrets) and context (words before and after the span). Nothing is labelled by hand:
expectation-maximisation over the votes estimates how reliable each labeler is for each kind of span and how likely each
candidate is real, and those probabilities train the final classifier, a logistic regression for each kind over votes,
length, shape and the word before the span, which decides about each span.

Votes and features are counted in Spark over all documents; what comes to the driver are counts of distinct
(kind, votes, features) combinations, whose number is bounded by the labelers and features, not by the data. Documents
that match NEEDED, which every candidate does, are read whole; the others hold none. Patterns have no longest length,
and start only where a run of their characters starts, so their time is in proportion to the text. A secret has at
least SHORT characters behind its name.

Defined results: null and empty texts hold no spans and stay as they are; texts of any length are read whole.
Overlapping spans that are held to be real are one, of the longest one's kind, of equal ones the first one's. Offsets
count characters. Repeated rows are treated alike. An empty table gives no spans; a kind of which there is no candidate
to learn from is decided by the labelers' prior. `spans` returns its own columns only; `redacted` returns the columns it
got, whatever their names.
"""

from __future__ import annotations

import ipaddress
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import opened, shipped

KINDS = ("EMAIL", "IP", "SSN", "PHONE", "CARD", "IBAN", "SECRET")
#: In the name before a secret, wherever the pattern below has one.
_NAMED = re.compile(r"(?i)token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth(?!ors?\b)|private[_-]?key|credential")
SHORT = 8
#: RE2: what every candidate holds, for skipping the texts without: a digit, an @, capitals like a key's or the name of a secret.
NEEDED = r"\p{Nd}|@|[A-Z]{20}|(?i:token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth|private|credential)"
#: What follows the name of a secret.
_VALUE = re.compile(rf"[\"'][^\"'\s]{{{SHORT},}}+[\"']|[^\s\"'<>(){{}},;]{{{SHORT},}}+")
#: Each is matched by itself, so a span of one never hides one of another.
WIDE: tuple[tuple[str, re.Pattern], ...] = (
    ("EMAIL", re.compile(r"(?<![\w.+%-])[.+%_-]*+[\w.+%-]++@[\w-]++(?:\.[\w-]++)*+")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9])|(?=[A-Za-z]*+\d)[A-Fa-f0-9]{32,}+(?![A-Za-z0-9]))")),
    ("SECRET", re.compile(rf"(?<![\w-])[\w-]{{2,}}+[ \t]*+[=:][ \t]*+[\"'](?=[^\"'\s]*\d)[^\"'\s]{{{SHORT},}}+[\"']")),
    ("SECRET", re.compile(r"(?<![\w-])(?P<name>[\w-]++)[\"']?[ \t]*+:?[=:][ \t]*+")),
    ("IP", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")),
    ("IP", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("SSN", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\d-])")),
    ("PHONE", re.compile(r"(?<![\w.])\+\d(?:[ ().-]{0,2}\d){7,14}(?![\d-])")),
    ("CARD", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])")),
    ("CARD", re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w])")),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
)
TLDS = frozenset("com net org edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch se no fi pl at be pt dev app ai me tv".split())
SECRET_NAMES = re.compile(r"(?i)token|secret|passw|pwd|api_?key|access_?key|auth|private|credential|AKIA|ASIA")
#: Countries of the IBAN registry with the length of theirs.
IBANS = dict(AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VA=22, XK=20)
#: Public resolvers, which are nobody's address.
RESOLVERS = frozenset(("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9"))
#: Four numbers that are all below this are taken for a version's.
VERSION = 20
AROUND = {
    "EMAIL": re.compile(r"(?i)mail|contact|write|reach|address|from|@"),
    "IP": re.compile(r"(?i)\bip\b|server|host|address|login|ping"),
    "SSN": re.compile(r"(?i)ssn|social|security"),
    "PHONE": re.compile(r"(?i)phone|call|tel|fax|mobile|cell|contact|dial"),
    "CARD": re.compile(r"(?i)card|visa|master|amex|credit|debit|pay|account"),
    "IBAN": re.compile(r"(?i)iban|bank|account|konto|cuenta|compte|transfer|pay"),
    "SECRET": SECRET_NAMES,
}
AGAINST = re.compile(r"(?i)\bversion|\bv\.?\s*$|\bisbn|\bdoi|\bissn|\bsection|\bpage|\bfigure|\bchapter|\border\s+(?:no|number)|\bcommit\b|\bsha-?\d|\bmd5|\bchecksum|\bexample\s*:")
LABELERS = 5
#: Slots of the word before a span.
BEFORE = 16


_LAST = re.compile(r"[^\W\d_]+(?=[\W\d_]*$)")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def votes(kind: str, span: str, before: str, after: str) -> tuple[tuple[int, ...], tuple[int, int, int]]:
    """The votes of shape, checks, gazetteer, context for and context against; and the length and shape in steps and
    the slot of the word before."""
    digits = re.sub(r"\D", "", span)
    shape = checks = gaz = 0
    if kind == "EMAIL":
        name, _, host = span.rpartition("@")
        shape = 1 if re.fullmatch(r"[A-Za-z0-9_+%-]+(?:\.[A-Za-z0-9_+%-]+)*", name) and re.fullmatch(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", host) else -1
        gaz = 1 if host.rpartition(".")[2].lower() in TLDS else -1
        checks = 1 if "." in host and ".." not in span else -1
    elif kind == "IP":
        try:
            address = ipaddress.ip_address(span)
        except ValueError:
            address = None
        part = [int(x) for x in span.split(".")] if ":" not in span else []
        shape = (0 if all(str(p) == x for p, x in zip(part, span.split("."))) else -1) if part else 1  # any four numbers have it
        checks = 1 if address or part and max(part) < 256 else -1
        gaz = -1 if span in RESOLVERS or part and max(part) < VERSION or not address or address.is_unspecified or address.is_loopback or address.is_multicast or address.is_reserved else 0 if address.is_private else 1
    elif kind == "SSN":
        shape = 1
        checks = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "PHONE":
        named = 1 if AROUND[kind].search(before) else -1  # bare digits have no shape, but for a name before them
        shape = named if span.isdigit() else 1 if re.fullmatch(r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}", span) else 1 if span[0] == "+" and 8 <= len(digits) <= 15 else -1
        checks = 1 if 9 <= len(digits) <= 15 else -1
        gaz = 1 if len(digits) >= 10 and digits[-10] in "23456789" else -1
    elif kind == "CARD":
        shape = 1 if len(digits) in (13, 14, 15, 16, 19) else -1
        checks = 1 if luhn(digits) else 0  # a failed sum is weak evidence: numbers are mistyped and masked
        gaz = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38", digits) else -1
    elif kind == "IBAN":
        bare = span.replace(" ", "")
        shape = 1 if IBANS.get(bare[:2]) == len(bare) else -1
        checks = 1 if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else -1
        gaz = 1 if bare[:2] in IBANS else -1
    else:
        value = re.split(r":?[=:]", span, maxsplit=1)[-1].strip(" \t\"'")
        shape = 0 if value.isalpha() and value[1:].islower() else 1 if re.fullmatch(r"[A-Za-z0-9_+/=.-]{12,}", value) else -1
        checks = 1 if entropy(value) > 3 and len(value) >= 16 else -1
        gaz = 1 if SECRET_NAMES.search(span) else 0
    context = 1 if AROUND[kind].search(before) or AROUND[kind].search(after) else 0
    against = -1 if AGAINST.search(before) else 0
    form = 2 * bool(re.search(r"[^\W\d]", span)) + (len(set(digits)) > 2)
    word = _LAST.search(before)
    return (shape, checks, gaz, context, against), (min(len(span) // 4, 12), form, zlib.crc32(word[0].lower().encode()) % BEFORE if word else 0)


def _matches(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    if not pattern.groups:
        for m in pattern.finditer(text):
            yield m.span()
        return
    at = 0
    while m := pattern.search(text, at):
        at = m.end()
        if _NAMED.search(m["name"]) and (value := _VALUE.match(text, at)):
            yield m.start(), value.end()
            at = value.end()


def candidates(text: str) -> Iterator[tuple[int, int, str, tuple, tuple]]:
    """Those of all kinds, which may overlap."""
    seen = set()
    for kind, pattern in WIDE:
        for a, b in _matches(pattern, text):
            if kind == "EMAIL":
                span = text[a:b]
                a += len(span) - len(span.lstrip(".+%-_"))
                b -= len(span) - len(span.rstrip(".-_"))
            if (a, b, kind) not in seen:
                seen.add((a, b, kind))
                yield a, b, kind, *votes(kind, text[a:b], text[max(0, a - 30) : a], text[b : b + 15])


class Classifier:
    """For each kind, weights of a logistic regression over the inputs of `inputs`."""

    def __init__(self, weights: dict[str, np.ndarray], reliability: dict[str, np.ndarray]):
        self.weights, self.reliability = weights, reliability

    def probability(self, kind: str, vote: tuple, extra: tuple) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[kind] @ inputs(vote, extra), -30, 30))))


def inputs(vote: tuple, extra: tuple) -> np.ndarray:
    """A constant, for and against of each labeler, the length, the shape and the word before."""
    return np.array([1.0, *(float(v == 1) for v in vote), *(float(v == -1) for v in vote), extra[0] / 12, *(float(extra[1] == k) for k in range(1, 4)), *(float(extra[2] == k) for k in range(BEFORE))])


def estimate(vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and conditionally independent labelers. vote: [patterns, labelers] of -1, 0, 1. Returns
    the probability that each pattern is real, and P(vote | class) as [labelers, 3, 2].

    A labeler that votes is right with one probability, its reliability, whatever the class; that it does not vote says
    nothing. It may be of no use but not contrary, so reliabilities are at least a half, and the classes cannot trade
    places or split what is real in two, however much data there is. The prior weighs a few votes at any size."""
    weight = np.array([4.0, 1.0])  # right and wrong
    j = vote.shape[1]
    right, p = np.full(j, weight[0] / weight.sum()), 0.5
    voted = (np.abs(vote) * count[:, None]).sum(axis=0)
    post = np.full(len(vote), 0.5)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-np.clip(vote @ np.log(right / (1 - right)) + math.log(p / (1 - p)), -50, 50)))
        good = ((vote == 1) * (post * count)[:, None] + (vote == -1) * ((1 - post) * count)[:, None]).sum(axis=0)
        right = np.clip((good + weight[0]) / (voted + weight.sum()), 0.5, 1 - 1e-6)
        p = float(np.clip((post @ count + 1) / (count.sum() + 2), 0.05, 0.95))
    share = voted / max(count.sum(), 1)
    rate = np.empty((j, 3, 2))
    rate[:, 1] = (1 - share)[:, None]
    rate[:, 2, 1] = rate[:, 0, 0] = right * share
    rate[:, 0, 1] = rate[:, 2, 0] = (1 - right) * share
    return post, rate


def train(x: np.ndarray, target: np.ndarray, count: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; targets are probabilities."""
    w = np.zeros(x.shape[1])
    count = count * min(1.0, 1e5 / max(count.sum(), 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (count * (target - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in _possible(K.strings(batch.column(0)))[1]:
            seen.update((c[2], *c[3], *c[4]) for c in candidates(text))
    if seen:
        names = ["kind", *(f"v{k}" for k in range(LABELERS)), "size", "form", "word", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(x) if k == 0 else pa.array(x, pa.int64()) for k, x in enumerate(zip(*((*key, n) for key, n in seen.items())))], names)


def _possible(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    rows = np.flatnonzero(pc.match_substring_regex(texts, NEEDED).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, int)
    return rows, texts.take(pa.array(rows)).to_pylist()


def fit(docs: DataFrame, text: str = "text") -> Classifier:
    """Estimates reliabilities from the candidates of all documents and trains the classifier."""
    schema = "kind string, " + ", ".join(f"v{k} long" for k in range(LABELERS)) + ", size long, form long, word long, n long"
    rows = docs.select(docs[text].cast("string").alias("t")).where("t <> ''").mapInArrow(_patterns, schema)
    keys = [c for c in rows.columns if c != "n"]
    found = rows.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).toPandas()
    weights, reliability = {}, {}
    for kind in KINDS:
        own = found[found["kind"] == kind]
        vote = own[[f"v{k}" for k in range(LABELERS)]].to_numpy(dtype=np.int64).reshape(-1, LABELERS)
        n = own["n"].to_numpy(dtype=float)
        post, reliability[kind] = estimate(vote, n)
        if len(own):
            x = np.array([inputs(tuple(v), e) for v, e in zip(vote, own[["size", "form", "word"]].to_numpy())])
            weights[kind] = train(x, post, n)
        else:  # nothing seen: the labelers' prior
            weights[kind] = np.array([-1.0, *([1.0] * LABELERS), *([-1.0] * LABELERS), *[0.0] * (4 + BEFORE)])
    return Classifier(weights, reliability)


def found(text: str, classifier: Classifier, memo: dict, threshold: float = 0.5) -> list[tuple[int, int, str, float]]:
    out = []
    for a, b, kind, vote, extra in candidates(text):
        key = (kind, vote, extra)
        p = memo.get(key)
        if p is None:
            p = memo[key] = classifier.probability(*key)
        if p >= threshold:
            out.append((a, b, kind, p))
    return merged(out)


def merged(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Overlapping spans as one that covers them all, of the longest one's kind."""
    out, most = [], 0
    for a, b, kind, p in sorted(spans, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            start, end, *was = out[-1]
            out[-1] = (start, max(end, b), *((kind, p) if b - a > most else was))
            most = max(most, b - a)
        else:
            out.append((a, b, kind, p))
            most = b - a
    return out


def redact(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("probability", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))


def spans(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_spans, spans, text) of the documents that hold personal data; text is redacted."""
    held = shipped(docs.sparkSession, classifier)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = opened(held), {}
        for batch in batches:
            rows, texts = _possible(K.strings(batch.column(1)))
            got = [(r, s, redact(t, s)) for r, t in zip(rows, texts) if (s := found(t, model, memo))]
            if got:
                r, s, t = zip(*got)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array([len(x) for x in s], pa.int64()), pa.array([[dict(zip(("start", "end", "kind", "probability"), y)) for y in x] for x in s], _ARROW), pa.array(t)], ["doc_id", "n_spans", "spans", "text"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_spans", T.LongType()), T.StructField("spans", SPANS), T.StructField("text", T.StringType())])
    return docs.select(docs[doc_id].alias("i"), docs[text].cast("string").alias("t")).mapInArrow(find, schema)


def redacted(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """docs, all columns and rows, with the spans of the text column replaced by [KIND]."""
    held = shipped(docs.sparkSession, classifier)
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = opened(held), {}
        for batch in batches:
            rows, texts = _possible(K.strings(batch.column(at)))
            new = {int(r): redact(t, s) for r, t in zip(rows, texts) if (s := found(t, model, memo))}
            if new:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(new)] = True
                col = pc.replace_with_mask(batch.column(at), pa.array(mask), pa.array([new[k] for k in sorted(new)], batch.column(at).type))
                batch = batch.set_column(at, batch.schema.field(at), col)
            yield batch

    return docs.mapInArrow(clean, docs.schema)
