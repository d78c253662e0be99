"""Chat formatting by quotation linking.

Messages are parsed into lines of quote levels (leading '>' marks); a line that introduces a quotation ("... wrote:")
right before one is dropped with it. Each paragraph, line and sentence of a message's own words, and of what it quotes at
each level, is normalised (case, white space and marks at its ends) and hashed. A quoted passage joins the latest
earlier message of the conversation that says it in its own words; the message with most quoted characters at the
outermost level that joins is the parent. A message that quotes nothing known answers the one before it. Each
conversation becomes one row: messages in the order of replies (a parent before its answers, answers by turn),
with their own words only.

Both joins are one to one: of the messages that say the same passage, the turns are gathered in one row.

Defined results: messages are ordered by turn, then role, then text; null turns come last. Exact copies of a row
count once. A turn that is no whole number counts as null. A null role is null, a null text is the empty message; texts
of any length are parsed whole. A row without conversation id is a conversation by itself. A message that only quotes
keeps an empty text. An empty table gives an empty result. Extra columns are ignored, whatever their names. A
conversation is one row, so it has to fit a task; only the links, not the messages of a conversation, are found apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

_MARK = re.compile(r"[ \t]*>")
_INTRO = re.compile(r"^[^>\n]*(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.I)
#: Where a sentence ends.
_END = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])\s*")


def levels(text: str) -> list[tuple[int, str]]:
    """The lines of a text as (quote level, words)."""
    out = []
    for line in text.split("\n"):
        level = 0
        while m := _MARK.match(line):
            level, line = level + 1, line[m.end() :]
        out.append((level, line.strip() if level else line.rstrip()))
    kept, after = [], None
    for level, line in reversed(out):
        if not (after and after > level and _INTRO.match(line)):
            kept.append((level, line))
        if line or level:
            after = level  # of the next line that isn't empty
    return kept[::-1]


def normal(words: str) -> str:
    return " ".join(words.lower().split()).strip(" .,;:!?-\"'*_")


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(level, normalised passage) of each line, each paragraph of more than one line and each sentence of a
    paragraph; passages of any length."""
    out, held, at = [], [], -1
    for level, line in [*lines, (-1, "")]:
        if level != at or not line.strip():
            if held:
                whole = " ".join(held)
                out += [(at, normal(x)) for x in (whole, *_END.split(whole))]
            held, at = [], level
        if line.strip():
            held.append(line)
            out.append((level, normal(line)))
    return list(dict.fromkeys(p for p in out if p[0] >= 0 and p[1]))


def own_words(lines: list[tuple[int, str]]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for level, x in lines if level == 0)).strip()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the own words and the passages that are hashed."""
    for batch in batches:
        words, found = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            lines = levels(text or "")
            words.append(own_words(lines))
            found.append([{"level": a, "passage": b} for a, b in passages(lines)])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.string()), pa.array(found, kind)], [*batch.schema.names[:-1], "words", "found"])


def reply_order(parent: list[int]) -> list[tuple[int, int]]:
    """(message, depth) in the order of replies; parent[m] < m, or -1."""
    after: list[list[int]] = [[] for _ in parent]
    for m, p in enumerate(parent):
        if p >= 0:
            after[p].append(m)
    out = []
    stack = [(m, 0) for m in reversed(range(len(parent))) if parent[m] < 0]
    while stack:
        m, depth = stack.pop()
        out.append((m, depth))
        stack += [(c, depth + 1) for c in reversed(after[m])]
    return out


MESSAGE = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("parent_turn", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("quotes", T.BooleanType())])
_ARROW = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("parent_turn", pa.int64()), ("depth", pa.int32()), ("quotes", pa.bool_())]))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rows in batch.column(1).to_pylist():
            rows.sort(key=lambda r: r["m"])
            parent = [r["m"] - 1 if r["parent"] is None else r["parent"] for r in rows]
            out.append([{"turn": rows[m]["turn"], "role": rows[m]["role"], "text": rows[m]["words"], "parent_turn": rows[parent[m]]["turn"] if parent[m] >= 0 else None, "depth": d, "quotes": rows[m]["parent"] is not None} for m, d in reply_order(parent)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in out], pa.int64()), pa.array(out, _ARROW)], ["conv_id", "n_messages", "messages"])


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_messages, messages): one row a conversation."""
    kind = messages.schema[conv].dataType
    rows = messages.select(messages[conv].alias("conv"), messages[turn].try_cast("long").alias("turn"), messages[role].cast("string").alias("role"), messages[text].cast("string").alias("text")).distinct()
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.concat(F.lit("r"), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256))))
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("m", (F.row_number().over(order) - 1).cast("int"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("conv", kind), T.StructField("m", T.IntegerType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("words", T.StringType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("passage", T.StringType())])))])
    parsed = written(rows.select("key", "conv", "m", "turn", "role", "text").mapInArrow(_parse, schema))
    said = parsed.select("key", "m", F.explode("found").alias("f")).select("key", "m", "f.level", F.sha2("f.passage", 256).alias("h"), F.length("f.passage").alias("size"))
    first = said.where("level = 0").groupBy("key", "h").agg(F.sort_array(F.collect_set("m")).alias("by"))
    hit = said.where("level > 0").join(first, ["key", "h"]).withColumn("parent", F.array_max(F.filter("by", lambda t: t < F.col("m")))).where("parent is not null")
    vote = hit.groupBy("key", "m", "level", "parent").agg(F.sum("size").alias("size"))
    best = vote.groupBy("key", "m").agg(F.max_by("parent", F.struct(-F.col("level"), "size", "parent")).alias("parent"))
    whole = parsed.select("key", "conv", "m", "turn", "role", "words").join(best, ["key", "m"], "left")
    grouped = whole.groupBy("key").agg(F.first("conv").alias("conv"), F.collect_list(F.struct("m", "turn", "role", "words", "parent")).alias("rows"))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("n_messages", T.LongType()), T.StructField("messages", T.ArrayType(MESSAGE))])
    return grouped.select("conv", "rows").mapInArrow(_build, schema)
