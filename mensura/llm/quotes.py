"""Quotation linking: quoted passages lead to the messages they come from.

A message's lines are parsed by their ``>`` marks. Lines without one are its own text; a run
of lines of the same level is a quoted passage, whose lines are joined, as mail clients wrap them anew. A passage is
the hashes of its runs of SHINGLE words (lower case, without marks and punctuation); one of fewer words is the hash of
them all. An own text has the hashes of its runs of words between quotes, and of each of its lines, paragraphs and runs that is
shorter. Each hash of a passage is joined to the latest earlier message of the conversation that has it as its own; the
original of the passage is the message that most of its hashes lead to (the later one on a tie), if they
are SHARE of them or more, so a quote may be cut or edited in part. A message replies to the original
of its first linked passage on the lowest level. Replies make threads; the conversation is put in the order of
threads (by the turn of their first message, then by turn) and its texts lose their quotes.

Only conversations that hold a quote are hashed. The join runs along turns (a last value over hash groups), not over pairs, so
words that many messages share cost no more than their rows; groups are (conversation, hash, SPAN turns), and what earlier
spans hold is one row each, so neither a huge conversation nor a common passage meets in one task. Positions come
from range partitions.

Null text is empty; a row with a null conversation or turn replies to nothing and is first
in order. Repeated rows (same conversation and turn) are linked together, and each is
returned. Empty tables give an empty result. Columns other than conversation, turn, role and text are not
read. Quoted passages that no earlier message holds lead nowhere but are removed as well: they are the words of someone
who is not in the table. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import global_position
from ..session import cut_lineage
from .common import NOT_WORD, mix, word_hashes

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
QUOTED = r"(?m)^[ \t]*>"
SHINGLE = 5                  # words
SHARE = 0.5                  # of a passage's hashes that must lead to its original
SPAN = 4096                  # turns of a conversation that one window sees
_STEP = np.uint64(0xD6E8FEB86659FD93)


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(own text, its runs of lines between quotes, quoted passages as (level, text))."""
    own: list[str] = []
    runs: list[list[str]] = []
    passages: list[tuple[int, list[str]]] = []
    last = -1
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
            if last:
                runs.append([])
            runs[-1].append(line)
        else:
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end():])
        last = level
    return "\n".join(own).strip("\n") if passages else text or "", ["\n".join(r) for r in runs], [(n, "\n".join(x)) for n, x in passages]


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)], np.int64), NOT_WORD)[0]


def _runs_of(words: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for i in range(size):
        out = mix(out * _STEP + words[i:len(out) + i])
    return out


def _whole(words: np.ndarray) -> np.ndarray:
    return _runs_of(words, len(words)) if len(words) else words


def passage_hashes(text: str) -> np.ndarray:
    """Hashes of the runs of SHINGLE words, or of all words if they are fewer."""
    words = _words(text)
    return _runs_of(words, SHINGLE) if len(words) >= SHINGLE else _whole(words)


def own_hashes(runs: list[str]) -> np.ndarray:
    """Hashes that a passage of the message may have."""
    found = [np.zeros(0, np.uint64)]
    for run in runs:
        found.append(passage_hashes(run))
        for part in {*run.split("\n"), *re.split(r"\n\s*\n", run)}:
            words = _words(part)
            if 0 < len(words) < SHINGLE:
                found.append(_whole(words))
    return np.unique(np.concatenate(found))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, turn, role, text (own), n_quotes of every message."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(t) if t and ">" in t else (t or "", [], []) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64())],
                names=["conv", "turn", "role", "text", "n_quotes"])

    return messages.mapInArrow(run, "conv long, turn long, role string, text string, n_quotes long")


def hashed(messages: DataFrame) -> DataFrame:
    """conv, turn, passage (null: own text), level, size (hashes of the passage), h: every hash of every message."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
                _, runs, passages = parse(text)
                parts = [(None, None, own_hashes(runs))] + [(i, n, np.unique(passage_hashes(x))) for i, (n, x) in enumerate(passages)]
                h = np.concatenate([p[2] for p in parts])
                count = [len(p[2]) for p in parts]

                def spread(values: list, kind: pa.DataType, count: list = count) -> pa.Array:
                    return pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(count)), count)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(h), pa.int64()), pa.array([turn] * len(h), pa.int64()), spread([p[0] for p in parts], pa.int32()),
                     spread([p[1] for p in parts], pa.int32()), spread(count, pa.int64()), pa.array(h.view(np.int64))],
                    names=["conv", "turn", "passage", "level", "size", "h"])

    return messages.mapInArrow(run, "conv long, turn long, passage int, level int, size long, h long")


def links(messages: DataFrame) -> DataFrame:
    """conv, turn, reply_to, n_linked: the message that each message of (conv, turn, text) replies to."""
    whole = messages.where("conv is not null and turn is not null")
    quoting = whole.where(F.col("text").rlike(QUOTED)).select("conv").distinct()
    rows = cut_lineage(hashed(whole.join(quoting, "conv", "left_semi").select("conv", "turn", "text")).distinct())
    quoted = rows.where("passage is not null")
    own = rows.where("passage is null").join(quoted.select("conv", "h").distinct(), ["conv", "h"], "left_semi")    # others need no order
    both = own.unionByName(quoted).withColumn("span", F.floor(F.col("turn") / SPAN))
    mine = F.max(F.when(F.col("passage").isNull(), F.col("turn")))
    here = Window.partitionBy("conv", "h", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy("conv", "h", "span").agg(mine.alias("last"))
    before = Window.partitionBy("conv", "h").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.max("last").over(before)).drop("last").where("earlier is not null")
    led = both.withColumn("src", mine.over(here)).where("passage is not null").join(spans, ["conv", "h", "span"], "left")
    led = led.withColumn("src", F.coalesce("src", "earlier")).where("src is not null")
    votes = led.groupBy("conv", "turn", "passage", "level", "size", "src").count()
    best = votes.groupBy("conv", "turn", "passage", "level", "size").agg(F.max(F.struct("count", "src")).alias("b"))
    best = best.where(F.col("b.count") >= SHARE * F.col("size"))
    return best.groupBy("conv", "turn").agg(
        F.min(F.struct("level", "passage", F.col("b.src").alias("src"))).alias("m"), F.count(F.lit(1)).alias("n_linked")).select(
        "conv", "turn", F.col("m.src").alias("reply_to"), "n_linked")


def threads(replies: DataFrame) -> DataFrame:
    """conv, turn, reply_to, root_turn, depth of every message that replies to another one.

    Each round doubles the known part of the way to the root.
    """
    way = cut_lineage(replies.select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("steps")))
    if not way.limit(1).count():
        return way.select("conv", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("depth"))
    while True:
        above = way.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        nxt = cut_lineage(way.join(above, ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("up2").isNotNull().alias("moved")))
        way = nxt.drop("moved")
        if not nxt.where("moved").limit(1).count():
            return way.select("conv", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("depth"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Per message: conversation, turn, role, position (from 1, in reply order), reply_to, root_turn,
    depth, n_quotes (passages), n_linked, text without quotes."""
    given = messages.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = parsed(given)
    replies = cut_lineage(links(given))
    linked = replies.join(threads(replies), ["conv", "turn"])
    out = rows.join(linked, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
        "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.col("text").alias(text_col))
    placed = global_position(out, [conv_col], [F.col("root_turn"), F.col(turn_col), F.xxhash64(text_col), F.col(role_col)])
    return placed.withColumn("position", F.col("position") + 1).select(
        conv_col, turn_col, role_col, "position", "reply_to", "root_turn", "depth", "n_quotes", "n_linked", text_col)
