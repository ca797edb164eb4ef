"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Every text becomes a row of about thirty numbers (shares of kinds of bytes, entropy, words,
lines, repetition). Trees are grown by level from histograms of gradients over quantile
bins, on at most ``sample`` labelled rows (smallest hashes of their id): a documented
bound, so that the fit is a small job of the driver at any corpus size. The forest is
flattened in arrays (feature, threshold, child, value), which a batch of rows walks in a
few numpy steps for each level.

Null and empty texts are rows of zeros and scored like any other. Labels, language, source
and id are never inputs. Without labelled rows every score is 0.5; with one class only it
is that class's share, smoothed. Repeated rows get equal scores; a repeated label row
counts again. Rows with a null id are in fold 0 and can't be labelled. An empty table gives
an empty result. Columns other than id, text and label are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

_MARKS = b"!#%&*$|.,\"?:;-()<>@=/"
_KINDS = np.zeros((7 + len(_MARKS), 256))
_KINDS[0, 65:91] = _KINDS[1, 97:123] = _KINDS[2, 48:58] = _KINDS[3, 128:] = 1
_KINDS[4, [9, 11, 12, 13, 32]] = _KINDS[5, 10] = 1
_KINDS[6, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1
for _i, _c in enumerate(_MARKS):
    _KINDS[7 + _i, _c] = 1
N_FEATURES = len(_KINDS) + 12


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    hist = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = hist.sum()
    out[:len(_KINDS)] = _KINDS @ hist / n
    p = hist[hist > 0] / n
    words, lines = text.split(), text.split("\n")
    count = max(1, len(words))
    often = Counter(words)
    same = sum(map(operator.eq, words, words[1:]))
    ends = Counter(w[-1] for w in words)
    out[len(_KINDS):] = (
        np.log1p(n), float(-(p * np.log2(p)).sum()), np.log1p(len(words)), len(often) / count,
        max(often.values(), default=0) / count, same / count, sum(map(len, words)) / count,
        sum(map(len, often)) / max(1, len(often)), len(set(lines)) / len(lines), np.log1p(len(lines)),
        len(words) / len(lines), max(ends.values(), default=0) / count)
    return out


@dataclass
class Forest:
    """Trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray         # the left child; the right one follows it
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.cut[at]
            at = np.where(self.child[at] == at, at, self.child[at] + right)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32,
        least: float = 10.0, l2: float = 1.0) -> Forest:
    """Boost logistic loss on rows ``x`` with labels ``y`` (0 or 1)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    flat: list[list] = [[], [], [], []]
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        d = x.shape[1]
        edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T           # feature, edge
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(d)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(len(flat[0]))
            raw = raw + _tree(flat, binned, edges, g, h, depth, rate, bins, least, l2)
    kinds = (np.int64, float, np.int64, float)
    return Forest(*(np.array(v, k) for v, k in zip(flat, kinds)), np.array(roots, np.int64), base, depth)


def _tree(flat, binned, edges, g, h, depth, rate, bins, least, l2) -> np.ndarray:
    """Grow one tree by level, append it to the flat arrays, return each row's value."""
    n, d = binned.shape
    node = np.full(n, _leaf(flat), np.int64)
    live = [int(node[0])]
    cells = binned + np.arange(d) * bins
    for level in range(depth + 1):
        if not live:
            break
        slot = {v: i for i, v in enumerate(live)}
        place = np.array([slot.get(v, -1) for v in range(len(flat[0]))])[node]
        on = place >= 0
        size = len(live) * d * bins
        key = (place[on, None] * d * bins + cells[on]).ravel()
        hist = [np.bincount(key, np.repeat(v[on], d), size).reshape(len(live), d, bins) for v in (g, h)]
        total = [v[:, 0].sum(axis=1) for v in hist]
        left = [v.cumsum(axis=2)[:, :, :-1] for v in hist]
        right = [t[:, None, None] - v for t, v in zip(total, left)]
        gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - (total[0] ** 2 / (total[1] + l2))[:, None, None]
        gain[(left[1] * 4 < least) | (right[1] * 4 < least)] = -1
        nxt = []
        for v, i in slot.items():
            best = int(np.argmax(gain[i]))
            f, b = divmod(best, bins - 1)
            if level == depth or gain[i].flat[best] <= 1e-6:
                flat[3][v] = float(-rate * total[0][i] / (total[1][i] + l2))
                continue
            a = _leaf(flat)
            _leaf(flat)
            flat[0][v], flat[1][v], flat[2][v] = f, float(edges[f][b]), a
            mine = node == v
            node[mine] = a + (binned[mine, f] > b)
            nxt += [a, a + 1]
        live = nxt
    return np.array(flat[3])[node]


def _leaf(flat) -> int:
    at = len(flat[0])
    for column, v in zip(flat, (0, 0.0, at, 0.0)):
        column.append(v)
    return at


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample: int = 20_000) -> Forest:
    """Fit on the labelled documents, at most ``sample`` of them."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).orderBy(
        F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("_id"))   # ``sample`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))],
                                             names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("_id", "_y", text_col).mapInArrow(run, f"id {kind}, y double, x array<double>").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, N_FEATURES)
    y = (got.column("y").to_numpy() >= 0.5).astype(float)
    order = np.lexsort((*x.T, y))                # the same fit in whatever order the rows came
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = np.stack([features(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, label_col: str = "quality",
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from all folds but ``held`` and score every row: id, held_out, score, predicted."""
    forest = train(docs, labels.where(fold(id_col, parts) != held), label_col=label_col, id_col=id_col, text_col=text_col)
    return score(docs, forest, id_col, text_col).select(
        id_col, (fold(id_col, parts) == held).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
