"""Two tokenizers' tokens of the same text, aligned by bytes.

Tokenizer A is byte-level (tokenizers library), B a piece model (sentencepiece) that puts a space
before the text, so both sides cover the bytes of space + text. In a task, the tokens of a few
documents at a time form two frames (document, byte start, byte end, id), and pandas' merge_asof
gives each token start of one side the covering token of the other, keyed by document. The
union of both directions is every overlapping pair once. Pairs that end together are the
links; their ends cut the text into groups.

How often an id pair is linked in the whole corpus is a sum over all documents. The
shorter token of a linked pair is a byte suffix of the longer one, so the pairs that can occur follow
from the two vocabularies alone: at most one for every byte of every token (times the ids that
spell the same bytes). A document's links are kept as positions in that list, tasks add
up their own before the exchange, and the table of sums that is sent back to the tasks has at most
as many rows as the list, whatever the size of the corpus.

Texts that are null or empty, or whose tokens on either side don't spell space + text again, have
no tokens: zeros and an empty string. Each row is aligned on its own, so null and repeated ids need no
care. Ties for the highest count of a B id are all the highest. An empty table gives an empty
result. Texts of any length are taken whole; memory is that of one document's tokens or of
SLICE_BYTES of shorter ones. Of the input only the id and the text are read.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices, text_buffers
from .pieces import PieceEncoder, bytes_of_ids

MEMO = 300_000              # pieces kept in each of two generations
_LOADED: dict[tuple[str, str], Vocabularies] = {}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens and the pairs that can end together."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True          # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = bytes_of_ids(self.a)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.pairs = self._pairs()
        self.pieces = PieceEncoder(lambda t: self.a.encode_batch_fast([t], add_special_tokens=False)[0].ids, self.a_bytes, MEMO)

    def _pairs(self) -> np.ndarray:
        """Sorted codes ``a * len(b) + b`` of all id pairs of which one is a byte suffix of the other."""
        by_a, by_b = defaultdict(list), defaultdict(list)
        for i, t in enumerate(self.a_bytes):
            by_a[t].append(i)
        for i, t in enumerate(self.b_bytes):
            by_b[t].append(i)
        n, found = len(self.b_bytes), set()
        for t, ids in by_a.items():
            for k in range(len(t)):
                found.update(a * n + b for b in by_b.get(t[k:], ()) for a in ids)
        for t, ids in by_b.items():
            for k in range(len(t)):
                found.update(a * n + b for a in by_a.get(t[k:], ()) for b in ids)
        return np.array(sorted(found), np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none on either where a side does not spell the text again."""
        a = [np.frombuffer(ids, np.uint32) for ids in self.pieces.many(texts)]
        b = [np.array(ids, np.uint32) for ids in self.b.encode(texts, num_threads=1)]
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if (not text or b"".join(map(self.a_bytes.__getitem__, a[i].tolist())) != whole
                    or b"".join(map(self.b_bytes.__getitem__, b[i].tolist())) != whole):
                a[i] = b[i] = np.zeros(0, np.uint32)
        return a, b


def load(a_path: str, b_path: str) -> Vocabularies:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Vocabularies(a_path, b_path)
    return _LOADED[a_path, b_path]


def _frame(ids: list[np.ndarray], length: np.ndarray, base: np.ndarray) -> pd.DataFrame:
    """The tokens of a few documents: doc, id, start and end; documents stand at ``base`` of one line of bytes."""
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64)
    doc, size = np.repeat(np.arange(len(ids)), counts), length[flat]
    end = np.cumsum(size)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    before = np.append(0, end)[first]
    end += np.repeat(base - before, counts)
    return pd.DataFrame({"doc": doc, "start": end - size, "end": end, "id": flat, "at": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Every pair of overlapping tokens once: doc, and position (at), end and id of both."""
    under_a = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))
    starts = a["start"].to_numpy()
    at = np.searchsorted(starts, b["start"].to_numpy())
    same = np.append(starts, -1)[at] == b["start"].to_numpy()       # those pairs are in the first direction already
    under_b = pd.merge_asof(b[~same], a, on="start", by="doc", suffixes=("_b", "_a"))
    return pd.concat([under_a, under_b[under_a.columns]], ignore_index=True)


def _spelled(a: pd.DataFrame, b: pd.DataFrame, cuts: np.ndarray, docs: int, names: tuple) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every document: groups in order, each with the ids of both sides."""
    first_a, rest_a, first_b, rest_b = names
    group_a, group_b = (np.searchsorted(cuts, x["end"].to_numpy()) for x in (a, b))
    parts = []
    for ids, group, lead, rest in ((a, group_a, first_a, rest_a), (b, group_b, first_b, rest_b)):
        new = np.ones(len(ids), bool)
        new[1:] = group[1:] != group[:-1]
        number = ids["id"].to_numpy()
        parts.append(np.where(new, lead[number], rest[number]))
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    words = np.concatenate(parts)[order]
    doc = np.concatenate([a["doc"].to_numpy(), b["doc"].to_numpy()])[order]
    at = np.searchsorted(doc, np.arange(docs + 1))
    return ["".join(words[x:y].tolist())[1:] for x, y in zip(at[:-1], at[1:])]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_overlaps, n_groups, n_links, groups (``a1,a2|b1;a3|b2``) and links.

    ``links`` holds for each link, in order, the 4-byte position of its id pair in ``Vocabularies.pairs``.
    """
    names = [id_col, "n_a", "n_b", "n_overlaps", "n_groups", "n_links", "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(a_path, b_path)
        spelled = tuple(np.array([f"{mark}{i}" for i in range(n)], object)
                        for n, marks in ((len(v.a_bytes), ";,"), (len(v.b_bytes), "|,")) for mark in marks)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for x, y in slices(offsets):
                texts = [t or "" for t in batch.column(1).slice(x, y - x).to_pylist()]
                ids_a, ids_b = v.tokens(texts)
                base = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])[:-1]
                a, b = _frame(ids_a, v.a_length, base), _frame(ids_b, v.b_length, base)
                both = overlaps(a, b)
                end, linked = both["end_a"].to_numpy(), np.flatnonzero(both["end_a"].to_numpy() == both["end_b"].to_numpy())
                linked = linked[np.argsort(end[linked], kind="stable")]
                cuts, doc = end[linked], both["doc"].to_numpy()[linked]
                pair = np.searchsorted(v.pairs, both["id_a"].to_numpy()[linked] * len(v.b_bytes) + both["id_b"].to_numpy()[linked])
                n = y - x
                count = [np.bincount(f["doc"].to_numpy(), minlength=n) for f in (a, b, both)]
                n_links = np.bincount(doc, minlength=n)
                at = np.concatenate([[0], np.cumsum(n_links)]) * 4
                packed = pair.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, n), *map(pa.array, count), pa.array(n_links), pa.array(n_links),
                     pa.array(_spelled(a, b, cuts, n, spelled), pa.large_string()),
                     pa.array([packed[p:q] for p, q in zip(at[:-1], at[1:])], pa.large_binary())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_a long, n_b long, n_overlaps long, n_groups long, n_links long, groups string, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (position in ``Vocabularies.pairs``) and how many links of all rows hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=len(total))
            got[:len(total)] += total
            total = got
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` without links, with n_best and count_sum of the links' corpus-wide counts, and groups_sha256 for groups."""
    spark = docs.sparkSession
    path = scratch_path(spark, "align")
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    kept = align(docs, a_path, b_path, id_col, text_col).select(
        id_col, "n_a", "n_b", "n_groups", "n_links", "n_overlaps", sha, "links")
    kept.write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    counted = pair_counts(kept).toPandas()          # at most one row for each pair of the vocabularies
    v = load(a_path, b_path)
    number = np.zeros(len(v.pairs), np.int64)
    number[counted["pair"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    b_id = v.pairs % len(v.b_bytes)
    most = np.zeros(len(v.b_bytes), np.int64)
    np.maximum.at(most, b_id, number)
    sent = spark.sparkContext.broadcast((number, number == most[b_id]))
    names = [*kept.columns[:-1], "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best = sent.value
        for batch in batches:
            links = [np.frombuffer(x, "<i4") for x in batch.column(len(batch.columns) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([int(best[x].sum()) for x in links], pa.int64()),
                 pa.array([int(number[x].sum()) for x in links], pa.int64())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{kinds}, n_best long, count_sum long")
