"""Benchmark decontamination by spaced seeds, tolerant of substituted words.

A seed is a fixed mask over consecutive words; the words at its open positions are
hashed, those under its zeros ignored, so a hit survives changed words there. Seeds
of all benchmark positions form a table that the seeds of the documents are joined
to. The masks of an item are made for the substitutions it is allowed: every pattern of so many
changed words in the narrowest window of that number leaves one mask a place (``masks``), so no
passage that ``share`` accepts is missed. A hit names a diagonal (place in the document less place in the item), and the item
laid along it is verified word by word: the passage counts when, in some window of
``window`` item words (the whole item, if shorter), at least ``share`` of the words agree.

Documents are read once. A bit table of fixed size (2**20 to 2**27 bits, by the number of
benchmark seeds) lets through the seeds that may be in the table, and only the stretches
of word hashes around them leave the scan; false passes fall out in the join. Hits of one
document, item and diagonal are one row before they are verified.

Words are runs of ASCII letters and digits and of all other non-ASCII characters,
compared without regard to the case of A-Z, as 64-bit hashes. An item of fewer than ``least`` words is
found where all of them stand one after another, unchanged. Items without words match nothing. Null or empty texts and empty tables match
nothing. Rows that share an id are judged together; rows and items with a null id are told
apart by their texts. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import NOT_WORD, mix, slices, text_buffers, word_hashes

HEAVIEST, MOST_MASKS = 8, 6  # open positions of a mask at most, and masks that are worth a heavier one
SEARCH = 1 << 24             # masks times patterns that are tried; beyond it every (allowed + 1)-th word is open
DIAGONALS = 4096             # of a stretch and an item that are verified together
_STEP = np.uint64(0xD6E8FEB86659FD93)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's open positions at every place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2) + len(mask), np.uint64)
    for i, on in enumerate(mask):
        if on == "1":
            out = mix(out * _STEP + words[i:n + i])
    return out


@lru_cache
def masks(width: int, allowed: int) -> tuple[str, ...]:
    """Masks of which one fits between any ``allowed`` changed words of ``width`` words.

    Greedy, for the most open positions that MOST_MASKS masks do with. A mask of every (allowed + 1)-th position
    always suffices: of that many residues at least one has no changed word.
    """
    run = math.ceil((width - allowed) / (allowed + 1))
    for weight in range(min(HEAVIEST, width - allowed), run, -1):
        if math.comb(width, allowed) * math.comb(width - 1, weight - 1) > SEARCH:
            continue
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(width), allowed)])
        tried = [sum(1 << i for i in (0, *c)) for c in combinations(range(1, width), weight - 1)]
        free = np.array([np.any([patterns & (m << i) == 0 for i in range(width - m.bit_length() + 1)], axis=0) for m in tried])
        left, out = np.ones(len(patterns), bool), []
        while left.any() and len(out) < MOST_MASKS:
            best = int(np.argmax((free & left).sum(axis=1)))
            left &= ~free[best]
            out.append(f"{tried[best]:b}")
        if not left.any():
            return tuple(out)
    return (("1" + "0" * allowed) * (run - 1) + "1",) if run > 0 else ("1",)


def allowed_changes(width: int, share: float) -> int:
    """Most words of ``width`` that may differ where ``share`` of them must agree."""
    return max(k for k in range(width + 1) if width - k >= share * width or k == 0)


def mask_table(window: int, share: float, least: int) -> dict[int, tuple[str, ...]]:
    """Masks by the width of an item's window; widths with equal allowance share those of the narrowest.

    Below ``least`` words nothing may differ.
    """
    short = {width: ("1" * width,) for width in range(1, least)}
    narrowest: dict[int, int] = {}
    for width in range(max(1, least), window + 1):
        narrowest.setdefault(allowed_changes(width, share), width)
    return short | {width: masks(narrowest[k], k) for width in range(max(1, least), window + 1) for k in [allowed_changes(width, share)]}


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, words, ikey: hashed words of the benchmark texts and a key of the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                hashes, first = word_hashes(data, offsets[a:b + 1], NOT_WORD)
                words += [hashes[first[i]:first[i + 1]].view(np.int64) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    got = benchmark.select(F.col(item_col).cast("long").alias("item"), text_col).mapInArrow(run, "item long, words array<long>")
    return got.where(F.size("words") > 0).distinct().withColumn("ikey", F.xxhash64("item", "words"))


def _item_seeds(items: DataFrame, by_width: dict[int, tuple[str, ...]]) -> DataFrame:
    """seed, ikey, at: every seed of every item."""
    window = max(by_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for mask in by_width[min(window, len(words))]:
                    got = seeds(words, mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(got.view(np.int64)), pa.array([key] * len(got), pa.int64()),
                         pa.array(np.arange(len(got), dtype=np.int64))], names=["seed", "ikey", "at"])

    return items.select("ikey", "words").mapInArrow(run, "seed long, ikey long, at long")


def _bits(seeds_table: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit for each hash prefix in use; its size is fixed by ``count`` and never above 16 MB.

    The bits are set by a grouped job: each group is one 64-bit word of the table.
    """
    power = int(min(27, max(20, np.ceil(np.log2(max(count, 1) * 1024)))))
    slot = F.shiftrightunsigned("seed", 64 - power)
    words = seeds_table.select(slot.alias("slot")).select(
        F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << power - 6, np.int64)
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return table.view(np.uint64), power


def _stretches(docs: DataFrame, table: np.ndarray, power: int, used: list[str], reach: int) -> DataFrame:
    """doc, row, first, words, seed, place: a stretch of words around hits, a row for each hit."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    down, six = np.uint64(64 - power), np.uint64(6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            rows, firsts, stretches, hits, places = [], [], [], [], []
            for a, b in slices(offsets):
                words, first = word_hashes(data, offsets[a:b + 1], NOT_WORD)
                found = []
                for mask in used:
                    got = seeds(words, mask)
                    slot = got >> down
                    at = np.flatnonzero(bits[slot >> six] >> (slot & np.uint64(63)) & np.uint64(1))
                    row = np.searchsorted(first, at, "right") - 1
                    whole = at + len(mask) <= first[row + 1]      # a seed never crosses rows
                    found.append((row[whole], at[whole], got[at[whole]]))
                row, at, got = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((at, row))
                row, at, got = row[order], at[order], got[order]
                new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(at) > 2 * reach))) if len(row) else []
                for i, j in zip(new, np.append(new[1:], len(row)) if len(row) else []):
                    r = row[i]
                    lo, hi = max(first[r], at[i] - reach), min(first[r + 1], at[j - 1] + 2 * reach)
                    rows.append(a + r)
                    firsts.append(lo - first[r])
                    stretches.append(words[lo:hi].view(np.int64))
                    hits.append(got[i:j].view(np.int64))
                    places.append(at[i:j] - lo)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]), pa.array(firsts, pa.int64()),
                 pa.array(stretches, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64())),
                 pa.array(places, pa.list_(pa.int64()))], names=["doc", "row", "first", "words", "hits", "places"])

    return docs.mapInArrow(run, "doc long, row string, first long, words array<long>, hits array<long>, places array<long>")


def best_window(text: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int]:
    """(agreeing words, first item word) of the item's best window laid at ``shift``."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    same = np.zeros(len(item), np.int64)
    if hi > lo:
        same[lo:hi] = text[lo + shift:hi + shift] == item[lo:hi]
    run = np.cumsum(np.append(0, same))
    width = min(window, len(item))
    sums = run[width:] - run[:-width]
    at = int(np.argmax(sums))
    return int(sums[at]), at


def overlaps(docs: DataFrame, benchmark: DataFrame, *, window: int = 16, share: float = 0.8, least: int = 8,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """Per document and benchmark item that it holds: id, item, n_words (agreeing words of the
    best window), window (its width), at (its first word in the document)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "benchmark")
    _items(benchmark, item_col, item_text).write.parquet(path)
    items = spark.read.parquet(path)
    window = max(window, least, 1)
    by_width = mask_table(window, share, least)
    by_seed = _item_seeds(items, by_width)
    width = F.least(F.size("words"), F.lit(window))
    sizes = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0)), F.collect_set(width), F.sum(F.size("words"))).first()
    used = sorted({mask for w in sizes[1] for mask in by_width[w]}) or ["1"]
    table, power = _bits(by_seed, max((len(by_width[w]) for w in sizes[1]), default=0) * (sizes[2] or 0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).select(
        "doc", F.when(F.col("doc").isNull(), F.sha2("text", 256)).alias("row"), "text")
    found = _stretches(rows, table, power, used, sizes[0])
    path = scratch_path(spark, "stretches")
    found.write.parquet(path)
    found = spark.read.parquet(path).withColumn("key", F.xxhash64("doc", "row", "first", "words"))
    hits = found.select("key", F.explode(F.arrays_zip("hits", "places")).alias("h")).select(
        "key", F.col("h.hits").alias("seed"), F.col("h.places").alias("place")).distinct()
    lines = hits.join(by_seed, "seed").select("key", "ikey", (F.col("place") - F.col("at")).alias("shift")).distinct()
    # A text that repeats itself has very many diagonals: they are verified so many at a time.
    laid = lines.groupBy("key", "ikey", F.floor(F.col("shift") / DIAGONALS)).agg(F.collect_set("shift").alias("shifts")).select("key", "ikey", "shifts")
    both = laid.join(items, "ikey").join(found.select("key", "doc", "row", "first", F.col("words").alias("text")), "key")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def array(x: pa.Scalar) -> np.ndarray:
            return x.values.to_numpy(zero_copy_only=False)

        for batch in batches:
            out = []
            for item, ikey, words, shifts, doc, row, first, text in zip(*batch.columns):
                mine, theirs, width = array(text), array(words), min(window, len(words.values))
                best = max((*best_window(mine, theirs, s, window), s) for s in array(shifts).tolist())
                if best[0] >= (share * width if width >= least else width):
                    out.append((doc.as_py(), row.as_py(), item.as_py(), ikey.as_py(), best[0], width, first.as_py() + best[1] + best[2]))
            cols = list(zip(*out)) or [[]] * 7
            names = ["doc", "row", "item", "ikey", "n_words", "window", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "row" else pa.int64()) for n, c in zip(names, cols)], names=names)

    verified = both.select("item", "ikey", "words", "shifts", "doc", "row", "first", "text").mapInArrow(
        check, "doc long, row string, item long, ikey long, n_words long, window long, at long")
    apart = F.when(F.col("item").isNull(), F.col("ikey")).alias("_ikey")
    return verified.groupBy(F.col("doc").alias(id_col), F.col("row").alias("_row"), F.col("item").alias(item_col), apart).agg(
        F.max(F.struct("n_words", "window", (-F.col("at")).alias("at"))).alias("b")).select(
        id_col, item_col, "b.n_words", "b.window", (-F.col("b.at")).alias("at"))
