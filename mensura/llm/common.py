"""Shared helpers: reading tables, learning folds, and word hashes of Arrow text columns.

Word hashes are computed on the bytes of a whole Arrow column at once. A-Z and a-z
share an entry of the byte table, so the hash lower-cases A-Z and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
SLICE_BYTES = 1 << 20        # text that one vectorised step works on, a longer document excepted
POWERS = 1 << 12             # byte weights inside a word repeat after so many bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """Small Arrow batches for jobs started inside, whose rows are whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hashed_sample(rows: DataFrame, key: Column, size: int, total: int) -> DataFrame:
    """The ``size`` rows of smallest hash of ``key``, of ``total`` rows at most; equal tables give equal samples.

    A threshold lets only some eight times as many rows pass, so what is gathered to find the smallest does
    not grow with the number of tasks. ``key`` should tell rows apart.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    cut = int(min(1.0, 8.0 * size / max(1, total)) * (1 << 40))
    return rows.withColumn("_at", at).where(F.col("_at") < cut).orderBy("_at", *rows.columns).limit(size).drop("_at")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column starts with it (case does not count)."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null keys fall in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> np.ndarray:
    out, p = np.empty(POWERS, np.uint64), 1
    for i in range(POWERS):
        out[i] = p
        p = p * 0x9E3779B97F4A7C15 & MASK64
    return out


_POW = _powers()
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]

#: Bytes between words: the six ASCII white-space characters, or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text (or a single longer row)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the rows, in order, and the number of words up to each row.

    ``offsets`` has a row's start in ``data`` each, and the end. Returns (hashes, first)
    where row i has hashes[first[i]:first[i + 1]].
    """
    base, top = int(offsets[0]), int(offsets[-1])
    part, cut = data[base:top], offsets - base
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separators[part]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = cut[:-1][cut[:-1] < len(part)]
    start[rows] = inside[rows]                  # a word never crosses rows
    where = np.flatnonzero(inside)
    first_of = np.flatnonzero(start[where])     # index into ``where`` of each word's first byte
    first = np.searchsorted(where[first_of], cut, "left") if len(first_of) else np.zeros(len(cut), np.int64)
    if not len(first_of):
        return np.zeros(0, np.uint64), first
    length = np.diff(np.append(first_of, len(where)))
    at = np.arange(len(where)) - np.repeat(first_of, length)
    value = _BYTE[part[where]] * _POW[at & (POWERS - 1)]
    return mix(np.add.reduceat(value, first_of) + length.astype(np.uint64)), first
