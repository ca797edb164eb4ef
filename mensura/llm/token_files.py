"""Token ids in binary files of patched frame-of-reference blocks, and back.

A file holds whole documents in order. Its ids are cut in blocks of 256. A block
stores its minimum, then every value less that minimum in a fixed number of bits, chosen so
that a given share of the block fits; the few larger values go to the file's
exception list (position, value) and are patched in on reading.

Layout, little-endian: magic ``PFR1``, counts (documents, ids, blocks, exceptions) as
u64; per document its id as i64, a byte that marks a null id, and its number of ids as
u64; per block its start in 8-byte words as u64, its minimum as u32, its width as u8;
exceptions as u64 positions and u32 values; the packed words as u64. A block of width w is
4w words: each run of 64 values takes w words.

Documents are range-partitioned by id, so a file is a run of the global order; file
names carry the attempt, and only the names in the manifest, which Spark commits, are
read. A lost executor leaves an unnamed file behind, never a wrong result.

Null texts hold only the end id. Rows with a null id come first; rows that share an id are
ordered by a hash of their text. An empty table gives no file and an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices, text_buffers
from .pieces import PieceEncoder, bytes_of_ids

BLOCK = 256
FILE_IDS = 4 << 20
TEXT_BYTES = 4 << 20        # of texts whose pieces are looked up together
MEMO = 400_000              # pieces kept in each of two generations
_LOADED: dict[str, PieceEncoder] = {}


def pack(ids: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, ...]:
    """(block starts, minima, widths, exception positions, exception values, words)."""
    blocks = -(-len(ids) // BLOCK)
    wide = np.zeros(blocks * BLOCK, np.uint64)
    wide[:len(ids)] = ids
    wide[len(ids):] = ids[-1] if len(ids) else 0
    rows = wide.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint64)
    rows = rows - low[:, None]
    at = min(BLOCK - 1, int(share * BLOCK))
    edge = np.partition(rows, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint64)
    width = np.frexp(edge.astype(np.float64))[1].astype(np.uint8)      # bits of the percentile; 0 for 0
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 64))])
    words = np.zeros(int(start[-1]), np.uint64)
    over = np.flatnonzero((rows >> width.astype(np.uint64)[:, None]).ravel())
    over = over[over < len(ids)]
    for w in np.unique(width[width > 0]).tolist():
        here = np.flatnonzero(width == w)
        runs = (rows[here] & np.uint64((1 << w) - 1)).reshape(len(here), BLOCK // 64, 64)
        out = np.zeros((len(here), BLOCK // 64, w), np.uint64)
        for i in range(64):
            word, shift = divmod(i * w, 64)
            out[:, :, word] |= runs[:, :, i] << np.uint64(shift)
            if shift + w > 64:
                out[:, :, word + 1] |= runs[:, :, i] >> np.uint64(64 - shift)
        words[start[here][:, None] + np.arange(BLOCK // 64 * w)] = out.reshape(len(here), -1)
    return start[:-1], low.astype(np.uint32), width, over, np.asarray(ids)[over].astype(np.uint32), words


def unpack(n: int, start: np.ndarray, low: np.ndarray, width: np.ndarray, over: np.ndarray,
           values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids that ``pack`` was given, as u32."""
    rows = np.zeros((len(low), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        here = np.flatnonzero(width == w)
        packed = words[start[here].astype(np.int64)[:, None] + np.arange(BLOCK // 64 * w)].reshape(len(here), BLOCK // 64, w)
        runs = np.zeros((len(here), BLOCK // 64, 64), np.uint64)
        for i in range(64):
            word, shift = divmod(i * w, 64)
            runs[:, :, i] = packed[:, :, word] >> np.uint64(shift)
            if shift + w > 64:
                runs[:, :, i] |= packed[:, :, word + 1] << np.uint64(64 - shift)
        rows[here] = (runs & np.uint64((1 << w) - 1)).reshape(len(here), BLOCK)
    ids = (rows + low.astype(np.uint64)[:, None]).astype(np.uint32).ravel()[:n]
    ids[over] = values
    return ids


def to_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, share: float) -> bytes:
    start, low, width, over, values, words = pack(ids, share)
    out = io.BytesIO()
    out.write(b"PFR1")
    for part, kind in (([len(counts), len(ids), len(low), len(over)], "<u8"), ([d or 0 for d in doc_ids], "<i8"),
                       ([d is None for d in doc_ids], "u1"), (counts, "<u8"), (start, "<u8"), (low, "<u4"),
                       (width, "u1"), (over, "<u8"), (values, "<u4"), (words, "<u8")):
        out.write(np.asarray(part).astype(kind).tobytes())
    return out.getvalue()


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids)."""
    if data[:4] != b"PFR1":
        raise ValueError("not a token file")
    at = 4

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    docs, n, blocks, extra = take(4, "<u8").tolist()
    ids, null, counts = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u8")
    parts = (take(blocks, "<u8"), take(blocks, "<u4"), take(blocks, "u1"), take(extra, "<u8"), take(extra, "<u4"))
    words = take((len(data) - at) // 8, "<u8")
    return [None if x else d for d, x in zip(ids.tolist(), null)], counts, unpack(n, *parts, words)


def encoder(path: str) -> PieceEncoder:
    """The tokenizers library, as its file sets it up, behind the piece memo, once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        _LOADED[path] = PieceEncoder(lambda t: tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, bytes_of_ids(tok), MEMO, apart=True)
    return _LOADED[path]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          share: float = 0.9) -> DataFrame:
    """Write every text's ids to files under ``folder``; returns the manifest.

    Manifest: file, start (ids in all files before it), n_docs, n_ids, part, seq. It has
    one row for about FILE_IDS ids, so its ordered running sum is small.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, task = encoder(path), TaskContext.get()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        held: list = [[], [], []]
        seq = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.pfr"
            ids = np.concatenate(held[2])
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(to_bytes(held[0], held[1], ids, share))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [task.partitionId()], "seq": [seq],
                                              "n_docs": [len(held[0])], "n_ids": [len(ids)]})
            held[:] = [[], [], []]
            return row

        size = 0
        for batch in batches:
            for x, y in slices(text_buffers(batch.column(1))[1], TEXT_BYTES):
                ids, counts = texts.column(batch.column(1).slice(x, y - x).cast(pa.large_string()).fill_null(""), end_id)
                docs, ends = batch.column(0).slice(x, y - x).to_pylist(), np.cumsum(counts)
                at = 0
                while at < len(docs):           # a file ends with the text that fills it
                    done = int(ends[at - 1]) if at else 0
                    to = min(len(docs), int(np.searchsorted(ends, done + FILE_IDS - size)) + 1)
                    held[0] += docs[at:to]
                    held[1] += counts[at:to].tolist()
                    held[2].append(ids[done:ends[to - 1]])
                    size += int(ends[to - 1]) - done
                    at = to
                    if size >= FILE_IDS:
                        yield flush()
                        seq, size = seq + 1, 0
        if held[0]:
            yield flush()

    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(*order)
    files = ordered.sortWithinPartitions(*order).mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long")
    manifest = f"{folder}/manifest.parquet"
    files.write.mode("overwrite").parquet(manifest)
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(manifest).withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start, n_tokens, ids_crc32."""
    names = [id_col, "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{base}/{name}") as file:
                    docs, counts, ids = from_bytes(file.read())
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts.astype(np.int64))
                begins = ends - counts.astype(np.int64)
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(begins + start), pa.array(ends - begins),
                     pa.array(crc, pa.int64())], names=names)

    parts = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("file", "start").repartition(parts, "file").mapInArrow(
        run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts to a new folder in the shared place and read the files back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id, id_col, text_col), folder, id_col)
