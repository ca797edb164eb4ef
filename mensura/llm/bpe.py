"""Byte-level BPE by longest matches and backtracking, exact and linear in the text.

The token bytes are mapped to Latin-1 and put in an Aho-Corasick automaton. A
pre-token is encoded from left to right: take the longest token that starts here; it
may follow the token before it only if the bytes of the two, merged on their own, give
these two tokens again. If not, the next shorter token that is a prefix is tried, and
when none is left the token before is given up. A position that led nowhere is marked
and not entered again, which keeps the walk linear. Whether two tokens may be
adjacent depends on the pair alone and is memoised.

Null and empty texts have no ids. Texts of any length are encoded whole, repeated rows
each on their own; an empty table gives an empty result. Of the input only the id and
the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pretokens import Bounded, TextEncoder

PAIRS_KEPT = 1_000_000
WORDS_KEPT = 100_000
_LOADED: dict[tuple[str, str], tuple[Ranks, TextEncoder]] = {}


class Ranks:
    """A rank file: the bytes of each token and the merges that the ranks imply."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.text = {r: t for t, r in self.rank.items()}
        self.auto = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.auto.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.auto.make_automaton()
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if there is none."""
        got = self._shorter.get(token)
        if got is None:
            text = self.text[token]
            got = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), -1)
            self._shorter[token] = got
        return got

    def merge(self, text: bytes) -> list[int]:
        """Plain merging: the lowest rank first, the leftmost on a tie."""
        rank = self.rank
        parts = [text[i:i + 1] for i in range(len(text))]
        ranks = [rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < 1 << 30:
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], 1 << 30)
        return [rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both, on their own, gives these two tokens again."""
        got = self._fits.get((left, right))
        if got is None:
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            got = self.merge(self.text[left] + self.text[right]) == [left, right]
            self._fits[left, right] = got
        return got

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        longest = [0] * len(word)
        for end, (back, token) in self.auto.iter(word.decode("latin-1")):
            longest[end - back] = token         # a longer match of the same start ends later
        text, fits = self.text, self.fits
        out: list[int] = []
        dead = bytearray(len(word) + 1)
        at, token = 0, longest[0]
        while True:
            after = at + len(text[token])
            if not dead[after] and (not out or fits(out[-1], token)):
                out.append(token)
                at = after
                if at == len(word):
                    return out
                token = longest[at]
                continue
            token = self.shorter(token)
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(text[token])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.tolist()))


def load(path: str, pattern: str) -> tuple[Ranks, TextEncoder]:
    """Ranks and the text encoder of a rank file, once per worker."""
    if (path, pattern) not in _LOADED:
        ranks = Ranks(path)
        words = Bounded(lambda w: array("I", ranks.encode(w.encode())).tobytes(), WORDS_KEPT)
        find = regex.compile(pattern).findall
        _LOADED[path, pattern] = ranks, TextEncoder(lambda t: b"".join(map(words.__getitem__, find(t))))
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int, as the rank file numbers them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, texts = load(path, pattern)
        for batch in batches:
            packed = [texts(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again, and give a digest of both directions.

    Columns: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256. A null text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, texts = load(path, pattern)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch.column(1):
                packed = texts(value.as_py())
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(ranks.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()),
                 pa.array(text_hash, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
