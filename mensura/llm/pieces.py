"""Ids of many texts at a time, where equal pieces between spaces are encoded once.

The tokenizers used here never join a visible character and a following space, so a text may be cut before every single
space between two visible characters. The pieces of a batch that are not yet known are put in one
line and encoded by one call; the tokens' byte lengths say where each piece's ids end. A piece
counts only if tokens end where it ends; texts with a piece that doesn't, and the surroundings of other white
space, are encoded as they stand.

Where the tokenizer's pattern takes letters, marks and line ends apart (``apart``), a piece such as ``word.`` or
``word.\\nNext`` is put together from its words, so a word is encoded once whatever follows it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LINE = 1 << 14               # characters encoded by one call
MARKED = 10_000              # runs of marks that are kept
_WORD = "([A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ]+)([.,;:!?]*)"        # letters of any Unicode version, and marks
_WORDS = re.compile(f"{_WORD}(?:\n{_WORD})?").fullmatch


def bytes_of_ids(tok) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer; added tokens stand for their own text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    spelled = tok.get_vocab(with_added_tokens=True)
    out = [b""] * (1 + max(spelled.values()))
    added = set(tok.get_added_tokens_decoder())
    for token, i in spelled.items():
        if i in added:
            out[i] = token.encode()
        elif all(c in byte for c in token):
            out[i] = bytes(byte[c] for c in token)
    return out


class PieceEncoder:
    """``encode`` maps a text to ids; ``spelled`` has the bytes of every id.

    The memo is kept in two generations of at most ``most`` pieces each; what is asked for again moves to the
    young one. Pieces of over 64 characters are forgotten after their batch. ``apart``: letters, marks and a
    line end are always encoded each by themselves.
    """

    def __init__(self, encode: Callable[[str], Sequence[int]], spelled: Sequence[bytes], most: int, apart: bool = False):
        self.encode, self.most, self.apart = encode, most, apart
        self.bare: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.length = np.array([len(t) for t in spelled], np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Packed ids of space + piece for every wanted piece; nothing for pieces that can't stand alone."""
        old = self.old
        known = {p: old[p] for p in wanted if p in old}
        fresh = wanted.difference(old)
        made = [(p, *m.groups()) for p, m in zip(fresh, map(_WORDS, fresh)) if m and m.end(1) < len(p)] if self.apart else []
        if made:
            fresh.difference_update([m[0] for m in made])
            for word in {m[1] for m in made}.difference(known, self.young, fresh):
                if word in old:
                    known[word] = old[word]
                else:
                    fresh.add(word)
        safe = []
        for p in fresh:
            if p and p.strip() == p:
                safe.append(p)
            else:
                known[p] = b""
        for line in _lines(safe):
            known.update(self._line(line))
        if made:
            self._put_together(made, known)
        return known

    def _put_together(self, made: list[tuple], known: dict[str, bytes]) -> None:
        """Ids of (piece, word, marks, word after a line end or None, marks), whose first words are known."""
        young, marks = self.young, self.marks
        if len(marks) > MARKED:
            marks.clear()
        for mark in {m[2] for m in made} | {m[4] or "" for m in made} | {"\n", ""}:
            if mark not in marks:
                marks[mark] = array("I", self.encode(mark)).tobytes() if mark else b""
        if len(self.bare) > self.most // 2:
            self.bare.clear()
        for line in _lines({m[3] for m in made if m[3]}.difference(self.bare)):
            self.bare.update(self._bare_line(line))
        for piece, word, mark, after, mark_after in made:
            first = known.get(word) or young.get(word)
            if not first:
                known[piece] = b""
            elif after is None:
                known[piece] = first + marks[mark]
            else:
                known[piece] = first + marks[mark] + marks["\n"] + self.bare[after] + marks[mark_after]

    def _bare_line(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of every word without a space before it, from one line a word."""
        ids = np.array(self.encode("\n".join(words)), np.uint32)
        text = np.frombuffer("\n".join(words).encode() + b"\n", np.uint8)
        cut = np.searchsorted(np.cumsum(self.length[ids]), np.flatnonzero(text == 10)).tolist()
        packed = ids.tobytes()
        return {w: packed[4 * a:4 * b + 4] for w, a, b in zip(words, [0, *(c + 2 for c in cut)], cut)}

    def _line(self, pieces: list[str]) -> dict[str, bytes]:
        text = " " + " ".join(pieces)
        ids = np.array(self.encode(text), np.uint32)
        ends = np.cumsum(self.length[ids])
        want = np.flatnonzero(np.frombuffer(text.encode() + b" ", np.uint8) == 32)[1:]      # no piece holds a space
        cut = np.searchsorted(ends, want)
        if not (len(ends) and ends[-1] == want[-1] and (ends[cut] == want).all()):
            if len(pieces) == 1:
                return {pieces[0]: b""}
            half = len(pieces) // 2
            return self._line(pieces[:half]) | self._line(pieces[half:])
        packed, stop = ids.tobytes(), ((cut + 1) * 4).tolist()
        return {p: packed[a:b] for p, a, b in zip(pieces, [0, *stop[:-1]], stop)}

    def many(self, texts: Sequence[str], lead: bool = True) -> list[bytes]:
        """Packed ids of every text, with a space put before it if ``lead``."""
        split = [t.split(" ") for t in texts]
        heads = [b""] * len(split) if lead else [self._head(pieces) for pieces in split]
        young = self.young
        wanted = set().union(*split).difference(young)
        new = self._learn(wanted) if wanted else {}
        young.update(new)
        out = []
        for head, pieces in zip(heads, split):
            packed = list(map(young.__getitem__, pieces))
            out.append(head + (b"".join(packed) if all(packed) else self._around(pieces)))
        for piece in new:
            if len(piece) > 64:
                del young[piece]
        if len(young) >= self.most:
            self.old, self.young = young, {}
        return out

    def column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each text's followed by ``end``, and their number in each.

        Pieces are told apart by Arrow, so Python sees each distinct one once and the ids are put in place by one gather.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        coded = split.flatten().dictionary_encode()
        at, pieces = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        young = self.young
        wanted = {p for p in pieces if p not in young}
        new = self._learn(wanted) if wanted else {}
        young.update(new)
        known = pa.array(list(map(young.__getitem__, pieces)), pa.large_binary())
        alone = pc.binary_length(known).to_numpy() > 0
        broken = ~np.logical_and.reduceat(alone[at], first[:-1])
        # The first place of a row stands for its start, or for all of a text with a piece that can't stand alone.
        starts, heads, more = at[first[:-1]].tolist(), {}, [array("I", [end]).tobytes(), b""]
        for row, (piece, slow) in enumerate(zip(starts, broken.tolist())):
            if slow:
                own = texts[row].as_py().split(" ")
                head, rest = self._head(own), list(map(young.__getitem__, own))
                more.append(head + (b"".join(rest) if all(rest) else self._around(own)))
            else:
                if piece not in heads:
                    heads[piece] = array("I", self.encode(pieces[piece])).tobytes()
                more.append(heads[piece])
        if broken.any():
            at[np.repeat(broken, np.diff(first))] = len(pieces) + 1
        at[first[:-1]] = len(pieces) + 2 + np.arange(len(texts))
        for piece in [p for p in new if len(p) > 64]:
            del young[piece]
        if len(young) >= self.most:
            self.old, self.young = young, {}
        laid = pa.concat_arrays([known, pa.array(more, pa.large_binary())]).take(pa.array(np.insert(at, first[1:], len(pieces))))
        stops = np.frombuffer(laid.buffers()[1], np.int64)[first[1:] + np.arange(1, len(texts) + 1)] // 4
        return np.frombuffer(laid.buffers()[2], np.uint32, stops[-1]), np.diff(stops, prepend=0)

    def _head(self, pieces: list[str]) -> bytes:
        """Ids of the start of a text, up to the first cut; its pieces are taken from the list."""
        n = next((i for i in range(1, len(pieces)) if _cut(pieces[i - 1], pieces[i])), len(pieces))
        start = " ".join(pieces[:n])
        del pieces[:n]
        return array("I", self.encode(start)).tobytes() if start else b""

    def _around(self, pieces: list[str]) -> bytes:
        """Pieces that can't stand alone are joined with what is beside them."""
        out, run = [], pieces[:1]
        for before, piece in zip(pieces, pieces[1:]):
            if _cut(before, piece):
                out.append(self._run(run))
                run = [piece]
            else:
                run.append(piece)
        out.append(self._run(run))
        return b"".join(out)

    def _run(self, run: list[str]) -> bytes:
        return (len(run) == 1 and self.young.get(run[0])) or array("I", self.encode(" " + " ".join(run))).tobytes()


def _lines(pieces: Iterable[str]) -> Iterable[list[str]]:
    """The pieces in lists of about LINE characters."""
    line, size = [], 0
    for piece in pieces:
        line.append(piece)
        size += len(piece) + 1
        if size >= LINE:
            yield line
            line, size = [], 0
    if line:
        yield line


def _cut(before: str, piece: str) -> bool:
    """Whether a text may be cut before the space between these two pieces."""
    return bool(before and piece) and not before[-1].isspace() and not piece[0].isspace()
