"""Whole texts to token ids through a cache of space-separated pieces.

The tokenizers used here split a text by one pattern before any merge, and no match
goes from a visible character into a following space. So a text may be cut before
every single space between two visible characters, and each piece be encoded once per
worker. Pieces around other white space are joined again and encoded together.
"""

from __future__ import annotations

from collections.abc import Callable

Encode = Callable[[str], bytes]


class Bounded(dict):
    """A memo of ``make`` in two generations, which bound its size.

    When the young one is full it becomes the old one, and what is asked for again
    moves over. Keys of over 64 characters are never kept.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class TextEncoder:
    """Encode texts with ``encode`` (a short text to packed ids), piece by piece."""

    def __init__(self, encode: Encode, most: int = 250_000):
        self.encode = encode
        self.head = Bounded(lambda piece: self._piece("", piece), most // 10)
        self.tail = Bounded(lambda piece: self._piece(" ", piece), most)

    def _piece(self, lead: str, piece: str) -> bytes:
        """Ids of the piece, or nothing where a cut beside it would not be safe."""
        safe = piece and not piece[0].isspace() and not piece[-1].isspace()
        return self.encode(lead + piece) if safe else b""

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        packed = [self.head[pieces[0]], *map(self.tail.__getitem__, pieces[1:])]
        return b"".join(packed) if all(packed) else self._around_white_space(pieces)

    def _around_white_space(self, pieces: list[str]) -> bytes:
        out, lead, whole, last = [], "", pieces[0], pieces[0]
        for piece in pieces[1:]:
            if last and piece and not last[-1].isspace() and not piece[0].isspace():
                out.append(self._whole(lead, whole))
                lead, whole = " ", piece
            else:
                whole += " " + piece
            last = piece
        out.append(self._whole(lead, whole))
        return b"".join(out)

    def _whole(self, lead: str, piece: str) -> bytes:
        return (self.tail if lead else self.head)[piece] or (self.encode(lead + piece) if lead + piece else b"")
