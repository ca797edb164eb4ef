"""Encoding by pieces gives what the library gives for whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mensura.llm.pieces import PieceEncoder, bytes_of_ids

PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "é", "123", "!!", "　", "\x85", "\x1c", "᠎", "​", "日本", "😀", "'s", "'ll", "Th", "zqxj" * 30,
         "<|endoftext|>", "<|endof", "text|>", "\x00", "ﬁ", "x y z"]


@pytest.mark.parametrize("plain", [True, False])
@pytest.mark.parametrize("most", [20, 100_000])
def test_pieces_equal_whole_texts(plain, most):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = plain
    pieces = PieceEncoder(lambda t: tok.encode(t, add_special_tokens=False).ids, bytes_of_ids(tok), most)
    rng = random.Random(most)
    for _ in range(60):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 30))]
        for lead in (True, False):
            got = [np.frombuffer(x, np.uint32).tolist() for x in pieces.many(texts, lead)]
            assert got == [tok.encode(" " * lead + t, add_special_tokens=False).ids for t in texts]
    assert len(pieces.young) + len(pieces.old) <= 2 * most + 500


@pytest.mark.parametrize("most", [20, 100_000])
def test_a_column_of_texts_equals_whole_texts(most):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = PieceEncoder(lambda t: tok.encode(t, add_special_tokens=False).ids, bytes_of_ids(tok), most, apart=True)
    rng = random.Random(most)
    for _ in range(60):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 30))]
        texts += [" ".join(rng.choices(["the", "cat.", "sat.\nOn", "mat", "x" * 70], k=rng.randint(1, 9))) for _ in range(rng.randint(0, 9))]
        ids, counts = pieces.column(pa.array(["left out", *texts], pa.large_string())[1:], 2)
        assert len(counts) == len(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][:len(texts)] == [
            [*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(pieces.young) + len(pieces.old) <= 2 * most + 500


def test_a_column_meets_each_distinct_piece_once():
    seen = []

    class Memo(dict):
        def __getitem__(self, piece):
            seen.append(piece)
            return super().__getitem__(piece)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = PieceEncoder(lambda t: tok.encode(t, add_special_tokens=False).ids, bytes_of_ids(tok), 1000, apart=True)
    pieces.young = Memo()
    pieces.column(pa.array(["the cat sat on the mat and the cat sat"] * 500, pa.large_string()), 2)
    assert len(seen) <= 10
