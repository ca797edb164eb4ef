"""Token alignment against a brute force over byte ranges."""

import collections
import hashlib

import public_tokenizers
from mensura.llm import align
from mensura.llm.catalog import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "a", "The cat.\nSat  on\tthe mat", "x" * 3000, "é ñ ß 日本 😀", "one two three " * 2000, "it's 12345 !!!", "a", "a",
         "has a ▁ lower block", "<|endoftext|> and <s> </s> <unk> <0x41>", "nul \x00 byte", " leading", "trailing  ", "ﬁ ligature ½", "﻿mark"]


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, digest per text, by comparing all token pairs of a document."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    alphabet = sorted(ByteLevel.alphabet())
    shown = [b for b in range(256) if chr(b) in alphabet]
    byte = {chr(b): b for b in shown} | dict(zip([c for c in alphabet if ord(c) > 255], [b for b in range(256) if b not in shown]))
    found, number = [], collections.Counter()
    for text in texts:
        ids_a, ids_b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        bytes_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append(None)
            continue

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out
        sa, sb = spans(bytes_a), spans(bytes_b)
        end_b = {y: j for j, (_, y) in enumerate(sb)}
        links = [(i, end_b[y]) for i, (_, y) in enumerate(sa) if y in end_b]
        over = sum(max(p[0], q[0]) < min(p[1], q[1]) for p in sa for q in sb) if len(sa) < 2000 else None
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids_a[i0:i + 1])) + "|" + ",".join(map(str, ids_b[j0:j + 1])))
            i0, j0 = i + 1, j + 1
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        number.update(pairs)
        found.append((len(ids_a), len(ids_b), len(groups), len(links), over, pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in number.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, 0, "") if f is None else (
        *f[:5], sum(number[p] == most[p[1]] for p in f[5]), sum(number[p] for p in f[5]), f[6]) for f in found]


def same(got, want):
    for g, w in zip(got, want, strict=True):
        row = (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_overlaps if w[4] is not None else None, g.n_best, g.count_sum, g.groups_sha256)
        assert row == w, (g, w)


def test_awkward_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pair int")
    got = align.score(docs, A, B).orderBy("doc_id").collect()
    want = brute(TEXTS)
    same(got, want)
    assert want[0] == want[1] == want[11] and want[12][0] > 0 and want[13][0] > 0
    null_ids = spark.createDataFrame([(None, "a b", "x", 1), (None, "a b", "x", 1)], docs.schema)
    assert [r.n_a for r in align.score(null_ids, A, B).collect()] == [2, 2]
    assert align.score(docs.limit(0), A, B).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    same(QUERIES["op13_align"](spark, sf).orderBy("doc_id").collect(), brute([d.text for d in docs]))


def test_groups_spell_the_text(spark):
    row = align.align(spark.createDataFrame([(7, "Overlapping tokens, grouped.")], "doc_id long, text string"), A, B).first()
    v = align.load(A, B)
    for side, spelled in ((0, v.a_bytes), (1, v.b_bytes)):
        ids = [int(i) for g in row.groups.split(";") for i in g.split("|")[side].split(",")]
        assert b"".join(spelled[i] for i in ids) == b" Overlapping tokens, grouped."
    assert row.n_groups == row.groups.count("|") == len(row.links) // 4
