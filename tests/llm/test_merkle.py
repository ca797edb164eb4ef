"""The Merkle manifest against a brute force that builds every tree in memory."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from mensura.llm import merkle
from mensura.llm.catalog import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)))


def tree(leaves):
    """(top, for each leaf its steps as (before, after) lists of digests)."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            run = place // 16 * 16
            steps[i].append((level[run:place], level[place + 1:run + 16]))
        level = [h(*level[k:k + 16]) for k in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], steps


def brute(rows, lowered):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (mine, *tree([leaf(*r) for r in mine]))
    root, above = tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        mine, top, steps = trees[s]
        for r, way in zip(mine, steps):
            proof = "".join("".join(b) + "".join(a) for b, a in way + up)
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None and lowered(r[0]) else r[4]
            fold = leaf(*r[:4], text)
            for b, a in way + up:
                fold = h(*b, fold, *a)
            out.append((r[0], leaf(*r), top, root, h(proof), fold, fold == root))
    return sorted(out, key=str)


def run(df):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.manifest(df, {"text": F.when(chosen, lower)}).collect()), key=str)


def lowered(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


def test_groups_of_all_sizes(spark):
    rng = random.Random(1)
    rows = []
    for i, n in enumerate((1, 2, 15, 16, 17, 256, 257, 300)):
        rows += [(rng.randrange(10 ** 6), None if i == 2 else f"s{i}", "en", k, f"Text {k} of É {i}" * (k % 3)) for k in range(n)]
    rows += [(5, "", None, None, None), (None, "", "de", 3, "A b C"), (None, "", "de", 3, "A b C"), (7, "ü", "en", 1, "Same"), (7, "ü", "en", 1, "Same"),
             (7, "ü", "en", 1, "Other"), (8, "ü", "en", 0, ""), (9, "ü", "x" * 9, -4, "É" * 5000 + "Z")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = run(df)
    assert got == brute(rows, lowered) and len(got) == len(rows)
    assert {g[6] for g in got} == {True, False}


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert run(none) == []
    assert run(spark.createDataFrame([(1, "a", None, None, "x", "", 0)], SCHEMA)) == brute([(1, "a", None, None, "x")], lowered)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_merkle_manifest"](spark, sf).collect()), key=str) == brute(rows, lowered)
