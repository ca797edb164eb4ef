"""Language identification: known words first, shorter and shorter n-grams for the rest.

Learning counts words by language in a sample of labelled texts (``per_language`` texts of
each language at most, picked by a hash of the id; that bound is the only sample here). The
commonest words and the commonest character n-grams of the counted words, by language, are
the model; ``words`` and ``gram_bound`` bound them for each language, so the model grows with the
languages and not with the corpus, and a small language keeps its own.

A text's words are its runs of letters, lower-cased. A known word adds the log of its
relative frequency in each language. An unseen word is scored by the mean over its n-grams
(word ends marked) of the longest length of which the model knows any; a word without
any known letter adds nothing. The prediction is the language of the largest sum, ties to
the name that sorts first; its score is the posterior under equal priors times the share of
words that were scored, so text in an unknown script scores low. ``_lang_known`` is stricter: it is the
share of words that the model knows, or of whose three-letter n-grams it knows KNOWN_GRAMS or more, so it
is low for another language in a learned script and for random letters as well.

Null, empty and letterless texts are ``und`` with score 0, as is everything when there is
nothing to learn from. A text of which no word could be scored gets the first of the languages and score 0. Repeated rows get equal results; rows
with a null id are in fold 0 and predicted like any other; null languages are not learned.
Whole texts are read. Columns other than id, text and language are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold
from .pretokens import Bounded

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
SMOOTH = 0.5
KNOWN_GRAMS = 0.75
MEMO = 100_000
HELD = 200_000               # distinct keys of a language that a task counts before it passes them on
ONE = np.float32(1).tobytes()


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def words_of(token: str) -> list[str]:
    """The words of a lower-cased run of visible characters."""
    return [token] if token.isalpha() else LETTERS.findall(token)


def _rows(seen: dict[str, dict[str, int]], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang for lang, c in seen.items() for _ in c], pa.string()),
         pa.array([k for c in seen.values() for k in c], pa.string()),
         pa.array([n for c in seen.values() for n in c.values()], pa.int64())], names=["lang", key, "n"])


def _counted(rows: DataFrame) -> DataFrame:
    """lang, word, n over the rows (text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(*batch.columns):
                tokens = seen.setdefault(lang.as_py(), Counter())
                tokens.update(text.as_py().lower().split())
                if len(tokens) >= HELD:
                    yield _rows(_words(seen), "word")
                    seen = {}
        yield _rows(_words(seen), "word")

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _words(seen: dict[str, Counter]) -> dict[str, dict[str, int]]:
    """Counts of the words in counted tokens."""
    out: dict[str, dict[str, int]] = {}
    for lang, tokens in seen.items():
        mine = out[lang] = {}
        for token, n in tokens.items():
            for word in words_of(token):
                mine[word] = mine.get(word, 0) + n
    return out


def _gram_counts(counted: DataFrame) -> DataFrame:
    """lang, gram, n from the word counts; a gram's length is part of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                mine = seen.setdefault(lang, {})
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        mine[g] = mine.get(g, 0) + n
                if len(mine) >= HELD:
                    yield _rows(seen, "gram")
                    seen = {}
        yield _rows(seen, "gram")

    return counted.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    words: dict[str, bytes] = field(default_factory=dict)       # packed float32 scores by language
    grams: dict[str, bytes] = field(default_factory=dict)

    def unseen(self, word: str) -> bytes:
        """Scores of a word that the model does not know; empty if no n-gram helps."""
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [row for row in map(self.grams.get, grams(word, size)) if row]
            if known:
                rows = np.frombuffer(b"".join(known), np.float32).reshape(len(known), -1)
                return (np.add.reduce(rows, axis=0, dtype=np.float64) / len(rows)).astype(np.float32).tobytes()
        return b""

    def familiar(self, word: str) -> bool:
        """Whether the model knows the word or most of its three-letter n-grams."""
        if word in self.words:
            return True
        three = grams(word, 3)
        return bool(three) and sum(g in self.grams for g in three) >= KNOWN_GRAMS * len(three)

    def token(self, token: str) -> bytes:
        """A packed row for each word of a lower-cased token: its scores, a 1, and a 1 if it is familiar; or zeros if it can't be scored."""
        out = []
        for word in words_of(token):
            row = self.words.get(word) or self.unseen(word)
            out.append(row + ONE + (ONE if self.familiar(word) else bytes(4)) if row else bytes(4 * len(self.languages) + 8))
        return b"".join(out)

    def predict(self, text: str | None, memo: Bounded) -> tuple[str, float, float]:
        """(language, score, share of familiar words); ``memo`` keeps ``token``."""
        packed = b"".join(map(memo.__getitem__, text.lower().split())) if text and self.languages else b""
        rows = np.frombuffer(packed, np.float32).reshape(-1, len(self.languages) + 2)
        total = rows.sum(axis=0, dtype=np.float64)
        if not len(rows):
            return "und", 0.0, 0.0
        if not total[-2]:
            return self.languages[0], 0.0, 0.0
        best = int(np.argmax(total[:-2]))
        share = 1.0 / float(np.exp(total[:-2] - total[best]).sum())
        return self.languages[best], share * (float(total[-2]) / len(rows)), float(total[-1]) / len(rows)


def _scores(rows: list[tuple[str, str, int]], languages: list[str], totals: dict) -> dict[str, bytes]:
    """key -> packed log relative frequencies; ``totals``: (language, kind) -> all counts."""
    at = {lang: i for i, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for lang, key, n in rows:
        counts.setdefault(key, np.zeros(len(languages)))[at[lang]] = n
    kinds: dict = {}
    out = {}
    for key, c in counts.items():
        kind = totals["kind"](key)
        if kind not in kinds:
            kinds[kind] = np.array([totals.get((lang, kind), 0) for lang in languages], float)
        out[key] = np.log((c + SMOOTH) / (kinds[kind] + SMOOTH * 1000)).astype(np.float32).tobytes()
    return out


def _commonest(counted: DataFrame, key: str, bound: int) -> list[tuple[str, str, int]]:
    """(lang, key, n) of the ``bound`` commonest keys of each language; ties to the key that sorts first."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), key)
    kept = counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= bound).select("lang", key, "n")
    return [tuple(r) for r in kept.toArrow().to_pandas().itertuples(index=False)]


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = 3000, words: int = 25_000, gram_bound: int = 15_000) -> Model:
    """Fit on the rows of ``docs`` that have a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("at"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Model([])
    cut = F.create_map(*(F.lit(x) for lang, n in have.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))))
    counted = _counted(rows.where(F.col("at") < cut[F.col("lang")]).select("text", "lang")).persist()
    by_gram = _gram_counts(counted).persist()
    try:
        common, short = _commonest(counted, "word", words), _commonest(by_gram, "gram", gram_bound)
        totals = {(r["lang"], 0): r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        sizes = {(r["lang"], r["size"]): r["n"] for r in by_gram.groupBy("lang", F.length("gram").alias("size")).agg(
            F.sum("n").alias("n")).collect()}
    finally:
        counted.unpersist()
        by_gram.unpersist()
    return Model(languages, _scores(common, languages, totals | {"kind": lambda _: 0}),
                 _scores(short, languages, sizes | {"kind": len}))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", prefix: str = "_lang_") -> DataFrame:
    """Per row of ``docs``: all its columns, and ``_lang_pred``, ``_lang_score`` and ``_lang_known`` (or with another ``prefix``)."""
    added = [f"{prefix}{x}" for x in ("pred", "score", "known")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = Bounded(m.token, MEMO)
        for batch in batches:
            got = [m.predict(t.as_py(), memo) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.float64())], names=[*names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(added[0], StringType()),
                                            StructField(added[1], DoubleType()), StructField(added[2], DoubleType())]))


def identify(docs: DataFrame, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Learn from all folds but ``held`` of ``parts`` and predict every row: id, held_out, lang_pred, score."""
    model = learn(docs.where(fold(id_col, parts) != held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs.select(id_col, text_col), model, id_col, text_col).select(
        id_col, (fold(id_col, parts) == held).alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
        F.least(F.lit(1.0), F.col("_lang_score")).alias("score"))
