"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. Documents that a stage lets pass are unchanged, but for
the secrets that the fourth one hides. Null ids, null and empty texts, repeated rows, empty
tables and further columns are allowed everywhere; each stage says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import bpe, decontaminate, jaccard_join, language, secrets
from mensura.llm.common import unused
from mensura.session import scratch_path, tune


#: Between held-out labelled texts of the given tables (lowest share 0.94 of words) and texts in unlearned
#: languages of the same script (Finnish 0.39, Polish 0.04; random letters 0.02).
FAMILIAR = 2 / 3


#: Bytes of rows that go to a Python worker at a time: whole documents are held there and in the executor several times over.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """``fn`` under the session's settings and BATCH_BYTES, also where it is called by itself."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return fn(spark, docs, sf_dir)

    return run


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in the learned languages: not ``und``, and FAMILIAR or more of the words are familiar to the model.

    A text between two learned languages stays; one in another language or script, or of random letters, goes. Null, empty and letterless texts go. Without any labelled language nothing is known, and
    all documents stay.
    """
    model = language.learn(docs)
    if not model.languages:
        return docs
    own = unused(docs, "_lang_")
    judged = language.predict(docs, model, prefix=own)
    return judged.where((F.col(f"{own}pred") != "und") & (F.col(f"{own}known") >= FAMILIAR)).select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, and its name: a 64-bit digest of id and text, the same for equal rows only
    (but for a chance of n * n / 2**65 that any two of n rows clash)."""
    key = unused(docs, "_row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id (null: last) of each component of five-word Jaccard 0.8 or more.

    Of rows with equal id and text one stays. Different texts that share an id, also a null one, are
    documents of their own.
    """
    rows, key = _keyed(docs)
    found = jaccard_join.components(rows, percent=80, words=5, id_col=key).select(key, "component_id").distinct()
    named = found.join(rows.select(key, "doc_id").distinct(), key)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)).alias("m"))
    return rows.join(first.select(F.col("m")[key].alias(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item. Each row is judged by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, key = _keyed(docs)
    found = decontaminate.overlaps(rows, benchmark, id_col=key).select(key).distinct()
    return rows.join(found, key, "left_anti").select(*docs.columns)


@stage
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace strings judged to be secrets; every document stays."""
    return secrets.redact(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("byte_bpe", encode),
]

#: The stages learn, hash and merge; SQL can't express them. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
