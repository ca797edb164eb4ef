"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import align, bpe, decontaminate, html_crf, jaccard_join, language, merkle, neighbours, quality, quotes, secrets, token_files, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
#: (verdict, host, path) of the query on pages.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_neighbours(spark, sf):
    return neighbours.search(table(spark, sf, "embeddings"), lambda i: i % 20 == 0, 20)


@query
def op2_quotation_links(spark, sf):
    return quotes.conversations(table(spark, sf, "conversations"))


@query
def op3_link_propagation(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op4_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_secret_scan(spark, sf):
    """One row per candidate; the string itself only as a digest."""
    return secrets.scan(table(spark, sf, "documents")).select(
        "doc_id", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"),
        F.round("score", 6).alias("score"), "is_secret")


@query
def op6_ngram_join(spark, sf):
    return jaccard_join.components(table(spark, sf, "documents"), percent=90, words=3)


@query
def op7_language(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query
def op8_byte_bpe(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query
def op9_token_files(spark, sf):
    return token_files.write_and_read(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


@query
def op10_decontaminate(spark, sf):
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op11_merkle_manifest(spark, sf):
    """Every fifth document (by crc32 of its id) is checked with its text's A-Z lower-cased."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(table(spark, sf, "documents"), {"text": F.when(chosen, lower)})


@query
def op12_html_crf(spark, sf):
    pages = table(spark, sf, "pages")
    return html_crf.extract(pages, html_crf.learn(pages))


@query
def op13_align(spark, sf):
    return align.score(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"))


ORACLES["op11_merkle_manifest"] = merkle.oracle()
ORACLES["op3_link_propagation"] = url_filter.oracle(URL_RULES)


def load() -> tuple[dict[str, Query], dict[str, str]]:
    return dict(QUERIES), dict(ORACLES)
