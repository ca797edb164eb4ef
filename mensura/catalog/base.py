"""Registry of queries: a Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .views import duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(v, spark, sf_dir)`` where ``v(text)`` reads a view or query."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(lambda text: view(spark, sf_dir, text), spark, sf_dir)

        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn
    return wrap
