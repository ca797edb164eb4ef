"""Global positions over data too large for one ordered window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .order_stats import _null_safe_join


def global_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    out: str = "position") -> DataFrame:
    """0-based position of each row inside its group, in a total order.

    Rows are range-partitioned by (keys, order), so a hot group spreads over many
    tasks. The position inside a partition comes from the row counter; what other
    partitions hold before it comes from a small per-partition count. The sorted
    rows are checkpointed first so that both reads see the same partitions.
    """
    keys = list(keys)
    by = [F.col(k) for k in keys] + list(order)
    ordered = (df.repartitionByRange(*by).sortWithinPartitions(*by)
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    part = F.shiftright("_mid", 33)
    local = ordered.withColumn("_part", part).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    gk = ["_all", *keys]
    per_part = local.withColumn("_all", F.lit(1)).groupBy(*gk, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    # One row per (group, partition): bounded by groups + partitions.
    w = Window.partitionBy(*gk).orderBy("_part")
    offsets = per_part.select(
        *keys, "_part", "_first", (F.sum("_rows").over(w) - F.col("_rows")).alias("_before"))
    joined = _null_safe_join(local, offsets, [*keys, "_part"])
    return joined.withColumn(out, F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_mid", "_part", "_row", "_first", "_before")


def k_safe(df: DataFrame, keys: Sequence[str], *, margin: str, correct: str, decision: str,
           order: str, include_rejects: bool = False) -> DataFrame:
    """Per group: cases by margin descending accepted before the first wrong one.

    Two aggregates instead of an ordered window: find the first wrong key, then
    count the rows ahead of it. ``order`` is the input order that breaks ties.
    """
    base = df if include_rejects else df.where(F.col(decision) != "reject")
    base = base.withColumn("_key", F.struct(
        (-F.coalesce(F.col(margin), F.lit(float("inf")))).alias("m"), F.col(order).alias("o")))
    ok = F.coalesce(F.col(correct), F.lit(False))
    first_wrong = base.groupBy(*keys).agg(F.min(F.when(~ok, F.col("_key"))).alias("_stop"))
    ahead = _null_safe_join(base, first_wrong, list(keys)) if keys else base.join(
        F.broadcast(first_wrong))           # a single row
    return ahead.groupBy(*keys).agg(
        F.count_if(F.col("_stop").isNull() | (F.col("_key") < F.col("_stop"))).alias("k_safe"),
        F.count(F.lit(1)).alias("n_cases"))
