"""Article master data and references.

Tables are plain DataFrames; each operation returns the new state of the tables it
touches, to be written as the next version by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from ..operators import enroll

KEY = "article_number"


def csv_master_import(spark: SparkSession, path: str) -> DataFrame:
    """Article CSV as typed rows with the file order in ``_line``.

    All columns are read as text; '' becomes NULL, the number columns accept a
    decimal comma, a UTF-8 byte order mark before the header is dropped.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
           .option("escape", '"').csv(path))
    names = [c.lstrip("﻿").strip('"') for c in raw.columns]
    raw = raw.toDF(*names)
    missing = {KEY, "name"} - set(names)
    if missing:
        raise ValueError(f"CSV missing required columns: {sorted(missing)}. "
                         f"Expected columns: {list(C.ARTICLE_COLUMNS)}")

    def column(c: str) -> Column:
        if c not in names:
            return F.lit(None).cast("string").alias(c)
        value = F.nullif(F.col(c), F.lit(""))
        if c in C.GEOMETRY_COLUMNS:
            value = F.replace(value, F.lit(","), F.lit(".")).cast("double")
        return value.alias(c)

    return raw.select(*[column(c) for c in C.ARTICLE_COLUMNS],
                      F.monotonically_increasing_id().alias("_line"))


def last_per_key(source: DataFrame, key: str = KEY, order: str = "_line") -> DataFrame:
    """Duplicate keys inside one file: the last row wins (aggregate, no window)."""
    others = [c for c in source.columns if c not in (key, order)]
    best = source.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return best.select(key, "_r.*")


def upsert(target: DataFrame, source: DataFrame, key: str = KEY,
           order: str = "_line") -> DataFrame:
    """Existing key: every other column overwritten, NULL included; new key: insert."""
    src = last_per_key(source, key, order) if order in source.columns else source
    return target.join(src.select(key), key, "left_anti").unionByName(src.select(target.columns))


def insert_new(target: DataFrame, source: DataFrame, key: str = KEY) -> DataFrame:
    """Insert only; meeting an existing key is an error when the result is read."""
    taken = source.join(target.select(key).withColumn("_taken", F.lit(True)), key, "left")
    guard = F.when(F.col("_taken"), F.raise_error(F.concat(
        F.lit("key already exists: "), F.col(key))).cast("string")).otherwise(F.col(key))
    fresh = taken.withColumn(key, guard).drop("_taken")
    return target.unionByName(fresh.select(target.columns))


def update_columns(target: DataFrame, changes: DataFrame, key: str = KEY) -> DataFrame:
    """Partial update of geometry columns; a NULL change leaves the value. Adds _hit."""
    cols = [c for c in changes.columns if c != key]
    unknown = sorted(set(cols) - set(C.GEOMETRY_COLUMNS))
    if unknown:
        raise ValueError(f"columns cannot be updated: {unknown}. "
                         f"Allowed: {sorted(C.GEOMETRY_COLUMNS)}")
    ch = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = target.join(ch, key, "left")
    updated = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in cols}
    return j.withColumns(updated).select(*target.columns, F.coalesce("_hit", F.lit(False)).alias("_hit"))


def cascade_delete(keys: DataFrame, articles: DataFrame, references: DataFrame,
                   stats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New articles, references and stats without ``keys``, and which keys existed."""
    k = keys.select(KEY).distinct()
    found = k.join(articles.select(KEY).withColumn("existed", F.lit(True)), KEY, "left").select(
        KEY, F.coalesce("existed", F.lit(False)).alias("existed"))
    return (articles.join(k, KEY, "left_anti"), references.join(k, KEY, "left_anti"),
            stats.join(k, KEY, "left_anti"), found)


def drop_references(keys: DataFrame, references: DataFrame, stats: DataFrame
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References and stats without ``keys`` and the number of rows each key lost."""
    k = keys.select(KEY).distinct()
    removed = references.join(k, KEY, "left_semi").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("removed"))
    counts = k.join(removed, KEY, "left").select(KEY, F.coalesce("removed", F.lit(0)).alias("removed"))
    return references.join(k, KEY, "left_anti"), stats.join(k, KEY, "left_anti"), counts


def append_references(references: DataFrame, stats: DataFrame, batch: DataFrame,
                      articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append shots as one unit and recompute only the touched articles.

    An unknown article raises when the result is read; an empty batch changes
    nothing. The result does not depend on the order of the rows.
    """
    known = articles.select(KEY).withColumn("_known", F.lit(True))
    guard = F.when(F.col("_known").isNull(), F.raise_error(F.concat(
        F.lit("unknown article_number: "), F.col(KEY))).cast("string")).otherwise(F.col(KEY))
    checked = batch.join(known, KEY, "left").withColumn(KEY, guard).select(references.columns)
    combined = references.unionByName(checked)
    touched = batch.select(KEY).distinct()
    fresh = enroll.stats_long(combined.join(touched, KEY, "left_semi"))
    return combined, stats.join(touched, KEY, "left_anti").unionByName(fresh.select(stats.columns))


def unique_article_numbers(requests: DataFrame, taken: DataFrame, order: str,
                           prefix: str = "", name: str = "name") -> DataFrame:
    """Slug numbers for a batch: the n-th request of a slug gets its n-th free number.

    Numbers run slug, slug-2, slug-3 ... and skip those in ``taken``. The rank inside
    a slug is a distributed position, so a very common slug is no bottleneck.
    """
    from ..operators.ranks import global_position
    base = requests.withColumn("_base", F.concat(F.lit(prefix), text.slug(F.col(name))))
    ranked = global_position(base, ["_base"], [F.col(order)], "_nth")
    # Taken numbers of a slug: "base" is number 1, "base-n" is number n (n >= 2).
    t = taken.select(F.col(KEY).alias("_t")).distinct()
    stem = F.regexp_extract("_t", r"^(.*)-([0-9]+)$", 1)
    num = F.regexp_extract("_t", r"^(.*)-([0-9]+)$", 2)
    canonical = F.regexp_like(num, F.lit(r"^([2-9]|[1-9][0-9]+)$"))
    used = t.select(F.col("_t").alias("_base"), F.lit(1).cast("long").alias("_i")).unionByName(
        t.where(canonical).select(stem.alias("_base"), num.try_cast("long").alias("_i")))
    used = used.where("_i is not null")
    # free number of rank n = n + how many taken numbers lie at or below it; with the
    # taken ones sorted, taken number t at 0-based rank r pushes all n >= t - r.
    used = global_position(used.join(base.select("_base").distinct(), "_base", "left_semi"),
                           ["_base"], [F.col("_i")], "_r")
    # Sorting both together, a request stands behind the shifts that apply to it.
    shifts = used.select("_base", (F.col("_i") - F.col("_r")).alias("_n"), F.lit(0).alias("_side"),
                         F.lit(None).cast("long").alias("_nth"))
    want = ranked.select("_base", (F.col("_nth") + 1).alias("_n"), F.lit(1).alias("_side"), "_nth")
    merged = global_position(shifts.unionByName(want), ["_base"], [F.col("_n"), F.col("_side")], "_pos")
    shift = merged.where("_side = 1").select("_base", "_nth", (F.col("_pos") - F.col("_nth")).alias("_shift"))
    i = F.col("_nth") + 1 + F.col("_shift")
    number = F.when(i == 1, F.col("_base")).otherwise(
        F.concat(F.col("_base"), F.lit("-"), i.cast("string")))
    return ranked.join(shift, ["_base", "_nth"]).withColumn(KEY, number).drop(
        "_base", "_nth", "_shift")


def references_in_order(references: DataFrame, article: str) -> DataFrame:
    return references.where(F.col(KEY) == article).orderBy("created", "image_path")


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write the next state of a table beside the old one; never over it."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
