"""Report folders, verdicts and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .. import schemas
from ..functions import judge

_BAD = "_corrupt_record"


def _defaults(df: DataFrame) -> DataFrame:
    """Older reports lack newer fields: one place fills what missing stands for."""
    empty_kills = F.array().cast(T.ArrayType(schemas.KILL))
    empty_cands = F.array().cast(T.ArrayType(schemas.CANDIDATE))
    m = F.col("measured")
    zone = F.array().cast("array<double>")
    fixed = F.when(m.isNotNull(), F.struct(*[
        (F.coalesce(m[f.name], zone) if isinstance(f.dataType, T.ArrayType)
         else F.coalesce(m[f.name], F.lit(0.0)) if f.name in ("solidity", "lat_p98_mm", "mean_saturation")
         else m[f.name]).alias(f.name) for f in schemas.MEASURED.fields]))
    return df.withColumns({"candidates": F.coalesce("candidates", empty_cands),
                           "prefiltered": F.coalesce("prefiltered", empty_kills), "measured": fixed})


def load_reports(spark: SparkSession, folder: str, *, sort_by: str = "mtime",
                 limit: int | None = None, layout: str = "file") -> DataFrame:
    """Report JSON of a folder; unreadable and foreign documents are skipped.

    Newest first by write time or name, the limit applies after sorting. ``layout``: ``file`` is one report a file, whose actual path
    replaces the stored one; ``lines`` is one report a line, whose name is that of its stored path (else of its image).
    Lines are written when their file is, so ties by time go by name. A document without a decision is no report.
    """
    if sort_by not in ("mtime", "name"):
        raise ValueError(f"sort_by must be 'mtime' or 'name', not {sort_by!r}.")
    if layout not in ("file", "lines"):
        raise ValueError(f"layout must be 'file' or 'lines', not {layout!r}.")
    schema = T.StructType(schemas.REPORT.fields + [T.StructField(_BAD, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
    if layout == "file":
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*.json")
    raw = reader.json(folder)
    out = raw.select("*", F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_path").alias("_path"),
                     F.col("_metadata.file_modification_time").alias("file_time"))
    out = out.where(F.col(_BAD).isNull() & F.col("decision").isNotNull()).drop(_BAD)
    out = _defaults(out)
    if layout == "file":
        out = out.withColumn("report_path", F.col("_path"))
    else:
        own = F.regexp_extract(F.coalesce("report_path", "image_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
        out = out.withColumn("file_name", F.when(own != "", F.concat(own, F.lit(".json"))).otherwise(F.col("file_name")))
    out = out.drop("_path").withColumn("stem", F.regexp_replace("file_name", r"\.json$", ""))
    if limit is not None:
        key = "file_time" if sort_by == "mtime" else "file_name"
        out = out.orderBy(F.desc(key), F.desc("file_name")).limit(limit)
    return out


def with_date(df: DataFrame, stem: str = "stem", unit: str = "day") -> DataFrame:
    """Date partition (day or month) from the millisecond name stem; else 'other'."""
    digits = {"day": 8, "month": 6}[unit]
    day = F.substring(stem, 1, 8)
    return df.withColumn("date", F.when(F.regexp_like(day, F.lit(r"^\d{8}$")),
                                        F.substring(stem, 1, digits)).otherwise("other"))


def write_reports(df: DataFrame, path: str, fmt: str = "parquet", unit: str = "day") -> None:
    """Append reports, partitioned by the day (or month) of their name.

    The rebalance gathers the rows of a date before writing (few files per date) and
    splits a date that is too large for one task. Months suit sparse archives.
    """
    with_date(df, unit=unit).hint("rebalance", F.col("date")).write.mode("append").partitionBy("date").format(fmt).save(path)


def _latest(feedback: DataFrame, key: str) -> DataFrame:
    return feedback.groupBy(key).agg(F.max_by(F.struct("kind", "true_article"), F.col("at")).alias("_f"))


def apply_verdict(reports: DataFrame, feedback: DataFrame, key: str = "report_id") -> DataFrame:
    """Human feedback back into the reports, the latest per report counting.

    ``feedback`` has the key, kind ('correct', 'wrong', 'no_match'), true_article, at.
    Correct takes top-1 as the label, wrong the true article where one is given, and
    a rightful rejection NO_MATCH, never top-1.
    """
    j = reports.join(_latest(feedback, key), key, "left")
    kind, art = F.col("_f.kind"), F.col("_f.true_article")
    label: Column = (F.when(kind == "correct", judge.predicted_article(F.col("candidates")))
                     .when(kind == "no_match", C.NO_MATCH)
                     .when((kind == "wrong") & judge.present(art), art).otherwise(F.col("label")))
    verdict = F.when(kind.isin("correct", "no_match"), "correct").when(kind == "wrong", "wrong").otherwise(F.col("verdict"))
    return j.withColumns({"label": label, "verdict": verdict}).drop("_f")


def csv_sink(df: DataFrame, path: str, header: Sequence[str]) -> None:
    """Rows of an analysis in a fixed column order."""
    df.select(*header).write.mode("errorifexists").option("header", True).csv(path)


def metrics_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON text per row of totals."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def publish_run(frames: dict[str, DataFrame], archive: str, run_id: str) -> None:
    """Copy the aggregates of a run to the archive; an existing entry is an error."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{archive}/run_id={run_id}/{name}")


def archive_reports(reports: DataFrame, path: str, run_id: str) -> None:
    """File the analysed reports under their run."""
    reports.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def current_reports(reports: DataFrame, archived: DataFrame, key: str = "report_id") -> DataFrame:
    """What no run has archived yet: the next round starts at zero."""
    return reports.join(archived.select(key), key, "left_anti")
