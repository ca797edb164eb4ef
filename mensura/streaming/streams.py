"""Structured Streaming forms of the data flows.

Streams reuse the batch operators. Results go to Parquet in the shared folder, never
to driver memory; every query has a checkpoint, so it survives lost executors.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import enroll, scoring
from ..params import Params
from ..session import scratch_path


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table folder (or single file) as a stream with the fixed event schema."""
    reader = spark.readStream.schema(schemas.EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 each: Callable[[DataFrame, int, str], None] | None = None) -> DataFrame:
    """Drain what is available into a Parquet table and read that back.

    ``each(batch, id, path)`` replaces the plain append, for work per batch.
    """
    return run_counted(stream, name, mode, each)[0]


def run_counted(stream: DataFrame, name: str, mode: str = "append",
                each: Callable[[DataFrame, int, str], None] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``run_to_table`` and what the run reports of its state: rows dropped as late, state rows left, most at once."""
    spark = stream.sparkSession
    path, check = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True)
    if each is None:
        w = w.format("parquet").option("path", path)
    else:
        w = w.foreachBatch(lambda batch, i: each(batch, i, path))
    q = w.start()
    q.awaitTermination()
    state = [o for p in q.recentProgress for o in p["stateOperators"]]
    counts = {"late": sum(o["numRowsDroppedByWatermark"] for o in state),
              "state_rows": state[-1]["numRowsTotal"] if state else 0, "most_state_rows": max((o["numRowsTotal"] for o in state), default=0)}
    return spark.read.parquet(path), counts


def ledger(batch: DataFrame, batch_id: int, path: str) -> None:
    """The rows of a batch in a folder of its own, replaced if the batch is run again."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_snapshot(table: DataFrame) -> DataFrame:
    """The newest complete-mode result of a ledger."""
    newest = table.agg(F.max("batch_id").alias("batch_id"))
    return table.join(F.broadcast(newest), "batch_id").drop("batch_id")


def stream_identify(measured: DataFrame, articles: DataFrame, stats: DataFrame, params: Params) -> DataFrame:
    """Score each micro-batch of measurements against the current catalogue; a batch that is run again replaces itself."""
    lengths = scoring.vector_lengths(stats)

    def each(batch: DataFrame, i: int, path: str) -> None:
        ledger(scoring.identify(batch, articles, stats, params, nested=False, lengths=lengths).drop("ranking"), i, path)

    return run_to_table(measured, "identified", each=each).drop("batch_id")


def enroll_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """What a batch of shots adds to the statistics: moment rows per article and the Hu vectors, as a ledger entry."""
    ledger(enroll.moments(batch), batch_id, f"{path}/moments")
    ledger(batch.select(enroll.ARTICLE, "hu_moments"), batch_id, f"{path}/hu")


def enrolled(spark: SparkSession, path: str) -> DataFrame:
    """Statistics (long form) of all shots that the ledger under ``path`` holds.

    Moment rows of all batches are merged; a batch costs what it holds, never a pass over earlier shots.
    The distance of Hu vectors has no moments (it is a sum of absolute values), so those, seven numbers a shot, are kept.
    """
    return enroll.merged(spark.read.parquet(f"{path}/moments"), spark.read.parquet(f"{path}/hu"))


def stream_enroll(shots: DataFrame, path: str) -> DataFrame:
    """Take batches of shots into the ledger under ``path``; returns the statistics of all of them."""
    spark = shots.sparkSession
    q = (shots.writeStream.option("checkpointLocation", scratch_path(spark, "enrolled-state")).trigger(availableNow=True)
         .foreachBatch(lambda batch, i: enroll_batch(batch, i, path)).start())
    q.awaitTermination()
    return enrolled(spark, path)


def stream_journal_latest(journal: DataFrame) -> DataFrame:
    """Latest line per (session, slot): one state row per slot, the line of the highest number."""
    keyed = journal.groupBy("session", "slot").agg(F.max("line_no").alias("line_no"), F.max_by("d_mm", "line_no").alias("d_mm"))
    table = run_to_table(keyed, "journal", mode="update", each=ledger)
    # one row per slot and batch it changed in: the highest line is the newest
    return table.groupBy("session", "slot").agg(F.max("line_no").alias("line_no"),
                                                F.max_by("d_mm", "line_no").alias("d_mm"))


def dedup(captures: DataFrame, sha: str, ts: str, watermark: str = "30 days") -> DataFrame:
    """Drop repeated captures by content hash within the watermark."""
    return captures.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([sha])


def decision_rates(reports: DataFrame, ts: str, decision: str, window: str = "1 day",
                   slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Counts per decision in tumbling (or sliding) windows.

    In append mode a window is put out once, when the watermark has passed its end, and its state goes; rows for a window that is
    out already are dropped (``run_counted`` tells how many). Complete mode keeps all windows, and all their state.
    """
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return reports.withWatermark(ts, watermark).groupBy(w.alias("w"), F.col(decision).alias("decision")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "decision", "n")


def enroll_sessions(shots: DataFrame, key: str, ts: str, gap: str = "6 hours", target: int = 8,
                    watermark: str = "1 hour") -> DataFrame:
    """Shots grouped into sessions per article by inactivity, with count and age. Modes as in ``decision_rates``."""
    w = F.session_window(ts, gap)
    return shots.withWatermark(ts, watermark).groupBy(F.col(key), w.alias("w")).agg(
        F.count(F.lit(1)).alias("n_shots"), F.max(ts).alias("last_ts")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_shots", "last_ts",
        (F.col("n_shots") >= target).alias("complete"))
