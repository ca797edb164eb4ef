"""Corpus, runs, baselines and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import judge
from ..operators import analysis as A
from ..operators import regression as X

_EXPECTED = T.StructType([
    T.StructField("decision", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())),
    T.StructField("gate_passed", T.BooleanType()), T.StructField("llr_margin", T.DoubleType()),
    T.StructField("max_z_winner", T.DoubleType())])
_DELTA = T.StructType([
    T.StructField("session", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("kategorie", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("expected", _EXPECTED)])
_DELTA_FILE = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("fix_commit", T.StringType()),
    T.StructField("images", T.MapType(T.StringType(), _DELTA))])


def content_hash_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, sha, length: SHA-256 of the whole content of every file."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(folder))
    return files.select("path", F.sha2("content", 256).alias("sha"), "length")


def manifest_rows(reports: DataFrame, hashes: DataFrame) -> DataFrame:
    """sha, session, article, label, verdict, tier, image_rel, report_rel of the corpus."""
    rated = judge.present(F.col("label")) & judge.present(F.col("verdict"))
    article = F.when(rated, F.col("label")).otherwise("_unbewertet")
    j = reports.join(hashes.select("image_path", "sha"), "image_path")
    sha8 = F.substring("sha", 1, 8)
    return j.select(
        "sha", "session", article.alias("article"), "label", "verdict",
        F.when(F.col("tier2_ready") & rated, 2).otherwise(1).alias("tier"),
        F.concat("session", F.lit("/images/"), article, F.lit("/"), sha8, F.lit(".png")).alias("image_rel"),
        F.concat("session", F.lit("/reports/"), sha8, F.lit(".json")).alias("report_rel"))


def parse_deltas(texts: DataFrame) -> DataFrame:
    """Accepted deltas from (file_name, value) JSON texts; the later file name wins."""
    f = texts.select("file_name", F.from_json("value", _DELTA_FILE).alias("d"))
    rows = f.select("file_name", F.col("d.fix_commit").alias("fix_commit"),
                    F.explode("d.images").alias("sha8", "entry"))
    best = rows.groupBy("sha8").agg(F.max_by(F.struct("entry", "file_name", "fix_commit"), F.col("file_name")).alias("b"))
    e = F.col("b.entry")
    return best.select(
        "sha8", e["kategorie"].alias("kategorie"), e["label"].alias("label"), F.col("b.file_name").alias("source"),
        F.col("b.fix_commit").alias("fix_commit"), F.struct(
            e["expected"]["decision"].alias("decision"), e["expected"]["candidates"].alias("articles"),
            e["expected"]["gate_passed"].alias("gate_passed"), e["expected"]["llr_margin"].alias("llr_margin"),
            e["expected"]["max_z_winner"].alias("max_z_winner")).alias("expected"))


def load_accepted_deltas(spark: SparkSession, folder: str, bundled: bool = False) -> DataFrame:
    """Accepted deltas of all JSON files of a folder; of an image in several, the later file name wins.

    ``bundled``: a folder written in pieces, ``source=<file name>``, with one JSON document a line.
    """
    if bundled:
        raw = spark.read.text(folder)
        return parse_deltas(raw.select(F.col("source").alias("file_name"), "value"))
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    return parse_deltas(raw.select(F.col("_metadata.file_name").alias("file_name"), "value"))


def run_side(replays: DataFrame, failures: DataFrame, metrics: DataFrame, run_id: str) -> DataFrame:
    """Replayed images of a run with their band; a run without metrics is an error.

    An image in the failures has their band, any other replayed image is a pass.
    """
    done = metrics.where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("_m"))
    f = failures.where(F.col("run_id") == run_id).select("sha8", F.coalesce("band", F.lit(C.FAIL)).alias("band"))
    r = replays.where(F.col("run_id") == run_id).join(f, "sha8", "left").join(F.broadcast(done))     # one row
    band = F.when(F.col("_m") == 0, F.raise_error(F.lit(f"run {run_id} is incomplete: no metrics")).cast("string")
                  ).otherwise(F.coalesce("band", F.lit(C.PASS)))
    return r.withColumn("band", band).drop("_m")


def golden_side(manifest: DataFrame, reports: DataFrame, key: str = "sha8") -> DataFrame:
    """Goldens only through the manifest and only from tier 2 on."""
    return reports.join(manifest.where("tier >= 2").select(key), key)


def complete_runs(runs: DataFrame) -> DataFrame:
    """Runs with metrics whose name does not start with '_'."""
    return runs.where(F.col("metrics_time").isNotNull() & ~F.col("run_id").startswith("_"))


def latest_run(runs: DataFrame, by_tier: bool = False) -> DataFrame:
    best = F.max_by("run_id", F.struct("metrics_time", "run_id")).alias("run_id")
    ok = complete_runs(runs)
    return ok.groupBy("tier").agg(best) if by_tier else ok.agg(best)


def run_counts(runs: DataFrame) -> DataFrame:
    ok = F.col("metrics_time").isNotNull() & ~F.col("run_id").startswith("_")
    return runs.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def baseline_row(quotas: DataFrame, run_id: str, tier: int, n: int) -> DataFrame:
    """The versioned baseline record; refused without a tier-2 run and its rates."""
    if tier != 2:
        raise ValueError("only a tier-2 run can become the baseline")
    rows = F.sort_array(F.collect_list(F.struct("metric", "k", "n", "p", "wilson_lo", "wilson_hi")))   # few metrics
    out = quotas.agg(rows.alias("quotas")).withColumns({
        "run_id": F.lit(run_id), "tier": F.lit(tier), "n": F.lit(n), "quota_semantics": F.lit(C.QUOTA_SEMANTICS)})
    return out.withColumn("quotas", F.when(F.size("quotas") == 0, F.raise_error(F.lit(
        "a baseline needs rates")).cast(out.schema["quotas"].dataType)).otherwise(F.col("quotas")))


def write_baseline(baseline: DataFrame, path: str, version: str) -> None:
    baseline.write.mode("errorifexists").parquet(f"{path}/version={version}")


HISTORY = ("accuracy_top1", "accuracy_top3", "auto_accept_rate", "false_accept_rate")


def baseline_history(versions: DataFrame) -> DataFrame:
    """Long history: version, date, metric, k, n, p and the change to the version before.

    The number of versions of one metric is the length of a changelog.
    """
    from pyspark.sql import Window
    long = versions.select("version", "date", F.inline("quotas")).where(F.col("metric").isin(*HISTORY))
    w = Window.partitionBy("metric").orderBy("date", "version")
    return long.withColumn("change", F.round(F.col("p") - F.lag("p").over(w), 4))


def build_corpus(reports: DataFrame, stats: DataFrame, hashes: DataFrame, manifest: DataFrame,
                 sessions: DataFrame, circle_px) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new manifest, session metadata, counts): ingest sessions into the corpus.

    Per session the stats snapshot is verified against the stored candidates (tier 2
    only at ratio 1), the scale is the upper median; images are new by content hash.
    ``hashes`` has image_path, sha (missing: no image).
    """
    ratio = X.db_match_ratio(reports, stats, "session").select("session", F.round("ratio", 4).alias("db_verified"))
    scale = A.recover_scale(reports, circle_px).select("session", "mm_per_px")
    meta = reports.select("session").distinct().join(ratio, "session", "left").join(scale, "session", "left").select(
        "session", F.coalesce("db_verified", F.lit(0.0)).alias("db_verified"), "mm_per_px").withColumn(
        "tier", F.when(F.col("db_verified") >= 1.0, 2).otherwise(1))
    flagged = reports.join(meta.select("session", (F.col("tier") == 2).alias("tier2_ready")), "session")
    rows = manifest_rows(flagged, hashes)
    order = F.struct("session", "report_rel", "label")
    fresh = X.new_by_content(rows.withColumn("_o", order), manifest, "sha", "_o").drop("_o").dropDuplicates(["sha"])
    no_image = reports.join(hashes.select("image_path"), "image_path", "left_anti").agg(F.count(F.lit(1)).alias("without_image"))
    n_new, n_rows = fresh.agg(F.count(F.lit(1)).alias("new")), rows.agg(F.count(F.lit(1)).alias("_rows"))
    counts = n_new.join(F.broadcast(n_rows)).join(F.broadcast(no_image)).select(       # single rows
        "new", (F.col("_rows") - F.col("new")).alias("duplicate"), "without_image")
    merged = X.merged_sessions(sessions, meta)
    return manifest.unionByName(fresh.select(manifest.columns)), merged, counts


# --- enrollment journals ----------------------------------------------------

def latest_per_slot(journal: DataFrame) -> DataFrame:
    """session, slot, line_no, ... of the last readable line per slot.

    ``journal`` has session, line_no, and ``entry`` (NULL where the line is no JSON).
    A broken last line is an interrupted write; a broken line before it is an error.
    """
    last = journal.groupBy("session").agg(F.max("line_no").alias("_last"))
    j = journal.join(last, "session")
    bad = F.col("entry").isNull() & (F.col("line_no") < F.col("_last"))
    entry = F.when(bad, F.raise_error(F.concat(F.lit("unreadable journal line "), F.col("line_no").cast("string"),
                                               F.lit(" of session "), F.col("session").cast("string"))
                                      ).cast(journal.schema["entry"].dataType)).otherwise(F.col("entry"))
    ok = j.withColumn("entry", entry).where("entry is not null")
    return ok.groupBy("session", F.col("entry.slot").alias("slot")).agg(
        F.max("line_no").alias("line_no"), F.max_by("entry", "line_no").alias("entry"))


def gap_check(slots: DataFrame) -> DataFrame:
    """session, n, complete: slots must be exactly 0..n-1."""
    return slots.groupBy("session").agg(F.count_distinct("slot").alias("n"), (
        (F.min("slot") == 0) & (F.max("slot") == F.count_distinct("slot") - 1)).alias("complete"))


FINGERPRINT = ("calibration_sha256", "background_sha256", "features_cfg_sha256")


def open_sessions(slots: DataFrame, heads: DataFrame, now, *, states: DataFrame | None = None,
                  fingerprint: dict[str, str] | None = None, article: str | None = None) -> DataFrame:
    """Open sessions, newest (``ts``) first, with shot count, age in seconds and whether they can go on.

    ``heads`` has session, article_number, ts, target, last_ts, and with ``fingerprint`` (the present hashes) the columns of
    FINGERPRINT: fingerprint_ok is true where all are equal, and false without a present fingerprint. ``states``
    is ``session_state``; a session of no shots is open. ``article`` keeps the sessions of one article.
    """
    n = slots.groupBy("session").agg(F.count_distinct("slot").alias("n_shots"))
    age = F.greatest(F.lit(0.0), now.cast("timestamp").cast("double") - F.col("last_ts").cast("timestamp").cast("double"))
    same = F.lit(bool(fingerprint))
    for key in FINGERPRINT if fingerprint else ():
        same = same & F.col(key).eqNullSafe(F.lit(fingerprint.get(key)))
    j = (heads if article is None else heads.where(F.col("article_number") == article)).join(n, "session", "left")
    state = F.lit("offen")
    if states is not None:
        j = j.join(states.select("session", F.col("state").alias("_state")), "session", "left")
        state = F.coalesce("_state", state)
    return j.select("session", "article_number", "ts", "target", F.coalesce("n_shots", F.lit(0)).alias("n_shots"), age.alias("age_s"),
                    state.alias("state"), same.alias("fingerprint_ok")).orderBy(F.desc("ts"))


def resolve_session(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """request, session, status: exactly one open session per request.

    ``requests`` has request, article_number, ts (may be NULL).
    """
    s = sessions.select("article_number", "session", F.col("ts").alias("_ts"))
    j = requests.join(s, "article_number", "left")
    hit = F.col("session").isNotNull() & (F.col("ts").isNull() | (F.col("ts") == F.col("_ts")))
    g = j.groupBy("request").agg(F.count("session").alias("_open"), F.count_if(hit).alias("_hits"),
                                 F.max(F.when(hit, F.col("session"))).alias("_s"))
    status = (F.when(F.col("_open") == 0, "keine offene Session").when(F.col("_hits") == 0, "ts passt nicht")
              .when(F.col("_hits") > 1, "mehrdeutig").otherwise("ok"))
    return g.select("request", F.when(status == "ok", F.col("_s")).alias("session"), status.alias("status"))


def session_state(targets: DataFrame, files: DataFrame, booked: DataFrame) -> DataFrame:
    """session, state: derived from which files are where and what is booked.

    ``targets`` has session, source, target; ``files`` path; ``booked`` image_path.
    """
    f = files.select("path").distinct().withColumn("_there", F.lit(True))
    b = booked.select(F.col("image_path").alias("target")).distinct().withColumn("_booked", F.lit(True))
    j = (targets.join(f.select(F.col("path").alias("source"), F.col("_there").alias("_src")), "source", "left")
         .join(f.select(F.col("path").alias("target"), F.col("_there").alias("_dst")), "target", "left")
         .join(b, "target", "left"))
    g = j.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count("_src").alias("src"),
                                 F.count("_dst").alias("dst"), F.count("_booked").alias("bk"))
    state = (F.when(F.col("dst") == 0, "offen").when(
        (F.col("src") == 0) & (F.col("dst") == F.col("n")) & (F.col("bk") == F.col("n")), "gebucht_aufraeumen_offen")
        .otherwise("umzug_unterbrochen"))
    return g.select("session", state.alias("state"))


def booking_state(targets: DataFrame, booked: DataFrame) -> DataFrame:
    """session, state: none booked, all booked, or a violated invariant between."""
    b = booked.select(F.col("image_path").alias("target")).distinct().withColumn("_b", F.lit(True))
    g = targets.join(b, "target", "left").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count("_b").alias("k"))
    return g.select("session", "n", "k", F.when(F.col("k") == 0, "leer").when(
        F.col("k") == F.col("n"), "vollstaendig").otherwise("invariante_verletzt").alias("state"))
