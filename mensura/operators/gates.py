"""Gates and integrity checks; each result is a findings table (P35, A55, A53, A54, Q)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import judge
from .analysis import _count_if

HASH_BUCKETS = 256


def config_fingerprint(blocks: dict[str, dict], parts: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON of the named blocks, keys in sorted order."""
    def struct(d: dict) -> Column:
        return F.struct(*[(struct(v) if isinstance(v, dict) else v).alias(k)
                          for k, v in sorted(d.items())])

    return F.sha2(F.to_json(struct({k: blocks[k] for k in parts})), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash of all rows over the effective columns, whatever their order or split.

    Row hashes are combined per bucket by a wrapping sum (order-free, with map-side
    combine); only the fixed number of bucket sums meet in one place.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    h = df.select(row.alias("_h")).select(
        F.conv(F.substring("_h", 1, 2), 16, 10).cast("int").alias("_b"),
        *[F.conv(F.substring("_h", 3 + 12 * i, 12), 16, 10).cast("decimal(38,0)").alias(f"_s{i}")
          for i in range(4)])
    sums = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"),
                               *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(4)])
    text = F.concat_ws(":", F.col("_b").cast("string"), F.col("_n").cast("string"),
                       *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return sums.groupBy().agg(
        F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(text))), 256).alias("fingerprint"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))


def combined_fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


# --- baseline gate ----------------------------------------------------------

def check_against_baseline(results: DataFrame, quotas: DataFrame, baseline: DataFrame, *,
                           accept_drift: bool, semantics: str | None = C.QUOTA_SEMANTICS) -> DataFrame:
    """finding, subject, code: what a run breaks against the stored baseline.

    ``quotas`` has metric, p; ``baseline`` metric, p, wilson_lo, wilson_hi. A missing
    bound is an error, info metrics are skipped, another semantics is a notice.
    """
    spark = results.sparkSession
    bands = results.agg(_count_if(F.col("band") == C.FAIL).alias("f"),
                        _count_if(F.col("band") == C.DRIFT).alias("d"))
    images = bands.select(F.inline(F.array(
        F.struct(F.lit("FAIL").alias("finding"), F.col("f").cast("string").alias("subject"),
                 F.when(F.col("f") > 0, 1).otherwise(-1).alias("code")),
        F.struct(F.lit("DRIFT tolerated" if accept_drift else "DRIFT").alias("finding"),
                 F.col("d").cast("string").alias("subject"),
                 F.when(F.col("d") == 0, -1).otherwise(0 if accept_drift else 1).alias("code"))))
    ).where("code >= 0")
    b = baseline.select("metric", F.lit(True).alias("_known"), "wilson_lo", "wilson_hi")
    rate = F.col("metric").isin(*C.ERROR_RATES)
    bound = F.when(rate, F.col("wilson_hi")).otherwise(F.col("wilson_lo"))
    q = quotas.select("metric", "p").where(
        ~F.col("metric").isin(*C.INFO_ONLY) & F.col("p").isNotNull()).join(b, "metric")
    finding = (F.when(bound.isNull(), "bound missing")
               .when(rate & (F.col("p") > bound), "error rate above baseline")
               .when(~rate & (F.col("p") < bound), "below baseline"))
    found = q.select(finding.alias("finding"), F.col("metric").alias("subject"),
                     F.lit(1).alias("code")).where("finding is not null")
    out = images.unionByName(found)
    if semantics != C.QUOTA_SEMANTICS:
        note = spark.createDataFrame([("semantics differ", semantics or "<keine>", 0)],
                                     "finding string, subject string, code int")
        out = out.unionByName(note)
    return out


def exit_code(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.max("code"), F.lit(0)).alias("code"))


def completeness_gate(run: DataFrame) -> DataFrame:
    """run_id, findings: filtered run, fewer rows than the baseline, incomplete rates.

    ``run`` has run_id, filtered, n, baseline_n, n_replays.
    """
    f = F.array_compact(F.array(
        F.when(F.col("filtered"), "filtered run is no release"),
        F.when(~F.col("filtered") & (F.col("n") < F.col("baseline_n")), "fewer images than the baseline"),
        F.when(F.col("n_replays") < F.col("n"), "rates do not cover the run")))
    return run.select("run_id", f.alias("findings"), F.when(F.size(f) > 0, 1).otherwise(0).alias("code"))


# --- state and snapshots ----------------------------------------------------

STATE_PARTS = ("calibration_sha256", "background_sha256", "db_zustand_sha256",
               "features_cfg_sha256", "matching_cfg_sha256")


def state_drift(a: DataFrame, b: DataFrame, key: str, parts: Sequence[str] = STATE_PARTS) -> DataFrame:
    """key, parts whose hashes differ between two states."""
    r = b.select(key, *[F.col(p).alias(f"_b_{p}") for p in parts])
    diff = F.array_compact(F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"_b_{p}")), p) for p in parts]))
    return a.join(r, key).select(key, diff.alias("parts"))


def snapshot_integrity(stored: DataFrame, actual: DataFrame, key: str,
                       parts: Sequence[str] = STATE_PARTS) -> DataFrame:
    """key, findings: parts that deviate, missing parts, and a broken total fingerprint."""
    r = actual.select(key, *[F.col(p).alias(f"_b_{p}") for p in parts])
    total = combined_fingerprint(*[F.coalesce(F.col(p), F.lit("")) for p in parts])
    j = stored.join(r, key, "left")
    gone = [F.col(f"_b_{p}").isNull() for p in parts]
    any_gone = gone[0]
    for g in gone[1:]:
        any_gone = any_gone | g
    missing = F.array_compact(F.array(*[F.when(g, F.lit(f"{p} missing")) for g, p in zip(gone, parts)]))
    deviating = F.array_compact(F.array(
        F.when(total != F.col("fingerprint"), "fingerprint does not match its parts"),
        *[F.when(~F.col(p).eqNullSafe(F.col(f"_b_{p}")), f"{p} deviates") for p in parts]))
    return j.select(key, F.when(any_gone, missing).otherwise(deviating).alias("findings"))


def bundle_consistency(sessions: DataFrame, snapshots: DataFrame, key: str = "session") -> DataFrame:
    """Sessions that claim a stats snapshot but have none."""
    return sessions.where("has_db").join(snapshots.select(key), key, "left_anti").select(key)


def environment_comparable(snapshots: DataFrame, now: dict[str, str],
                           keys: Sequence[str] = ("system", "opencv", "numpy")) -> DataFrame:
    diff = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(now[k])), k) for k in keys]))
    return snapshots.select("snapshot", diff.alias("differs"), (F.size(diff) == 0).alias("comparable"))


# --- test-set building and replay -------------------------------------------

LADDER = ("truth", "ohne_zustand", "ohne_bild", "bild_fehlt", "kein_png",
          "zustand_nicht_mehr_vorhanden", "snapshot_defekt", "dublette", "widerspruch_label",
          "label_unbekannt_in_db", "fidelity_abweichung")


def eligibility(reports: DataFrame) -> DataFrame:
    """report_id, reason: the first failing check, NULL when the report is taken.

    The flags has_state, image_path, image_exists, state_alive, snapshot_ok,
    known_truth, label_known and reproducible are joined on beforehand.
    """
    t = judge.truth_of(F.col("verdict"), F.col("label"))
    truth, known = t["truth"], F.col("known_truth")
    reason = (F.when(truth.isNull(), t["origin"]).when(~F.col("has_state"), "ohne_zustand")
              .when(~judge.present(F.col("image_path")), "ohne_bild")
              .when(~F.col("image_exists"), "bild_fehlt")
              .when(~F.lower("image_path").endswith(".png"), "kein_png")
              .when(~F.col("state_alive"), "zustand_nicht_mehr_vorhanden")
              .when(~F.col("snapshot_ok"), "snapshot_defekt")
              .when(known == truth, "dublette").when(known.isNotNull(), "widerspruch_label")
              .when((truth != C.NO_MATCH) & ~F.col("label_known"), "label_unbekannt_in_db")
              .when(~F.col("reproducible"), "fidelity_abweichung"))
    return reports.select("report_id", truth.alias("truth"), reason.alias("reason"))


def skip_counts(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def replay_band(captures: DataFrame, fresh: DataFrame, fields: Sequence[str], key: str = "sha8",
                tol: float = 1e-3) -> DataFrame:
    """key, band, reasons per capture: error without a fresh row, else exact per field."""
    cols = ("decision", "top1", "llr_margin", *fields)
    f = fresh.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = captures.join(f, key, "left")
    a, b = F.col("llr_margin"), F.col("_n_llr_margin")
    reasons = F.array_compact(F.array(
        F.when(~F.col("decision").eqNullSafe(F.col("_n_decision")), "decision"),
        F.when(~F.col("top1").eqNullSafe(F.col("_n_top1")), "top1"),
        F.when((a.isNull() != b.isNull()) | F.coalesce(F.abs(b - a) >= tol, F.lit(False)), "llr"),
        *[F.when(~F.col(c).eqNullSafe(F.col(f"_n_{c}")), f"measured.{c}") for c in fields]))
    there = F.coalesce("_there", F.lit(False))
    band = F.when(~there, "fehler").when(F.size(reasons) > 0, "abweichung").otherwise("pass")
    empty = F.array().cast("array<string>")
    return j.select(key, F.col("label").alias("artikel"), band.alias("band"),
                    F.when(there, reasons).otherwise(empty).alias("reasons"),
                    F.col("_n_decision").alias("decision"), F.col("_n_top1").alias("top1"))


def replay_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of a replay; truth NO_MATCH is a hit when nothing was accepted."""
    rated = F.col("band") != "fehler"
    acc = F.col("decision") == C.ACCEPT
    hit = F.when(F.col("artikel") == C.NO_MATCH, ~acc | (F.col("top1") == C.NO_MATCH)).otherwise(
        F.col("top1") == F.col("artikel"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _count_if(rated).alias("gewertet"),
        _count_if(rated & hit).alias("treffer"),
        *[_count_if(rated & (F.col("decision") == d)).alias(d) for d in C.DECISIONS],
        _count_if(rated & acc & (F.col("top1") != F.col("artikel"))).alias("false_accept"),
        _count_if(F.col("band") == "abweichung").alias("abweichungen"),
        _count_if(~rated).alias("fehler"))
    return out.withColumn("trefferquote", F.round(F.try_divide("treffer", "gewertet"), 4))


def histogram_drift(golden: DataFrame, fresh: DataFrame, column: str, key: str = "sha8") -> DataFrame:
    """Largest bin delta (signed, with index), Bhattacharyya and exact equality."""
    from ..functions import distances as dist
    f = fresh.select(key, F.col(column).alias("_f"))
    j = golden.select(key, F.col(column).alias("_g")).join(f, key)
    ok = (F.size("_g") == F.size("_f")) & (F.size("_g") > 0)
    best = F.array_max(F.zip_with(F.zip_with("_f", "_g", lambda a, b: a - b),
                                  F.sequence(F.lit(0), F.greatest(F.size("_g"), F.size("_f")) - 1),
                                  lambda d, i: F.struct(F.abs(d).alias("a"), (-i).alias("n"), d.alias("d"))))
    return j.select(key, F.when(ok, best["a"]).alias("maxdelta"), F.when(ok, best["d"]).alias("signed"),
                    F.when(ok, (-best["n"]).cast("long")).alias("argmax"),
                    F.when(ok, dist.bhattacharyya_distance(F.col("_f"), F.col("_g"))).alias("bhatta"),
                    F.col("_g").eqNullSafe(F.col("_f")).alias("equal"))
