"""Golden-versus-replay regression (J06, J07, J13-J17, J20, Q03, Q04, A21, A38-A43, X)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import compare as cmp
from ..functions import judge
from . import reports as R
from .analysis import _count_if, _quota_row, _top3_hit
from .order_stats import MEDIAN, UPPER_MEDIAN, lower, quantiles

KEY = "sha8"


# --- comparison sides -------------------------------------------------------

def driving_feature(feats: Column) -> Column:
    """Struct(feature, z) of the winner's largest |z|, first on ties."""
    best = F.array_max(F.transform(feats, lambda f, i: F.struct(
        F.coalesce(F.abs(f["z"]), F.lit(-1.0)).alias("a"), (-i).alias("n"),
        f["feature"].alias("feature"), f["z"].alias("z"))))
    return F.struct(F.coalesce(best["feature"], F.lit("")).alias("feature"), best["z"].alias("z"))


def side_of(reports: DataFrame, key: Column) -> DataFrame:
    """Nested reports as one flat comparison side."""
    d = driving_feature(F.get("candidates", 0)["features"])
    names = F.transform("candidates", lambda c: c["article_number"])
    return reports.select(
        key.alias(KEY), "label", "verdict", "decision",
        judge.predicted_article(F.col("candidates")).alias("top1"), names.alias("articles"),
        F.get("candidates", 0)["has_references"].alias("has_refs"),
        F.get("candidates", 0)["posterior"].alias("posterior"),
        "llr_margin", "max_z_winner", "gate_passed", d["feature"].alias("driving_feature"),
        d["z"].alias("driving_z"))


SIDE = ("label", "decision", "top1", "articles", "llr_margin", "max_z_winner", "gate_passed",
        "driving_feature", "driving_z")


def _yes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "ja").otherwise("nein")


def golden_vs_run(old: DataFrame, new: DataFrame, accepted: DataFrame | None = None,
                  bands: DataFrame | None = None) -> DataFrame:
    """Wide review row per image on both sides; the label comes from the old side first."""
    keep = [c for c in old.columns if c not in SIDE and c != KEY]
    a = old.select(KEY, *keep, *[F.col(c).alias(f"a_{c}") for c in SIDE])
    b = new.select(KEY, *[F.col(c).alias(f"b_{c}") for c in SIDE])
    j = a.join(b, KEY)
    label = F.when(judge.present(F.col("a_label")), F.col("a_label")).otherwise(
        F.coalesce("b_label", F.lit("")))
    j = j.withColumn("label", label)
    has = F.col("label") != ""
    top3 = F.slice("b_articles", 1, 3)
    change = judge.change_kind(*[{"decision": F.col(f"{s}_decision"), "top1": F.col(f"{s}_top1"),
                                  "articles": F.col(f"{s}_articles"), "margin": F.col(f"{s}_llr_margin"),
                                  "max_z": F.col(f"{s}_max_z_winner")} for s in ("a", "b")])
    out = j.select(
        KEY, *keep, change.alias("aenderung"), "label",
        F.col("a_decision").alias("decision_alt"), F.col("b_decision").alias("decision_neu"),
        F.col("a_top1").alias("top1_alt"), F.col("b_top1").alias("top1_neu"),
        _yes(has & (F.col("a_top1") == F.col("label"))).alias("top1_korrekt_alt"),
        _yes(has & (F.col("b_top1") == F.col("label"))).alias("top1_korrekt_neu"),
        F.col("a_llr_margin").alias("llr_margin_alt"), F.col("b_llr_margin").alias("llr_margin_neu"),
        F.round(F.col("b_llr_margin") - F.col("a_llr_margin"), 4).alias("llr_margin_delta"),
        F.col("a_max_z_winner").alias("max_z_alt"), F.col("b_max_z_winner").alias("max_z_neu"),
        F.round(F.col("b_max_z_winner") - F.col("a_max_z_winner"), 4).alias("max_z_delta"),
        F.col("a_driving_feature").alias("treiber_alt"), F.col("a_driving_z").alias("treiber_z_alt"),
        F.col("b_driving_feature").alias("treiber_neu"), F.col("b_driving_z").alias("treiber_z_neu"),
        F.array_join(top3, " ").alias("top3_neu"),
        _yes(has & F.array_contains(top3, F.col("label"))).alias("label_in_top3_neu"))
    if bands is not None:
        out = out.join(bands.select(KEY, "band"), KEY, "left").withColumn(
            "band", F.coalesce("band", F.lit(C.PASS)))
    if accepted is not None:
        acc = accepted.select(KEY, F.lit("akzeptiert").alias("delta_status"),
                              F.col("kategorie").alias("delta_kategorie"),
                              F.col("source").alias("delta_quelle"),
                              F.substring("fix_commit", 1, 8).alias("delta_fix_commit"))
        out = out.join(acc, KEY, "left").withColumns({
            "delta_status": F.coalesce("delta_status", F.lit("-")),
            **{c: F.coalesce(c, F.lit("")) for c in ("delta_kategorie", "delta_quelle",
                                                     "delta_fix_commit")}})
    return out


# --- tier 1 and tier 2 diffs ------------------------------------------------

def scalar_pairs(golden: DataFrame, fresh: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, golden, actual rows of the named scalars."""
    f = fresh.select(key, *[F.col(c).alias(f"_f_{c}") for c in fields])
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("golden"),
                               F.col(f"_f_{c}").alias("actual")) for c in fields])
    return golden.join(f, key).select(key, F.inline(items))


EXTRA_SCALARS = ("seg_area_px", "centroid_x", "centroid_y")


def compare_tier1(golden: DataFrame, fresh: DataFrame, key: str = KEY) -> DataFrame:
    """key, diffs, band: all fields of both sides compared in one row, worst band."""
    scal, vec = C.TIER1_SCALARS + EXTRA_SCALARS, C.TIER1_VECTORS
    f = fresh.select(key, *[F.col(c).alias(f"_f_{c}") for c in scal + vec])
    diffs = F.array_compact(F.array(
        *[cmp.scalar_diff(c, F.col(c), F.col(f"_f_{c}")) for c in scal],
        *[cmp.vector_diff(c, F.col(c), F.col(f"_f_{c}")) for c in vec]))
    out = golden.join(f, key).withColumn("diffs", diffs)
    keep = [c for c in golden.columns if c not in scal + vec]
    return out.select(*keep, "diffs", cmp.worst_band(F.col("diffs")).alias("band"))


T2 = "struct<field:string,golden:string,actual:string,delta:double,band:string>"


def tier2_diffs(g: dict[str, Column], a: dict[str, Column]) -> Column:
    """Diff rows of decision, order, gate (exact) and margin, max z (by band)."""
    nan = F.lit(float("nan"))

    def exact(field: str, x: Column, y: Column, sx: Column, sy: Column) -> Column:
        return F.when(~x.eqNullSafe(y), F.struct(
            F.lit(field).alias("field"), sx.alias("golden"), sy.alias("actual"),
            nan.alias("delta"), F.lit(C.FAIL).alias("band")).cast(T2))

    def joined(x: Column) -> Column:
        s = F.array_join(x, ",")
        return F.when(s == "", "-").otherwise(s)

    def banded(field: str) -> Column:
        d = cmp.scalar_diff(field, g[field], a[field])
        return F.when(d.isNotNull(), F.struct(
            F.lit(field).alias("field"), g[field].cast("string").alias("golden"),
            a[field].cast("string").alias("actual"), d["delta"].alias("delta"),
            d["band"].alias("band")).cast(T2))

    gp, ap = (F.coalesce(x["gate_passed"], F.lit(False)) for x in (g, a))
    return F.array_compact(F.array(
        exact("decision", g["decision"], a["decision"], g["decision"], a["decision"]),
        exact("top_k", g["articles"], a["articles"], joined(g["articles"]), joined(a["articles"])),
        exact("gate_passed", gp, ap, gp.cast("string"), ap.cast("string")),
        banded("llr_margin"), banded("max_z_winner")))


T2_COLS = ("decision", "articles", "gate_passed", "llr_margin", "max_z_winner")


def compare_tier2(golden: DataFrame, actual: DataFrame, accepted: DataFrame | None = None,
                  key: str = KEY) -> DataFrame:
    """key, diffs, band. Where the golden comparison yields any row, pass rows included,
    and the image has an accepted delta, the delta's expected fields are compared instead."""
    b = actual.select(key, *[F.col(c).alias(f"_b_{c}") for c in T2_COLS])
    j = golden.join(b, key)
    new = {c: F.col(f"_b_{c}") for c in T2_COLS}
    diffs = tier2_diffs({c: F.col(c) for c in T2_COLS}, new)
    if accepted is not None:
        e = accepted.select(key, F.lit(True).alias("_has"),
                            *[F.col(f"expected.{c}").alias(f"_e_{c}") for c in T2_COLS])
        j = j.join(e, key, "left").withColumn("_plain", diffs)
        expected = tier2_diffs({c: F.col(f"_e_{c}") for c in T2_COLS}, new)
        diffs = F.when((F.size("_plain") > 0) & F.col("_has"), expected).otherwise(F.col("_plain"))
    keep = [c for c in golden.columns if c not in T2_COLS]
    return j.withColumn("diffs", diffs).select(*keep, "diffs", cmp.worst_band(F.col("diffs")).alias("band"))


# --- rates and changes ------------------------------------------------------

def tier2_quotas(reports: DataFrame, *by: str) -> DataFrame:
    """Rates raw against the label on one base; the verdict-based top-1 is info only."""
    j = R.judged(reports)
    lab, acc = judge.present(F.col("label")), F.col("decision") == C.ACCEPT
    wrong = acc & lab & (F.size("candidates") > 0) & (F.col("pred") != F.col("label"))
    a = j.groupBy(*by).agg(
        _count_if(lab & (F.col("pred") == F.col("label"))).alias("k1"), _count_if(lab).alias("n1"),
        _count_if(lab & _top3_hit()).alias("k3"), _count_if(acc).alias("ka"),
        F.count(F.lit(1)).alias("na"), _count_if(wrong).alias("kf"),
        _count_if(F.col("ok")).alias("kv"), F.count("ok").alias("nv"))
    return a.select(*by, F.inline(F.array(*[_quota_row(m, F.col(k), F.col(n), True) for m, k, n in (
        ("accuracy_top1", "k1", "n1"), ("accuracy_top3", "k3", "n1"), ("auto_accept_rate", "ka", "na"),
        ("false_accept_rate", "kf", "ka"), ("accuracy_top1_verdict", "kv", "nv"))])))


def side_quotas(side: DataFrame, *by: str) -> DataFrame:
    """The same rates on a flat side (never an empty candidate list)."""
    lab, acc = judge.present(F.col("label")), F.col("decision") == C.ACCEPT
    a = side.groupBy(*by).agg(
        _count_if(lab & (F.col("top1") == F.col("label"))).alias("k1"), _count_if(lab).alias("n1"),
        _count_if(lab & F.array_contains(F.slice("articles", 1, 3), F.col("label"))).alias("k3"),
        _count_if(acc).alias("ka"), F.count(F.lit(1)).alias("na"),
        _count_if(acc & lab & (F.col("top1") != F.col("label"))).alias("kf"))
    return a.select(*by, F.inline(F.array(*[_quota_row(m, F.col(k), F.col(n), True) for m, k, n in (
        ("accuracy_top1", "k1", "n1"), ("accuracy_top3", "k3", "n1"),
        ("auto_accept_rate", "ka", "na"), ("false_accept_rate", "kf", "ka"))])))


def quota_consistency(stored: DataFrame, side: DataFrame, reference: DataFrame) -> DataFrame:
    """Stored rates whose (k, n) differ from the recomputed ones, plus the raw top-1
    against the labels of the reference side."""
    again = side_quotas(side).select("metric", F.col("k").alias("k_again"), F.col("n").alias("n_again"))
    differ = stored.select("metric", "k", "n").join(again, "metric").where(
        ~(F.col("k").eqNullSafe(F.col("k_again")) & F.col("n").eqNullSafe(F.col("n_again"))))
    ref = reference.select(KEY, F.col("label").alias("_ref"))
    lab = F.when(judge.present(F.col("_ref")), F.col("_ref")).otherwise(F.col("label"))
    raw = side.join(ref, KEY, "left").withColumn("_l", lab).where(judge.present(F.col("_l"))).agg(
        _count_if(F.col("top1") == F.col("_l")).alias("k"), F.count(F.lit(1)).alias("n"))
    raw = raw.select(F.lit("roh_top1_gleich_label").alias("metric"), "k", "n",
                     F.lit(None).cast("long").alias("k_again"), F.lit(None).cast("long").alias("n_again"))
    return differ.unionByName(raw)


def drift_by_field(results: DataFrame, key: str = KEY) -> DataFrame:
    """Per field over the diffs of images that are not pass: distinct images, counts,
    upper median and maximum of the absolute delta."""
    d = results.where(F.col("band") != C.PASS).select(key, F.explode("diffs").alias("d")).select(
        key, F.col("d.field").alias("feld"), F.col("d.band").alias("b"),
        F.abs(F.nanvl("d.delta", F.lit(None).cast("double"))).alias("delta"))
    n = d.groupBy("feld").agg(F.count_distinct(key).alias("bilder"),
                              _count_if(F.col("b") == C.DRIFT).alias("drift"),
                              _count_if(F.col("b") == C.FAIL).alias("fail"))
    q = quantiles(d, ["feld"], "delta", {"delta_median": UPPER_MEDIAN, "delta_max": lower(1.0)})
    return n.join(q, "feld", "left").select(
        "feld", "bilder", "drift", "fail", F.round("delta_median", 6).alias("delta_median"),
        F.round("delta_max", 6).alias("delta_max"))


def classify_drift(results: DataFrame) -> DataFrame:
    """One row: uniform shift (platform), outliers (code) or none."""
    per = results.where(F.col("band") == C.DRIFT).select(F.array_max(F.transform(
        F.filter("diffs", lambda d: (d["band"] == C.DRIFT) & ~F.isnan(d["delta"])),
        lambda d: F.abs(d["delta"]))).alias("delta"))
    a = per.agg(F.count(F.lit(1)).alias("betroffen"), F.avg("delta").alias("_m"),
                F.stddev_pop("delta").alias("_s"), F.count("delta").alias("_n"))
    med = quantiles(per, [], "delta", {"_med": MEDIAN})
    total = results.agg(F.count(F.lit(1)).alias("_total"))
    # Three single rows side by side.
    j = a.join(F.broadcast(total)).join(F.broadcast(med), how="left")
    share = F.col("betroffen") / F.greatest(F.lit(1), F.col("_total"))
    spread = F.when((F.col("_n") > 1) & (F.col("_m") > 0), F.col("_s") / F.col("_m")).otherwise(0.0)
    kind = F.when(F.col("betroffen") == 0, "keine").when(
        (share >= C.UNIFORM_MIN_SHARE) & (spread <= C.UNIFORM_MAX_SPREAD), "uniform").otherwise("ausreisser")
    return j.select(kind.alias("muster"), "betroffen", F.round(share, 3).alias("anteil"),
                    F.round(F.coalesce("_med", F.lit(0.0)), 6).alias("delta_median"),
                    F.round(spread, 3).alias("streuung"))


def decision_matrix(review: DataFrame) -> DataFrame:
    return review.groupBy("decision_alt", "decision_neu").agg(F.count(F.lit(1)).alias("n"))


def top1_changes(review: DataFrame) -> DataFrame:
    """Balance of changed top-1 with a label; all four directions, missing ones as 0."""
    def w(c: str) -> Column:
        return F.when(F.col(c) == "ja", "richtig").otherwise("falsch")

    ch = review.where((F.col("top1_alt") != F.col("top1_neu")) & (F.col("label") != ""))
    n = ch.groupBy(F.concat(w("top1_korrekt_alt"), F.lit("->"), w("top1_korrekt_neu")).alias("richtung")
                   ).agg(F.count(F.lit(1)).alias("_n"))
    ways = [f"{a}->{b}" for a in ("falsch", "richtig") for b in ("richtig", "falsch")]
    frame = review.sparkSession.createDataFrame([(x,) for x in ways], "richtung string")
    return frame.join(n, "richtung", "left").select("richtung", F.coalesce("_n", F.lit(0)).alias("anzahl"))


def new_false_accepts(review: DataFrame) -> DataFrame:
    return review.where(
        (F.col("decision_neu") == C.ACCEPT) & (F.col("label") != "") & (F.col("top1_korrekt_neu") == "nein")
        & ~((F.col("decision_alt") == C.ACCEPT) & (F.col("top1_korrekt_alt") == "nein")))


# --- fidelity, dedup, labels ------------------------------------------------

def fidelity(stored: DataFrame, fresh: DataFrame, key: str = KEY, tol: float = 1e-3) -> DataFrame:
    """key, reasons, exact: decision, top-1 and margin of a re-scored report."""
    f = fresh.select(key, *[F.col(c).alias(f"_n_{c}") for c in ("decision", "top1", "llr_margin")])
    j = stored.join(f, key)
    a, b = F.col("llr_margin"), F.col("_n_llr_margin")
    shift = F.abs(b - a) >= tol
    reasons = F.array_compact(F.array(
        F.when(~F.col("decision").eqNullSafe(F.col("_n_decision")), "decision"),
        F.when(~F.col("top1").eqNullSafe(F.col("_n_top1")), "top1"),
        F.when((a.isNull() != b.isNull()) | F.coalesce(shift, F.lit(False)), "llr")))
    return j.select(key, reasons.alias("reasons"), (F.size(reasons) == 0).alias("exact"),
                    F.abs(b - a).alias("delta"))


def fidelity_summary(checked: DataFrame) -> DataFrame:
    n = checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if("exact").alias("exact"))
    q = quantiles(checked, [], "delta", {"median": lower(0.5), "p90": lower(0.9), "max": lower(1.0)},
                  count="comparable")
    return n.join(F.broadcast(q), how="left")       # two single rows


def db_match_ratio(reports: DataFrame, stats: DataFrame, *by: str) -> DataFrame:
    """Share of report candidates whose mean (1e-9) and shot count equal a snapshot."""
    f = R.features(reports, *by).where("feature = 'diameter_mm' and reference is not null")
    c = R.candidates(reports, *by).select("report_id", "cand_rank", "n_shots")
    rows = f.join(c, ["report_id", "cand_rank"]).join(
        stats.select("article_number", F.col("n_shots").alias("_n"), F.col("m_diameter_mm").alias("_m")),
        "article_number", "left")
    hit = F.coalesce((F.col("_n") == F.col("n_shots")) & (F.abs(F.col("_m") - F.col("reference")) < 1e-9),
                     F.lit(False))
    return rows.groupBy(*by).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("ratio"),
                                 F.count(F.lit(1)).alias("n"))


def new_by_content(batch: DataFrame, manifest: DataFrame, sha: str, order: str) -> DataFrame:
    """Rows whose hash is not in the manifest, first occurrence per hash in the batch."""
    fresh = batch.join(manifest.select(sha), sha, "left_anti")
    first = fresh.groupBy(sha).agg(F.min(order).alias(order))
    return fresh.join(first, [sha, order], "left_semi")


def label_conflicts(batch: DataFrame, manifest: DataFrame, sha: str = "sha") -> DataFrame:
    """Rows of known hashes: same truth is a duplicate, another truth a conflict."""
    m = manifest.select(sha, F.col("truth").alias("_old"))
    same = F.col("truth").eqNullSafe(F.col("_old"))
    return batch.join(m, sha).withColumn("status", F.when(same, "dublette").otherwise(
        "widerspruch_label")).withColumnRenamed("_old", "known_truth")


def unknown_labels(rows: DataFrame, articles: DataFrame, label: str = "truth") -> DataFrame:
    a = articles.select(F.col("article_number").alias(label))
    return rows.where(F.col(label) != C.NO_MATCH).join(a, label, "left_anti")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def changed_only(work: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(results of this run, new cache): only uncached keys are computed.

    The cache keeps rows outside this run, so a filtered run never shrinks it.
    """
    fresh = compute(work.join(cache.select(key), key, "left_anti"))
    reused = cache.join(work.select(key), key, "left_semi")
    return reused.unionByName(fresh.select(cache.columns)), cache.unionByName(fresh.select(cache.columns))


# --- sets of images ---------------------------------------------------------

def run_set_diff(broken_a: DataFrame, broken_b: DataFrame, key: str = KEY) -> DataFrame:
    """key, status: newly broken, repaired or still broken between two runs."""
    a = broken_a.select(key).distinct().withColumn("_a", F.lit(True))
    b = broken_b.select(key).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a").isNull(), "neu_kaputt").when(F.col("_b").isNull(), "repariert").otherwise(
        "weiterhin_kaputt")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def metric_deltas(quota_a: DataFrame, quota_b: DataFrame) -> DataFrame:
    b = quota_b.select("metric", F.col("p").alias("b"))
    return quota_a.select("metric", F.col("p").alias("a")).join(b, "metric").withColumn(
        "delta", F.round(F.col("b") - F.col("a"), 4))


def common_images(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """One row: common count; none in common raises, naming both counts."""
    ca = a.agg(F.count_distinct(key).alias("n_old"))
    cb = b.agg(F.count_distinct(key).alias("n_new"))
    both = a.join(b.select(key), key, "left_semi").agg(F.count_distinct(key).alias("n_common"))
    j = both.join(F.broadcast(ca)).join(F.broadcast(cb))        # single rows
    guard = F.when(F.col("n_common") == 0, F.raise_error(F.concat(
        F.lit("no image in common: "), F.col("n_old").cast("string"), F.lit(" / "),
        F.col("n_new").cast("string"))).cast("long")).otherwise(F.col("n_common"))
    return j.select(guard.alias("n_common"), "n_old", "n_new")


def merged_sessions(old: DataFrame, batch: DataFrame, key: str = "session") -> DataFrame:
    return old.join(batch.select(key), key, "left_anti").unionByName(batch.select(old.columns))


def missing_replays(results: DataFrame, replays: DataFrame, key: str = KEY) -> DataFrame:
    return results.select(key).join(replays.select(key), key, "left_anti")


def deterministic_subset(images: DataFrame, *, sessions=None, articles=None, tier: int | None = None,
                         n: int | None = None) -> DataFrame:
    """Selected images in (session, sha) order, the first n; n = 0 means none.

    The size of the subset is the feature asked for. Sessions and articles are
    frames with the wanted keys. A selection that hits no image is an error: an empty run must not look green.
    """
    out = images
    if sessions is not None:
        out = out.join(sessions.select("session"), "session", "left_semi")
    if articles is not None:
        out = out.join(articles.select("article"), "article", "left_semi")
    if tier == 2:
        out = out.where("tier >= 2")
    if n is not None:
        out = out.orderBy("session", KEY).limit(n)
    empty = F.raise_error(F.lit("the selection (sessions, articles, tier, subset) hits no image")).cast("boolean")
    found = out.limit(1).agg(F.count(F.lit(1)).alias("_found"))                   # a single row
    guard = found.where(F.when(F.col("_found") == 0, empty).otherwise(F.lit(False)))
    return out.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields]))
