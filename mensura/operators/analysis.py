"""Report analysis: confusion, rates, margins, drift, attribution.

All of it is conditional aggregation over nested reports. Matrices are long form
(row, column, count); a pivot is left to the reader of a small result. Sums combine
on the map side, so an article with a third of all reports is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import distances as dist
from ..functions import judge, sizes
from ..functions.compare import rule_of_three, wilson
from ..params import Params
from . import reports as R
from .enroll import sample_std
from .order_stats import MEDIAN, UPPER_MEDIAN, lower, quantiles

RID = R.RID
RANKS = ("1", "2", "3", ">3", "nicht im Set")


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _labelled(reports: DataFrame) -> DataFrame:
    return reports.where(judge.present(F.col("label")))


# --- totals -----------------------------------------------------------------

def batch_summary(reports: DataFrame, *by: str) -> DataFrame:
    j = R.judged(reports)
    out = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("ok").alias("labeled"),
        _count_if(F.col("ok")).alias("correct"),
        *[_count_if(F.col("decision") == d).alias(d) for d in C.DECISIONS])
    acc = F.coalesce(F.try_divide(F.col("correct"), F.col("labeled")), F.lit(0.0))
    return out.withColumn("accuracy", acc)


def posterior_stats(reports: DataFrame) -> DataFrame:
    """Mean posterior of right and wrong top-1 (no candidate counts as 0)."""
    j = R.judged(reports).withColumn(
        "p", F.coalesce(F.get("candidates", 0)["posterior"], F.lit(0.0)))
    return j.where("ok is not null").groupBy().agg(
        F.avg(F.when(F.col("ok"), F.col("p"))).alias("mean_correct"),
        F.avg(F.when(~F.col("ok"), F.col("p"))).alias("mean_wrong"))


def confusion_pairs(reports: DataFrame) -> DataFrame:
    """Errors only, unknown truth as '?'."""
    truth = F.when(judge.present(F.col("label")), F.col("label")).otherwise("?")
    return R.judged(reports).where("ok = false").groupBy(
        truth.alias("truth"), F.col("pred").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def top_confusions(reports: DataFrame, n: int = 8) -> DataFrame:
    """Top-n report of the most common error pairs."""
    return confusion_pairs(reports).orderBy(F.desc("n"), "truth", "predicted").limit(n)


def top_k_accuracy(reports: DataFrame, k: int) -> DataFrame:
    names = F.transform(F.slice("candidates", 1, k), lambda c: c["article_number"])
    return _labelled(reports).groupBy().agg(
        _count_if(F.array_contains(names, F.col("label"))).alias("hits"),
        F.count(F.lit(1)).alias("scored"))


QUARTILES = {"minimum": lower(0.0), "p25": lower(0.25), "median": lower(0.5),
             "p75": lower(0.75), "maximum": lower(1.0)}


def max_z_distribution(reports: DataFrame, *by: str) -> DataFrame:
    return quantiles(reports, by, "max_z_winner", QUARTILES, count="n")


def round_metrics(reports: DataFrame, side: str, k: int = 3) -> DataFrame:
    """metric, side, value rows of one test round."""
    s = batch_summary(reports)
    tk = top_k_accuracy(reports, k)
    q = max_z_distribution(reports)
    pct = 100.0

    def share(d: str) -> Column:
        return F.coalesce(F.try_divide(F.col(d) * pct, F.col("total")), F.lit(0.0))

    parts = [
        s.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value"))
                                    for m, c in (("total", F.col("total")), ("labeled", F.col("labeled")),
                                                 ("accuracy_pct", F.col("accuracy") * pct),
                                                 ("accept_pct", share("accept")),
                                                 ("ambiguous_pct", share("ambiguous")),
                                                 ("reject_pct", share("reject")))]))),
        tk.select(F.lit("top_k_pct").alias("metric"), F.coalesce(
            F.try_divide(F.col("hits") * pct, F.col("scored")), F.lit(0.0)).alias("value")),
        q.select(F.inline(F.array(*[F.struct(F.lit(f"max_z_{n}").alias("metric"), F.col(n).alias("value"))
                                    for n in QUARTILES])))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("side", F.lit(side))


def ab_compare(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """Two rounds side by side; a change below .05 counts as equal."""
    both = round_metrics(a, "a", k).unionByName(round_metrics(b, "b", k))
    wide = both.groupBy("metric").pivot("side", ["a", "b"]).agg(F.max("value"))
    d = F.col("b") - F.col("a")
    return wide.withColumn("delta", F.when(F.abs(d) >= 0.05, d))


# --- matrices ---------------------------------------------------------------

def confusion(reports: DataFrame) -> DataFrame:
    """label, pred, n over all decisions and n_accept over accepts."""
    j = R.judged(_labelled(reports))
    return j.groupBy("label", "pred").agg(
        F.count(F.lit(1)).alias("n"), _count_if(F.col("decision") == C.ACCEPT).alias("n_accept"))


def confusion_focus(reports: DataFrame) -> DataFrame:
    """Rows of truths with at least one error; their cells and the diagonals hit columns need."""
    m = confusion(reports).select("label", "pred", "n")
    per = m.groupBy("label").agg(F.sum("n").alias("row_total"), F.coalesce(F.sum(
        F.when(F.col("pred") == F.col("label"), F.col("n"))), F.lit(0)).alias("diagonal"))
    bad = per.where("diagonal < row_total")
    return m.join(bad, "label").select("label", "pred", "n", "row_total",
                                       (F.col("diagonal") == 0).alias("never_hit"))


def score_rows(reports: DataFrame) -> DataFrame:
    j = R.judged(reports)
    top = F.get("candidates", 0)
    return j.select(RID, F.col("timestamp"), F.col("ok").alias("korrekt"), "decision",
                    top["log_score"].alias("log_score"), top["posterior"].alias("posterior"),
                    "max_z_winner", "llr_margin")


def histogram(rows: DataFrame, panel: str, flag: str, value: str, bins: int, *,
              start: str = "min", top: Column | None = None) -> DataFrame:
    """panel, flag, bin, n over equal bins between the bounds of each panel.

    Bounds are one row per panel, so joining them back is a broadcast by size.
    """
    lo = F.min(value) if start == "min" else F.lit(0.0)
    hi = F.max(value) if top is None else top
    bounds = rows.groupBy(panel).agg(lo.alias("_lo"), hi.alias("_hi"))
    bounds = bounds.withColumn("_hi", F.when(F.col("_hi") == 0, 1.0).otherwise(F.col("_hi")))
    pos = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(pos, F.lit(0))))
    return rows.join(F.broadcast(bounds), panel).groupBy(panel, flag, b.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def score_histograms(reports: DataFrame, bins: int = 19, against_label: bool = False) -> DataFrame:
    """Right/wrong histograms of gate z and margin. 20 edges, or 22 against the raw label."""
    if against_label:
        j = _labelled(R.judged(reports)).withColumn("ok", F.col("pred") == F.col("label"))
    else:
        j = R.judged(reports).where("ok is not null")
    items = F.array(*[F.struct(F.lit(c).alias("panel"), F.col(c).alias("value"))
                      for c in ("max_z_winner", "llr_margin")])
    long = j.select("ok", F.inline(items)).where("value is not null")
    return histogram(long, "panel", "ok", "value", bins)


# --- rates ------------------------------------------------------------------

def _quota_row(metric: str, k: Column, n: Column, corpus: bool) -> Column:
    w = wilson(k, n, corpus=corpus)
    return F.struct(F.lit(metric).alias("metric"), k.alias("k"), n.alias("n"),
                    F.round(w["p"], 4).alias("p"), F.round(w["lo"], 4).alias("wilson_lo"),
                    F.round(w["hi"], 4).alias("wilson_hi"))


def _top3_hit() -> Column:
    names = F.transform(F.slice("candidates", 1, 3), lambda c: c["article_number"])
    return F.array_contains(names, F.col("label")) | (
        (F.size("candidates") == 0) & (F.col("label") == C.NO_MATCH))


def quotas(reports: DataFrame, *by: str) -> DataFrame:
    """Judgement-based rates of the analysis with Wilson bounds and rule of three."""
    j = R.judged(reports)
    lab, acc = judge.present(F.col("label")), F.col("decision") == C.ACCEPT
    a = j.groupBy(*by).agg(
        _count_if(F.col("ok")).alias("k1"), F.count("ok").alias("n1"),
        _count_if(lab & _top3_hit()).alias("k3"), _count_if(lab).alias("n3"),
        _count_if(acc).alias("ka"), F.count(F.lit(1)).alias("na"),
        _count_if(acc & ~F.col("ok")).alias("kf"), F.count(F.when(acc, F.col("ok"))).alias("nf"))
    rows = F.array(*[_quota_row(m, F.col(k), F.col(n), False) for m, k, n in (
        ("accuracy_top1", "k1", "n1"), ("accuracy_top3", "k3", "n3"),
        ("auto_accept_rate", "ka", "na"), ("false_accept_rate", "kf", "nf"))])
    out = a.select(*by, F.inline(rows))
    zero = F.when(F.col("metric") == "false_accept_rate", F.col("k")).when(
        F.col("metric") == "accuracy_top1", F.col("n") - F.col("k"))
    return out.withColumn("rule_of_three", F.round(rule_of_three(zero, F.col("n")), 6))


def per_article_quota(reports: DataFrame) -> DataFrame:
    j = R.judged(_labelled(reports)).where("ok is not null").groupBy("label").agg(
        _count_if(F.col("ok")).alias("k"), F.count(F.lit(1)).alias("n"))
    w = wilson(F.col("k"), F.col("n"))
    return j.select("label", "k", "n", F.round(w["p"], 4).alias("p"),
                    F.round(w["lo"], 4).alias("wilson_lo"), F.round(w["hi"], 4).alias("wilson_hi"))


def worst_first(quota: DataFrame) -> DataFrame:
    """All articles, the lowest accuracy first."""
    return quota.orderBy("p", "label")


def verdict_by_prediction(reports: DataFrame) -> DataFrame:
    """Right/wrong/unjudged per predicted article plus the total (grouping level 1)."""
    j = R.judged(reports)
    agg = j.rollup("pred").agg(
        F.grouping("pred").cast("long").alias("is_total"), _count_if(F.col("ok")).alias("richtig"),
        _count_if(~F.col("ok")).alias("falsch"), _count_if(F.col("ok").isNull()).alias("unbewertet"))
    name = F.when(F.col("is_total") == 1, "gesamt").when(
        F.col("pred") == C.NO_MATCH, "— kein Kandidat").otherwise(F.col("pred"))
    return agg.select(name.alias("artikel"), "is_total", "richtig", "falsch", "unbewertet",
                      F.try_divide(F.col("richtig"), F.col("richtig") + F.col("falsch")).alias("quote"))


def margin_by_setsize(reports: DataFrame) -> DataFrame:
    r = reports.where((F.size("candidates") > 0) & F.col("llr_margin").isNotNull()).withColumn(
        "set_size", F.size("candidates").cast("long"))
    return quantiles(r, ["set_size"], "llr_margin", {"median": MEDIAN}, count="n")


def diameter_vs_nominal(reports: DataFrame) -> DataFrame:
    """Measurement rows with the nominal the last labelled report carried."""
    lab = _labelled(reports).where("measured.circle_diameter_mm is not null")
    nom = F.get(F.filter("candidates", lambda c: c["article_number"] == F.col("label")), 0)
    last = lab.withColumn("_n", nom["nominal_size_mm"]).where("_n is not null").groupBy("label").agg(
        F.max_by("_n", F.struct("stem", RID)).alias("nominal_mm"))
    return lab.select(RID, "label", F.col("measured.circle_diameter_mm").alias("measured_mm")).join(
        last, "label")


def rank_bucket() -> Column:
    r = R.truth_rank()
    return (F.when(r.isNull(), "nicht im Set").when(r <= 3, r.cast("string")).otherwise(">3"))


def true_rank_buckets(reports: DataFrame) -> DataFrame:
    """Counts per rank bucket, per article and in total."""
    b = _labelled(reports).withColumn("_b", rank_bucket())
    names = ("rank_1", "rank_2", "rank_3", "rank_more", "not_in_set")
    return b.rollup("label").agg(
        F.grouping("label").cast("long").alias("is_total"),
        *[_count_if(F.col("_b") == v).alias(n) for n, v in zip(names, RANKS)])


def decision_per_article(reports: DataFrame) -> DataFrame:
    return _labelled(reports).groupBy("label").agg(
        *[_count_if(F.col("decision") == d).alias(d) for d in C.DECISIONS],
        F.avg(F.when(F.col("decision") == C.ACCEPT, 1.0).otherwise(0.0)).alias("accept_share"))


# --- recovered parameters ---------------------------------------------------

def recover_sigma_floors(reports: DataFrame, *by: str) -> DataFrame:
    """Upper median of sqrt(eff^2 - enroll^2) per floor key."""
    f = R.features(reports, *by)
    var = F.col("sigma_eff") * F.col("sigma_eff") - F.col("sigma_enroll") * F.col("sigma_enroll")
    key = F.create_map(*[F.lit(x) for kv in C.FLOOR_KEYS.items() for x in kv])[F.col("feature")]
    s = f.select(*by, key.alias("floor_key"), var.alias("_v")).where("_v > 0").withColumn(
        "_f", F.sqrt("_v"))
    return quantiles(s, [*by, "floor_key"], "_f", {"floor": UPPER_MEDIAN}, count="n")


def recover_scale(reports: DataFrame, circle_px: Column) -> DataFrame:
    """session, mm_per_px: upper median of stored mm over contour circle px."""
    s = reports.withColumn("_px", circle_px).withColumn("_mm", F.col("measured.circle_diameter_mm"))
    s = s.where("_px > 0 and _mm > 0").withColumn("_r", F.col("_mm") / F.col("_px"))
    return quantiles(s, ["session"], "_r", {"mm_per_px": UPPER_MEDIAN}, count="n")


# --- prefilter --------------------------------------------------------------

FUNNEL = ("rank_1", "in_set", "kill_near", "kill_far", "kill_area", "not_in_set")


def funnel_category() -> Column:
    r = R.truth_rank()
    kill = F.get(F.filter("prefiltered", lambda k: k["article_number"] == F.col("label")), 0)
    over, tol = (F.coalesce(kill[c], F.lit(0.0)) for c in ("over_tolerance_mm", "tolerance_mm"))
    return (F.when(r == 1, "rank_1").when(r.isNotNull(), "in_set").when(kill.isNull(), "not_in_set")
            .when(kill["reason"] == "area", "kill_area").when(over <= tol, "kill_near")
            .otherwise("kill_far"))


def prefilter_funnel(reports: DataFrame) -> DataFrame:
    f = _labelled(reports).withColumn("_f", funnel_category())
    return f.groupBy("label").agg(*[_count_if(F.col("_f") == c).alias(c) for c in FUNNEL])


def kill_view(reports: DataFrame) -> DataFrame:
    """All kills, flagged where the true article was killed."""
    k = R.kills(reports, "label")
    return k.select(RID, "kill_pos", "article_number", "reason", (
        judge.present(F.col("label")) & (F.col("article_number") == F.col("label"))).alias("true_article"))


def kill_totals(reports: DataFrame) -> DataFrame:
    return reports.groupBy().agg(
        F.sum(F.size("prefiltered")).alias("n_kills"),
        _count_if(F.size("prefiltered") > 0).alias("reports_with_kills"),
        F.count(F.lit(1)).alias("n_reports"))


# --- spread -----------------------------------------------------------------

def test_vs_enroll(reports: DataFrame) -> DataFrame:
    """Sample std of test diameters against the first-seen enrollment sigma, n >= 2."""
    lab = _labelled(reports).where("measured.circle_diameter_mm is not null")
    own = F.get(F.filter("candidates", lambda c: c["article_number"] == F.col("label")), 0)
    sig = F.get(F.filter(own["features"], lambda f: f["feature"] == "diameter_mm"), 0)["sigma_enroll"]
    return lab.withColumn("_s", sig).groupBy("label").agg(
        F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct("stem", RID))).alias("sigma_enroll"),
        sample_std("measured.circle_diameter_mm").alias("test_std"),
        F.count(F.lit(1)).alias("n")).where("n >= 2 and sigma_enroll is not null")


def z_per_feature(reports: DataFrame, max_z: float = 3.5, bins: int = 13) -> DataFrame:
    """|z| of the winner per feature, right and wrong, 14 edges from 0 to 1.05 max."""
    j = R.judged(reports).where("ok is not null")
    long = j.select("ok", F.explode(F.get("candidates", 0)["features"]).alias("f")).select(
        "ok", F.col("f.feature").alias("feature"), F.abs("f.z").alias("z"))
    top = F.greatest(F.max("z"), F.lit(max_z)) * 1.05
    return histogram(long, "feature", "ok", "z", bins, start="zero", top=top)


def near_misses(reports: DataFrame, params: Params) -> DataFrame:
    """Correct, but the margin is below the near-miss limit; channel differences."""
    limit = params.min_llr_margin * params.near_miss_factor
    j = R.judged(reports).where(F.col("ok") & (F.size("candidates") >= 2)
                                & (F.col("llr_margin") < limit))
    c1, c2 = F.get("candidates", 0), F.get("candidates", 1)
    s1, s2 = R.channel_scores(c1["features"]), R.channel_scores(c2["features"])
    return j.select(RID, F.round("llr_margin", 4).alias("margin"), "label",
                    c2["article_number"].alias("rival"), c1["log_score"].alias("log_score_top1"),
                    c2["log_score"].alias("log_score_top2"),
                    *[F.round(s1[ch] - s2[ch], 4).alias(f"diff_{ch}") for ch in C.CHANNELS])


def near_miss_pairs(reports: DataFrame, params: Params, n: int = 12) -> DataFrame:
    """Top-n report of rival pairs."""
    return near_misses(reports, params).groupBy("label", "rival").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label", "rival").limit(n)


def top1_vs_top2(reports: DataFrame) -> DataFrame:
    """Winner beside runner-up: both sit in the same row, no join."""
    c1, c2 = F.get("candidates", 0), F.get("candidates", 1)
    return reports.where(F.size("candidates") >= 2).select(
        RID, c1["article_number"].alias("top1"), c2["article_number"].alias("top2"),
        c1["log_score"].alias("score1"), c2["log_score"].alias("score2"),
        F.round(c1["log_score"] - c2["log_score"], 4).alias("margin"))


def truth_candidate(reports: DataFrame) -> DataFrame:
    own = F.get(F.filter("candidates", lambda c: c["article_number"] == F.col("label")), 0)
    return _labelled(reports).select(RID, "label", R.truth_rank().alias("truth_rank"),
                                     own["log_score"].alias("log_score"),
                                     own["nominal_size_mm"].alias("nominal_mm"))


def wrong_reports(reports: DataFrame) -> DataFrame:
    """Reports judged wrong with a real label, and their attribution case."""
    j = R.judged(_labelled(reports)).where((~F.col("ok")) & (F.col("label") != C.NO_MATCH))
    own = F.get(F.filter("candidates", lambda c: c["article_number"] == F.col("label")), 0)
    top = F.get("candidates", 0)

    def n_feat(c: Column) -> Column:
        return F.coalesce(F.size(c["features"]), F.lit(0))

    j = j.withColumns({"truth_rank": R.truth_rank(), "_own": own, "_top": top})
    return j.withColumn("fall", judge.attribution_case(
        F.size("candidates"), F.col("truth_rank"), n_feat(F.col("_top")), n_feat(F.col("_own"))))


def error_attribution(reports: DataFrame) -> DataFrame:
    """Channel scores of the wrong and the right candidate and the causing channel."""
    w = wrong_reports(reports).where("fall = 'attribuierbar'")
    sw, sr = R.channel_scores(F.col("_top.features")), R.channel_scores(F.col("_own.features"))
    cols = []
    for ch in C.CHANNELS:
        cols += [sw[ch].alias(f"{ch}_wrong"), sr[ch].alias(f"{ch}_right"),
                 F.round(sw[ch] - sr[ch], 4).alias(f"{ch}_diff")]
    out = w.select(RID, "label", F.col("pred"), *cols)
    best = F.greatest(*[F.col(f"{ch}_diff") for ch in C.CHANNELS])
    cause = None
    for ch in C.CHANNELS:            # the fixed channel order decides ties
        hit = F.col(f"{ch}_diff") == best
        cause = F.when(hit, ch) if cause is None else cause.when(hit, ch)
    return out.withColumn("cause", cause)


def unattributed(reports: DataFrame) -> DataFrame:
    w = wrong_reports(reports).where("fall <> 'attribuierbar'")
    return w.select(RID, "fall", "label", F.col("_top.article_number").alias("top1"), "decision",
                    F.size("candidates").cast("long").alias("n_candidates"), "truth_rank",
                    F.col("measured.circle_diameter_mm").alias("measured_mm"),
                    F.col("_top.corrected_diameter_mm").alias("top1_corrected_mm"),
                    F.col("_top.nominal_size_mm").alias("top1_nominal_mm"))


def position_errors(reports: DataFrame, articles: DataFrame, camera_mm: float = 300.0) -> DataFrame:
    """Labelled reports with a centroid against the nominal diameter of their article."""
    lab = _labelled(reports).where((F.col("label") != C.NO_MATCH) & F.col("centroid_px").isNotNull()
                                   & F.col("measured.circle_diameter_mm").isNotNull())
    a = articles.where(sizes.truthy(F.col("diameter_mm"))).select(
        F.col("article_number").alias("label"), "diameter_mm", "height_mm")
    corr = sizes.height_corrected(F.col("_m"), F.col("height_mm"), camera_mm)
    return lab.select(RID, "label", "centroid_px", F.col("measured.circle_diameter_mm").alias("_m")).join(
        a, "label").select(RID, F.col("centroid_px.x").alias("x_px"), F.col("centroid_px.y").alias("y_px"),
                           "label", F.col("diameter_mm").alias("soll_mm"),
                           F.round(corr, 2).alias("gemessen_mm"),
                           F.round(corr - F.col("diameter_mm"), 2).alias("fehler_mm"))


# --- drift and cross section ------------------------------------------------

def drift_spread(reports: DataFrame) -> DataFrame:
    lab = _labelled(reports).where("measured.circle_diameter_mm is not null")
    return lab.groupBy("label").agg(
        sample_std("measured.circle_diameter_mm").alias("std"),
        F.count(F.lit(1)).alias("n"))


def drift_conspicuous(reports: DataFrame, n: int = 4) -> DataFrame:
    """Top-4 report of labels whose spread exceeds max(1, twice the median)."""
    s = drift_spread(reports)
    med = quantiles(s.where("std > 0"), [], "std", {"med": MEDIAN})
    limit = F.greatest(F.lit(1.0), 2.0 * F.coalesce(F.col("med"), F.lit(0.0)))
    # ``med`` is one row: the join is with a scalar, not between tables.
    return s.join(F.broadcast(med)).where(F.col("std") > limit).orderBy(
        F.desc("std"), "label").limit(n).select("label", "std", "n")


def cross_section(reports: DataFrame, params: Params) -> DataFrame:
    """panel, item, part, n: the five overview panels in one long result."""
    j = R.judged(reports)
    m = j.where("llr_margin is not null and ok is not null").withColumn("panel", F.lit("margin"))
    top = F.greatest(F.max("llr_margin"), F.lit(params.min_llr_margin)) * 1.05
    margin = histogram(m, "panel", "ok", "llr_margin", 19, start="zero", top=top).select(
        "panel", F.col("bin").cast("string").alias("item"),
        F.when(F.col("ok"), "right").otherwise("wrong").alias("part"), "n")
    lab = _labelled(reports)
    r = R.truth_rank()
    part = F.when(r == 1, "rank_1").when(r.isNotNull(), "in_set").otherwise("not_in_set")
    funnel = lab.groupBy(F.lit("funnel").alias("panel"), F.col("label").alias("item"), part.alias("part")
                         ).agg(F.count(F.lit(1)).alias("n"))
    ranks = lab.groupBy(F.lit("rank").alias("panel"), rank_bucket().alias("item"), F.lit("all").alias("part")
                        ).agg(F.count(F.lit(1)).alias("n"))
    dec = lab.groupBy(F.lit("decision").alias("panel"), F.col("label").alias("item"),
                      F.col("decision").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    drift = drift_conspicuous(reports).select(
        F.lit("drift").alias("panel"), F.col("label").alias("item"), F.lit("conspicuous").alias("part"), "n")
    return margin.unionByName(funnel).unionByName(ranks).unionByName(dec).unionByName(drift)


# --- pairs ------------------------------------------------------------------

def cooccurring_pairs(reports: DataFrame) -> DataFrame:
    """Distinct article pairs (a < b) that ever shared a candidate set.

    Equal candidate sets collapse first, so a scene repeated a billion times is
    expanded once; a set is as large as the catalogue is dense, not as the data.
    """
    names = F.array_sort(F.array_distinct(F.transform(
        F.filter("candidates", lambda c: c["has_references"]), lambda c: c["article_number"])))
    sets = reports.select(names.alias("s")).where(F.size("s") >= 2).distinct()
    return sets.select("s", F.posexplode("s").alias("i", "a")).select(
        "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).distinct()


def discriminability(pairs: DataFrame, stats: DataFrame, floors: dict | None = None) -> DataFrame:
    """Pair x feature separation: location difference over rms of max(s, floor).

    Means end in noise that depends on the order of their rows; it is rounded off (10 digits), or the same
    shots would fall on either side of a tie of a later rounding.
    """
    floors = floors or C.SIGMA_FLOORS
    names = [f"m_{f}" for f in C.SCALAR_FEATURES] + [f"p_{f}" for f in C.PROTO_FEATURES] + [
        f"s_{f}" for f in C.ALL_FEATURES]
    sa = stats.select(F.col("article_number").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    sb = stats.select(F.col("article_number").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    j = pairs.join(sa, "a", "left").join(sb, "b", "left")
    cols = {}
    for f in C.ALL_FEATURES:
        if f in C.SCALAR_FEATURES:
            loc = F.abs(F.col(f"a_m_{f}") - F.col(f"b_m_{f}"))
        else:
            loc = dist.proto_distance(f, F.col(f"a_p_{f}"), F.col(f"b_p_{f}"))
        fl = F.lit(float(floors.get(C.FLOOR_KEYS[f], 0.0)))
        va = F.greatest(F.coalesce(F.col(f"a_s_{f}"), F.lit(0.0)), fl)
        vb = F.greatest(F.coalesce(F.col(f"b_s_{f}"), F.lit(0.0)), fl)
        eff = F.sqrt((va * va + vb * vb) / 2.0)
        cols[f] = F.when(eff > 0, F.round(loc / eff, 10))
    out = j.select("a", "b", *[x.alias(f) for f, x in cols.items()])
    return out.withColumn("max_sep", F.greatest(*[F.col(f) for f in C.ALL_FEATURES]))


# --- stock ------------------------------------------------------------------

def stock_status(articles: DataFrame | None, references: DataFrame | None,
                 spark=None) -> DataFrame:
    """Article count and articles with references; a missing table counts as 0."""
    frame = (articles if articles is not None else references)
    session = frame.sparkSession if frame is not None else spark
    base = session.range(1).select()
    na = (articles.agg(F.count(F.lit(1)).alias("n_articles")) if articles is not None
          else base.select(F.lit(0).cast("long").alias("n_articles")))
    nr = (references.agg(F.count_distinct("article_number").alias("n_with_references"))
          if references is not None else base.select(F.lit(0).cast("long").alias("n_with_references")))
    return na.join(F.broadcast(nr))      # two single rows


def weak_stats(stats_long: DataFrame, shots_per_article: DataFrame,
               min_n: int = C.MIN_FLOOR_N) -> DataFrame:
    """Articles with few shots, and scalars without spread although n > 1."""
    zero = stats_long.where(F.col("feature").isin(*C.SCALAR_FEATURES) & (F.col("std") == 0)
                            & (F.col("n") > 1)).groupBy("article_number").agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("zero_sigma"))
    j = shots_per_article.join(zero, "article_number", "left")
    return j.select("article_number", "n_shots", (F.col("n_shots") < min_n).alias("few_shots"),
                    F.coalesce("zero_sigma", F.lit("")).alias("zero_sigma")).where(
        "few_shots or zero_sigma <> ''")


def article_listing(articles: DataFrame, references: DataFrame) -> DataFrame:
    """Master rows with reference counts; articles without references show 0."""
    n = references.groupBy("article_number").agg(F.count(F.lit(1)).alias("n_references"))
    nominal = sizes.nominal_size_mm(F.col("diameter_mm"), F.col("width_mm"), F.col("depth_mm"))
    return articles.join(n, "article_number", "left").select(
        "article_number", "name", sizes.geometry_text(
            F.col("diameter_mm"), F.col("width_mm"), F.col("depth_mm")).alias("size_text"),
        nominal.alias("nominal_mm"), F.coalesce("n_references", F.lit(0)).alias("n_references"))


def capture_order(reports: DataFrame) -> DataFrame:
    """0-based order by name stem inside each session (distributed positions)."""
    from .ranks import global_position
    rows = reports.select(RID, "session", "stem", "label")
    return global_position(rows, ["session"], [F.col("stem"), F.col(RID)], "capture_order")
