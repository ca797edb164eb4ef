"""Views over nested reports and the report browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import judge, sizes, text
from ..params import Params
from .ranks import global_position

RID = "report_id"


def candidates(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per candidate with its 1-based rank."""
    return reports.select(RID, *keep, F.posexplode("candidates").alias("_p", "_c")).select(
        RID, *keep, (F.col("_p") + 1).cast("long").alias("cand_rank"), "_c.*")


def features(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per feature of every candidate."""
    c = candidates(reports, *keep).select(RID, *keep, "cand_rank", "article_number", "has_references",
                                          F.posexplode("features").alias("_p", "_f"))
    return c.select(RID, *keep, "cand_rank", "article_number", "has_references",
                    (F.col("_p") + 1).cast("long").alias("fpos"), "_f.*")


def kills(reports: DataFrame, *keep: str) -> DataFrame:
    return reports.select(RID, *keep, F.posexplode("prefiltered").alias("_p", "_k")).select(
        RID, *keep, (F.col("_p") + 1).cast("long").alias("kill_pos"), "_k.*")


def judged(reports: DataFrame) -> DataFrame:
    """Adds pred (top-1 or NO_MATCH) and ok (three-valued judgement)."""
    out = reports.withColumn("pred", judge.predicted_article(F.col("candidates")))
    return out.withColumn("ok", judge.judgement(F.col("verdict"), F.col("label"), F.col("pred")))


def truth_rank(label: Column | str = "label") -> Column:
    """1-based rank of the true article among the candidates, NULL when absent."""
    label = F.col(label) if isinstance(label, str) else label
    pos = F.array_position(F.transform("candidates", lambda c: c["article_number"]), label)
    return F.when(judge.present(label) & (pos > 0), pos)


def channel_sum(feats: Column, channel: str) -> Column:
    members = C.CHANNELS[channel]
    return F.aggregate(F.filter(feats, lambda f: f["feature"].isin(*members)), F.lit(0.0),
                       lambda acc, f: acc + f["weighted"])


def channel_scores(feats: Column) -> dict[str, Column]:
    return {ch: F.round(channel_sum(feats, ch), 4) for ch in C.CHANNELS}


def channel_percentages(feats: Column) -> dict[str, Column]:
    """exp of the channel sum; a channel without features is NULL, not 100 %."""
    def has(members: tuple) -> Column:
        return F.exists(feats, lambda f: f["feature"].isin(*members))

    return {ch: F.when(has(members), F.exp(channel_sum(feats, ch)))
            for ch, members in C.CHANNELS.items()}


def natural_positions(df: DataFrame, name: str, out: str) -> DataFrame:
    """1-based position in natural order, for display."""
    keyed = df.withColumn("_k", text.natural_sort_key(F.col(name)))
    pos = global_position(keyed, [], [F.col("_k"), F.col(name)], "_pos")
    return pos.select(name, (F.col("_pos") + 1).alias(out))


def filter_reports(reports: DataFrame, *, tone: str | None = None, judged: bool | str | None = None,
                   article: str | None = None, since: str | None = None,
                   until: str | None = None) -> DataFrame:
    """Report browser filter; ``until`` is an inclusive prefix of the name stem."""
    pred = judge.predicted_article(F.col("candidates"))
    out = reports
    if tone:
        out = out.where(judge.tone(F.col("touches_border"), F.col("decision")) == tone)
    if judged is not None:
        ok = judge.judgement(F.col("verdict"), F.col("label"), pred)
        out = out.where(ok.isNull() if judged == "unjudged" else ok == bool(judged))
    if article:
        shown = F.when(pred == C.NO_MATCH, "— kein Kandidat").otherwise(pred)
        out = out.where(shown.contains(article))
    if since:
        out = out.where(F.col("stem") >= since)
    if until:
        out = out.where(F.col("stem") <= until + "￿")
    return out


def filter_series(reports: DataFrame, *, label: str | None = None, since: str | None = None,
                  until: str | None = None, limit: int | None = None) -> DataFrame:
    """Series for the floor analysis: exact label, ISO text range, newest n."""
    ts = F.coalesce(F.col("timestamp"), F.lit(""))
    out = reports
    if label is not None:
        out = out.where(F.col("label") == label)
    if since is not None:
        out = out.where(ts >= since)
    if until is not None:
        out = out.where(ts <= until)
    return newest(out, limit) if limit is not None else out


def newest(reports: DataFrame, n: int, by: str = "stem") -> DataFrame:
    """Top-n report: the newest n by name or write time."""
    return reports.orderBy(F.col(by).desc()).limit(n)


def detail(reports: DataFrame, params: Params) -> DataFrame:
    """Flat header of every report as the detail page shows it."""
    de = text.decimal_comma
    j = judged(reports)
    n = F.size("candidates")
    gate_z = F.when(F.col("max_z_winner").isNull(), "–").otherwise(F.concat(
        de(F.col("max_z_winner"), 2), F.lit(" (Gate ≤ "), de(F.lit(params.max_z_accept), 2), F.lit(")")))
    gate_m = F.when(F.col("llr_margin").isNull(), F.when(n == 1, "∞ (1 Kandidat)").otherwise("–")).otherwise(
        F.concat(de(F.col("llr_margin"), 2), F.lit(" (≥ "), de(F.lit(params.min_llr_margin), 2), F.lit(")")))
    word = F.when(F.col("ok"), "Richtig").when(~F.col("ok"), "Falsch").otherwise("unbewertet")
    tail = F.when(judge.present(F.col("label")), F.concat(F.lit(" · Artikel: "), F.col("label"))).otherwise("")
    return j.select(RID, F.upper("decision").alias("badge"), gate_z.alias("gate_max_z"),
                    gate_m.alias("gate_margin"), F.concat(word, tail).alias("verdict"),
                    n.cast("long").alias("n_candidates"),
                    F.coalesce(F.size(F.get("candidates", 0)["features"]), F.lit(0)).cast("long")
                    .alias("n_winner_features"), F.size("prefiltered").cast("long").alias("n_kills"))


def detail_kills(reports: DataFrame) -> DataFrame:
    k = kills(reports)
    return k.select(RID, "article_number", "reason", sizes.kill_text(
        F.col("reason"), F.col("area_error_pct"), F.col("over_tolerance_mm"),
        F.col("tolerance_mm")).alias("abstand"))
