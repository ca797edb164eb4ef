"""Align master data with enrollment means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sizes


def propose(articles: DataFrame, stats: DataFrame, min_shots: int = 2) -> DataFrame:
    """Per enrolled article the new sizes or the reason it is skipped.

    Elongated articles scale width and depth by one factor, so the aspect stays.
    """
    s = stats.select("article_number", "n_shots", F.col("m_diameter_mm").alias("mean"))
    j = articles.join(s, "article_number")
    d, w, p, m = (F.col(c) for c in ("diameter_mm", "width_mm", "depth_mm", "mean"))
    nominal = sizes.nominal_size_mm(d, w, p)
    reason = (F.when(m.isNull(), "Referenzen ohne Ø-Statistik")
              .when(F.col("n_shots") < min_shots, "zu wenige Shots")
              .when(nominal.isNull(), "keine Maße in den Stammdaten"))
    round_ = sizes.truthy(d)
    both = sizes.truthy(w) & sizes.truthy(p)
    f = m / nominal
    ok = reason.isNull()
    return j.select(
        "article_number", "n_shots", reason.alias("skipped"),
        F.when(ok, F.round(nominal, 2)).alias("nominal_old"), F.when(ok, F.round(m, 2)).alias("nominal_new"),
        F.when(ok, F.round(m, 2) - F.round(nominal, 2)).alias("diff_mm"),
        F.when(ok & round_, F.round(m, 2)).alias("new_diameter_mm"),
        F.when(ok & ~round_ & both, F.round(w * f, 2)).when(ok & ~round_, F.round(m, 2)).alias("new_width_mm"),
        F.when(ok & ~round_ & both, F.round(p * f, 2)).alias("new_depth_mm"))


def worst_first(proposal: DataFrame) -> DataFrame:
    """The rows to be written, those of the largest absolute difference first; ties by article."""
    return proposal.where("skipped is null").orderBy(F.abs("diff_mm").desc(), "article_number")


def changes(proposal: DataFrame) -> DataFrame:
    """Input of ``sources.master.update_columns``."""
    return proposal.where("skipped is null").select(
        "article_number", *[F.col(f"new_{c}").alias(c) for c in ("diameter_mm", "width_mm", "depth_mm")])


def summary(proposal: DataFrame) -> DataFrame:
    return proposal.agg(
        F.count_if(F.col("skipped").isNull()).alias("n"), F.count("skipped").alias("n_skipped"),
        F.avg("diff_mm").alias("diff_mean"), F.min("diff_mm").alias("diff_min"), F.max("diff_mm").alias("diff_max"))
