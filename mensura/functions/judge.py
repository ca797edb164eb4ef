"""Decisions, judgements and report-level rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def present(c: Column) -> Column:
    """NULL and '' both mean missing."""
    return F.coalesce(c, F.lit("")) != ""


def decide(n_candidates: Column, max_z: Column, margin: Column, has_refs: Column,
           max_z_accept, min_margin) -> Column:
    """Both limits are inclusive; a NULL margin (single candidate) passes."""
    return (F.when((n_candidates == 0) | max_z.isNull() | (max_z > max_z_accept), C.REJECT)
            .when((margin.isNull() | (margin >= min_margin)) & has_refs, C.ACCEPT)
            .otherwise(C.AMBIGUOUS))


def top1(candidates: Column) -> Column:
    return F.get(candidates, 0)


def predicted_article(candidates: Column) -> Column:
    return F.coalesce(F.get(candidates, 0)["article_number"], F.lit(C.NO_MATCH))


def judgement(verdict: Column, label: Column, predicted: Column) -> Column:
    """True / False / NULL; a human verdict wins over the label."""
    return (F.when(verdict == "correct", True).when(verdict == "wrong", False)
            .when(present(label), predicted == label))


def tone(touches_border: Column, decision: Column) -> Column:
    return (F.when(F.coalesce(touches_border, F.lit(False)), "border")
            .when(decision.isin(C.ACCEPT, C.AMBIGUOUS), decision).otherwise("reject"))


def truth_of(verdict: Column, label: Column) -> Column:
    """Struct(truth, origin): origin is the skip reason when truth is NULL."""
    def out(truth: Column, origin: str) -> Column:
        return F.struct(truth.alias("truth"), F.lit(origin).alias("origin"))

    none, has = F.lit(None).cast("string"), present(label)
    return (F.when((verdict == "correct") & has, out(label, "verdict-richtig"))
            .when(verdict == "correct", out(none, "bewertet_ohne_label"))
            .when((verdict == "wrong") & has, out(label, "verdict-falsch+artikel"))
            .when(verdict == "wrong", out(none, "falsch_ohne_artikel"))
            .when(has, out(label, "evaluate-label"))
            .otherwise(out(none, "unbewertet")))


def change_kind(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """First difference in order of weight; keys decision, top1, articles, margin, max_z."""
    return (F.when(~old["decision"].eqNullSafe(new["decision"]), "entscheidung")
            .when(~old["top1"].eqNullSafe(new["top1"]), "top1")
            .when(~old["articles"].eqNullSafe(new["articles"]), "kandidatenset")
            .when(~old["margin"].eqNullSafe(new["margin"])
                  | ~old["max_z"].eqNullSafe(new["max_z"]), "score")
            .otherwise("identisch"))


def triage_category(fields: Column, golden: dict[str, Column]) -> Column:
    """Failure category; ``golden`` has label, articles, gate_passed, posterior."""
    seg = F.array(*[F.lit(x) for x in ("seg_area_px", "centroid_x", "centroid_y")])
    decisive = F.array(F.lit("top_k"), F.lit("decision"))
    truth_lost = (present(golden["label"])
                  & ~F.array_contains(golden["articles"], golden["label"])
                  & (F.arrays_overlap(fields, decisive) | (F.size(fields) == 0)))
    suspicious = ((F.size(golden["articles"]) > 0) & F.coalesce(golden["gate_passed"], F.lit(False))
                  & (golden["posterior"] >= 0.95))
    return (F.when(truth_lost & suspicious, "label_verdacht")
            .when(truth_lost, "vorfilter_kill")
            .when(F.arrays_overlap(fields, seg), "segmentierungs_aenderung")
            .when(F.array_contains(fields, "gate_passed"), "gate_kipp")
            .when(F.size(fields) > 0, "messwert_drift").otherwise("unklar"))


def attribution_case(n_candidates: Column, truth_rank: Column, n_feat_top: Column,
                     n_feat_truth: Column) -> Column:
    return (F.when(n_candidates == 0, "keine_kandidaten")
            .when(truth_rank.isNull(), "vorfilter_kill")
            .when(truth_rank == 1, "top1_korrekt")
            .when((n_feat_top == 0) | (n_feat_truth == 0), "keine_merkmalsscores")
            .otherwise("attribuierbar"))
