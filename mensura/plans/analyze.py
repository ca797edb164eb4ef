"""User-level jobs over stored reports: the analysis folder and the regression check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import gates
from ..operators import regression as X
from ..params import Params


def sections(reports: DataFrame, params: Params, articles: DataFrame | None = None,
             stats: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result table of the analysis, by name, as lazy frames."""
    out = {
        "batch_summary": A.batch_summary(reports), "posterior_stats": A.posterior_stats(reports),
        "confusion": A.confusion(reports), "confusion_focus": A.confusion_focus(reports),
        "top_confusions": A.top_confusions(reports), "score_distributions": A.score_rows(reports),
        "score_histograms": A.score_histograms(reports), "near_misses": A.near_misses(reports, params),
        "near_miss_pairs": A.near_miss_pairs(reports, params),
        "error_attribution": A.error_attribution(reports), "unattributed": A.unattributed(reports),
        "quotas": A.quotas(reports), "per_article": A.per_article_quota(reports),
        "margin_vs_setsize": A.margin_by_setsize(reports),
        "diameter_vs_nominal": A.diameter_vs_nominal(reports), "true_rank": A.true_rank_buckets(reports),
        "decision_per_article": A.decision_per_article(reports),
        "z_per_feature": A.z_per_feature(reports, params.max_z_accept),
        "prefilter_funnel": A.prefilter_funnel(reports), "kill_view": A.kill_view(reports),
        "test_vs_enroll": A.test_vs_enroll(reports), "drift": A.drift_spread(reports),
        "cross_section": A.cross_section(reports, params),
    }
    if articles is not None:
        out["position_errors"] = A.position_errors(reports, articles, params.camera_height_mm)
    if stats is not None:
        out["discriminability"] = A.discriminability(A.cooccurring_pairs(reports), stats, params.floors)
    return out


def run_analysis(reports: DataFrame, out_dir: str, run_id: str, params: Params | None = None,
                 articles: DataFrame | None = None, stats: DataFrame | None = None) -> dict[str, str]:
    """Write all sections under the run; a section without rows is named as skipped.

    Returns section -> 'written' or 'skipped: no input'. Existing runs are never
    overwritten.
    """
    params = params or Params()
    state = {}
    for name, df in sections(reports, params, articles, stats).items():
        path = f"{out_dir}/{run_id}/{name}"
        df.write.mode("errorifexists").parquet(path)
        empty = df.sparkSession.read.schema(df.schema).parquet(path).limit(1).count() == 0
        state[name] = "skipped: no input" if empty else "written"
    return state


def regression_check(golden: DataFrame, fresh: DataFrame, baseline: DataFrame, *,
                     accepted: DataFrame | None = None, accept_drift: bool = False
                     ) -> tuple[DataFrame, DataFrame]:
    """(per-image results, findings) of a tier-2 replay against its goldens and baseline."""
    results = X.compare_tier2(golden, fresh, accepted)
    findings = gates.check_against_baseline(results, X.side_quotas(fresh), baseline,
                                            accept_drift=accept_drift)
    return results.select("sha8", "band", F.size("diffs").alias("n_diffs")), findings
