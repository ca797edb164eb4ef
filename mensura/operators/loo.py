"""Leave-one-out scoring: each shot against its own article without it.

Everything is linear in the shots: the statistics of the others are the totals of
the article minus the own share.

* scalars and Lab vectors: squared spread loses n/(n-1) times the own deviation;
* histograms: the squared distance is 1 - sum sqrt(v * m), linear in sqrt(v);
* Hu vectors (mean absolute difference) are linear wherever the sign of ``v - m``
  cannot change when one shot is left out. Only the few shots close to the mean
  need to be paired with every left-out shot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import distances as dist
from ..params import Params
from . import enroll
from .joins import prefilter
from .scoring import RID, feature_distances

HU_DIM = 7          # number of Hu invariants


def _vec_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _sq(a: Column, b: Column) -> Column:
    return _vec_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _root_share(vec: Column) -> Column:
    """sqrt(v / sum v) per bin of the 32-bit histogram; zeros where it is empty."""
    v = vec.cast("array<float>").cast("array<double>")
    s = _vec_sum(v)
    return F.transform(v, lambda x: F.when(s > 0, F.sqrt(x / F.when(s > 0, s))).otherwise(0.0))


def article_basis(shots: DataFrame) -> DataFrame:
    """Per article: full statistics plus what leave-one-out needs (q_, b_ columns)."""
    full = enroll.stats_wide(shots)
    long = enroll.vector_long(shots)
    n = long.groupBy(enroll.ARTICLE, "feature").agg(F.count(F.lit(1)).alias("n"))
    plain = enroll.prototypes(shots)
    roots = enroll.vector_mean(
        long.where(F.col("feature").isin(*C.HIST_FEATURES))
        .withColumn("vec", _root_share(F.col("vec"))), [enroll.ARTICLE, "feature"]
    ).withColumnRenamed("proto", "root")
    basis = n.join(plain, [enroll.ARTICLE, "feature"]).join(
        roots, [enroll.ARTICLE, "feature"], "left")
    sca = enroll.scalar_long(shots).groupBy(enroll.ARTICLE, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("vp"))
    aggs = [F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{p}_{f}")
            for f in C.PROTO_FEATURES for p, c in (("bn", "n"), ("bp", "proto"), ("br", "root"))
            if not (p == "br" and f not in C.HIST_FEATURES)]
    vec = basis.groupBy(enroll.ARTICLE).agg(*aggs)
    sc = sca.groupBy(enroll.ARTICLE).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{p}_{f}")
          for f in C.SCALAR_FEATURES for p, c in (("bn", "n"), ("bv", "vp"))])
    return full.join(sc, enroll.ARTICLE, "left").join(vec, enroll.ARTICLE, "left")


def hu_spread(shots: DataFrame, shot_id: str, min_shots: int = 2) -> DataFrame:
    """Per shot the RMS mean-absolute distance of the *others* to their own mean."""
    d = range(HU_DIM)
    base = shots.where(F.size("hu_moments") == HU_DIM).select(
        enroll.ARTICLE, shot_id, F.col("hu_moments").alias("v"))
    g = base.groupBy(enroll.ARTICLE).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("v", k)) for k in d]).alias("mu"))
    g = g.where(F.col("n") >= min_shots)
    rows = base.join(g, enroll.ARTICLE).withColumn(
        "e", F.zip_with("v", "mu", lambda x, m: x - m)).drop("v", "mu")
    reach = rows.groupBy(enroll.ARTICLE).agg(F.array(
        *[F.max(F.abs(F.get("e", k))) / F.max(F.col("n") - 1) for k in d]).alias("rho"))
    rows = rows.join(reach, enroll.ARTICLE)
    # A component that never varies has no sign to change.
    safe = F.forall(F.arrays_zip("e", "rho"), lambda p: (F.abs(p["e"]) > p["rho"])
                    | (p["rho"] == 0.0))
    rows = rows.withColumn("far", safe).withColumn(
        "s", F.transform("e", lambda x: F.signum(x))).withColumn(
        "c", _vec_sum(F.transform("e", lambda x: F.abs(x)))).withColumn(
        "delta", F.transform("e", lambda x: -x / (F.col("n") - 1)))
    far = F.col("far")
    pairs = [(k, m) for k in d for m in d if k <= m]
    totals = rows.groupBy(enroll.ARTICLE).agg(
        F.coalesce(F.sum(F.when(far, F.col("c") * F.col("c"))), F.lit(0.0)).alias("c2"),
        F.array(*[F.coalesce(F.sum(F.when(far, F.col("c") * F.get("s", k))), F.lit(0.0))
                  for k in d]).alias("cs"),
        F.array(*[F.coalesce(F.sum(F.when(far, F.get("s", k) * F.get("s", m))), F.lit(0.0))
                  for k, m in pairs]).alias("ss"))
    near = rows.where(~far).select(enroll.ARTICLE, F.col(shot_id).alias("other"),
                                   F.col("e").alias("other_e"))
    near_sum = (rows.select(enroll.ARTICLE, shot_id, "delta").join(near, enroll.ARTICLE)
                .where(F.col(shot_id) != F.col("other"))
                .withColumn("t", _vec_sum(F.zip_with("other_e", "delta",
                                                     lambda x, q: F.abs(x - q))))
                .groupBy(enroll.ARTICLE, shot_id).agg(F.sum(F.col("t") * F.col("t")).alias("near")))
    j = rows.join(totals, enroll.ARTICLE).join(near_sum, [enroll.ARTICLE, shot_id], "left")
    dl = [F.get("delta", k) for k in d]
    lin = sum((dl[k] * F.get("cs", k) for k in d), F.lit(0.0))
    quad = sum(((1.0 if k == m else 2.0) * dl[k] * dl[m] * F.get("ss", i)
                for i, (k, m) in enumerate(pairs)), F.lit(0.0))
    own_lin = F.col("c") - sum((F.get("s", k) * dl[k] for k in d), F.lit(0.0))
    own = F.when(far, own_lin * own_lin).otherwise(0.0)
    total = F.col("c2") - 2.0 * lin + quad - own + F.coalesce("near", F.lit(0.0))
    return j.select(enroll.ARTICLE, shot_id, F.sqrt(
        F.greatest(total, F.lit(0.0)) / (HU_DIM * HU_DIM * (F.col("n") - 1))).alias("loo_s_hu_log"))


def loo_rows(shots: DataFrame, articles: DataFrame, params: Params | Sequence[Params],
             min_shots: int = 13, basis: DataFrame | None = None) -> DataFrame:
    """Candidate rows of every shot of an article with ``min_shots`` shots.

    ``shots`` needs report_id, article_number and the measurement columns. The own
    article is scored with the statistics of the other shots, all others in full.
    """
    ps = [params] if isinstance(params, Params) else list(params)
    basis = article_basis(shots) if basis is None else basis
    counts = shots.groupBy(enroll.ARTICLE).agg(F.count(F.lit(1)).alias("_n"))
    eligible = counts.where(F.col("_n") >= min_shots).drop("_n")
    hu = hu_spread(shots, RID).drop(enroll.ARTICLE)
    cases = (shots.join(eligible, enroll.ARTICLE, "left_semi").join(hu, RID, "left")
             .withColumnRenamed(enroll.ARTICLE, "truth"))
    stock = articles.select("article_number", "name", "diameter_mm", "width_mm", "depth_mm",
                            "height_mm")
    pairs = prefilter(cases, stock, max(p.tol_mm for p in ps), ps[0].area_tol_pct,
                      ps[0].camera_height_mm)
    j = pairs.join(basis, enroll.ARTICLE, "left")
    own = F.col("truth") == F.col("article_number")
    cols: dict[str, Column] = {"n_shots": F.when(own, F.col("n_shots") - 1).otherwise(F.col("n_shots"))}
    for f in C.SCALAR_FEATURES:
        x, n, m = dist.scalar_value(f), F.col(f"bn_{f}"), F.col(f"m_{f}")
        held = own & x.isNotNull()
        dev2 = (x - m) * (x - m)
        ss = n * F.col(f"bv_{f}") - F.try_divide(n * dev2, n - 1)
        sd = F.when(n - 1 > 1, F.sqrt(F.try_divide(F.greatest(ss, F.lit(0.0)), n - 2))).otherwise(0.0)
        cols[f"m_{f}"] = F.when(held, F.try_divide(n * m - x, n - 1)).otherwise(m)
        cols[f"s_{f}"] = F.when(held, sd).otherwise(F.col(f"s_{f}"))
    for f in C.PROTO_FEATURES:
        vec, n, mean = F.col(dist.REGISTRY[f][0]), F.col(f"bn_{f}"), F.col(f"bp_{f}")
        held = own & vec.isNotNull() & (F.size(vec) == F.size(mean)) & (n > 1)
        rest = F.zip_with(mean, vec, lambda m, x: (m * n - x) / (n - 1))
        if f in ("delta_e_center", "delta_e_rim"):
            q = n * F.col(f"s_{f}") * F.col(f"s_{f}")
            left = q - n * _sq(vec, mean) / (n - 1)
            s = F.sqrt(F.greatest(left, F.lit(0.0)) / (n - 1))
        elif f in C.HIST_FEATURES:
            others = F.zip_with(F.col(f"br_{f}"), _root_share(vec), lambda t, x: t * n - x)
            overlap = _vec_sum(F.zip_with(_root_share(rest), others, lambda a, b: a * b))
            s = F.sqrt(F.greatest((n - 1) - overlap, F.lit(0.0)) / (n - 1))
        else:
            s = F.col("loo_s_hu_log")
        s = F.when(n - 1 < 2, F.lit(0.0)).otherwise(s)
        stored = enroll.renormalise(F.lit(f), rest)
        cols[f"p_{f}"] = F.when(held, stored).otherwise(F.col(f"p_{f}"))
        cols[f"s_{f}"] = F.when(held, s).otherwise(F.col(f"s_{f}"))
    helpers = [c for c in basis.columns if c[:3] in ("bn_", "bv_", "bp_", "br_")]
    return feature_distances(j.withColumns(cols).drop(*helpers, "loo_s_hu_log"))
