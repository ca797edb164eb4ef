"""Enrollment statistics and diagnostics.

A *shot* row has an article key, the scalar columns of a measurement and its
vectors. Everything per article is an aggregate with map-side combine, joined
back where a row needs it; no window spans an article, which may be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import distances as dist
from .order_stats import MEDIAN, _null_safe_join, loo_median, quantiles

ARTICLE = "article_number"


def sample_std(value: str | Column) -> Column:
    """Sample deviation, 0 for one row. Merging partial moments can leave a residue
    of rounding where all values are equal, so equality is asked for directly."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(F.stddev_samp(c))


# --- scalars ----------------------------------------------------------------

def scalar_long(shots: DataFrame, keys: Sequence[str] = (ARTICLE,),
                extra: dict[str, Column] | None = None) -> DataFrame:
    """keys, feature, value rows of all scalars (missing values left out)."""
    cols = {f: dist.scalar_value(f) for f in C.SCALAR_FEATURES} | (extra or {})
    items = F.array(*[F.struct(F.lit(f).alias("feature"), c.cast("double").alias("value"))
                      for f, c in cols.items()])
    return shots.select(*keys, F.inline(items)).where("value is not null")


def scalar_stats(shots: DataFrame) -> DataFrame:
    """article, feature, n, mean, std: sample spread, 0 for a single shot."""
    return scalar_long(shots).groupBy(ARTICLE, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        sample_std("value").alias("std"))


# --- vectors ----------------------------------------------------------------

def vector_long(shots: DataFrame, keys: Sequence[str] = (ARTICLE,)) -> DataFrame:
    """keys, feature, vec rows; missing and empty vectors left out."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(src).alias("vec"))
                      for f, (src, _) in dist.REGISTRY.items()])
    return shots.select(*keys, F.inline(items)).where("vec is not null and size(vec) > 0")


def vector_lengths(rows: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Longest length of each vector column (0: none), from one aggregate."""
    columns = list(columns or sorted({src for src, _ in dist.REGISTRY.values()}))
    found = rows.agg(*[F.max(F.size(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: max(n or 0, 0) for c, n in zip(columns, found)}


def mean_of(vec: Column, n: int) -> Column:
    """Aggregate: the element-wise mean of vectors of up to ``n`` elements. Nothing is exploded."""
    return F.array(*[F.avg(F.get(vec, i)) for i in range(n)]) if n else F.array().cast("array<double>")


def rms_of(vec: Column, n: int) -> Column:
    """Aggregate: the element-wise root mean square."""
    return F.array(*[F.sqrt(F.avg(F.get(vec, i) * F.get(vec, i))) for i in range(n)]) if n else F.array().cast("array<double>")


def _one_length(mean: Column, lo: Column, hi: Column) -> Column:
    """A mean cut to the vectors' length; NULL where lengths differ or there are none."""
    return F.when((lo == hi) & (lo > 0), F.slice(mean, 1, lo))


def vector_mean(vectors: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean; groups with vectors of different lengths are dropped."""
    n = vector_lengths(vectors, [vec])[vec]
    g = vectors.groupBy(*keys).agg(mean_of(F.col(vec), n).alias("_m"), F.min(F.size(vec)).alias("_lo"), F.max(F.size(vec)).alias("_hi"))
    return g.select(*keys, _one_length(F.col("_m"), F.col("_lo"), F.col("_hi")).alias("proto")).where("proto is not null")


def rms(d: Column) -> Column:
    return F.sqrt(F.avg(d * d))


def distance_to(feature: Column, vec: Column, proto: Column) -> Column:
    """Distance chosen by the feature name in the row."""
    out = None
    for f in dist.REGISTRY:
        d = dist.proto_distance(f, vec, proto)
        out = F.when(feature == f, d) if out is None else out.when(feature == f, d)
    return out


def means(shots: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """One row per article from one aggregate: n_shots, and per feature n_, then m_ and s_ (scalars) or p_ (plain mean vector).

    ``lengths`` (longest vector per column) saves the pass that finds it.
    """
    lengths = lengths or vector_lengths(shots)
    aggs, out = [F.count(F.lit(1)).alias("n_shots")], [F.col(ARTICLE), F.col("n_shots")]
    for f in C.SCALAR_FEATURES:
        c = dist.scalar_value(f).cast("double")
        aggs += [F.count(c).alias(f"n_{f}"), F.avg(c).alias(f"m_{f}"), sample_std(c).alias(f"s_{f}")]
        out += [F.col(f"n_{f}"), F.col(f"m_{f}"), F.when(F.col(f"n_{f}") > 0, F.coalesce(f"s_{f}", F.lit(0.0))).alias(f"s_{f}")]
    for f, (src, _) in dist.REGISTRY.items():
        v = F.when(F.size(src) > 0, F.col(src))
        aggs += [F.count(v).alias(f"n_{f}"), F.min(F.size(v)).alias(f"_lo_{f}"), F.max(F.size(v)).alias(f"_hi_{f}"),
                 mean_of(v, lengths[src]).alias(f"_p_{f}")]
        out += [F.col(f"n_{f}"), _one_length(F.col(f"_p_{f}"), F.col(f"_lo_{f}"), F.col(f"_hi_{f}")).alias(f"p_{f}")]
    return shots.groupBy(ARTICLE).agg(*aggs).select(*out)


def prototypes(shots: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """article, feature, proto: the plain mean, before any renormalisation."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"p_{f}").alias("proto")) for f in dist.REGISTRY])
    return means(shots, lengths).select(ARTICLE, F.inline(rows)).where("proto is not null")


def renormalise(feature: Column, proto: Column) -> Column:
    total = F.aggregate(proto, F.lit(0.0), lambda a, x: a + x)
    return F.when(feature.isin(*C.HIST_FEATURES) & (total > 0),
                  F.transform(proto, lambda x: x / total)).otherwise(proto)


def _spreads(shots: DataFrame, wide: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """article, n_ and s_ per vector feature: RMS distance of the shots to the mean vectors p_ of ``wide``."""
    protos = wide.select(ARTICLE, *[f"p_{f}" for f in dist.REGISTRY])
    d = {f: dist.proto_distance(f, F.col(src), F.col(f"p_{f}"), lengths[src]).alias(f"_d_{f}")
         for f, (src, _) in dist.REGISTRY.items()}
    per_shot = shots.select(ARTICLE, *{src for src, _ in dist.REGISTRY.values()}).join(protos, ARTICLE).select(ARTICLE, *d.values())
    aggs = []
    for f in d:
        n = F.count(f"_d_{f}")
        aggs += [n.alias(f"n_{f}"), F.when(n < 2, F.lit(0.0)).otherwise(rms(F.col(f"_d_{f}"))).alias(f"s_{f}")]
    return per_shot.groupBy(ARTICLE).agg(*aggs)


def prototype_spread(shots: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """article, feature, n, spread: RMS distance to the plain mean, 0 for one shot.

    Shots meet the five prototypes of their article in one row; what is made long in the end is a row per article.
    """
    lengths = lengths or vector_lengths(shots)
    g = _spreads(shots, means(shots, lengths), lengths)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"s_{f}").alias("spread"))
                     for f in dist.REGISTRY])
    return g.select(ARTICLE, F.inline(rows)).where("n > 0")


def stats_wide(shots: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """One row per article, the form scoring joins: n_shots, m_*, s_*, p_*.

    The spread comes from the plain mean; the prototype is renormalised.
    """
    return _wide(shots, lengths).drop(*[f"n_{f}" for f in C.ALL_FEATURES])


def _wide(shots: DataFrame, lengths: dict[str, int] | None) -> DataFrame:
    lengths = lengths or vector_lengths(shots)
    wide = means(shots, lengths)
    spread = _spreads(shots, wide, lengths).select(
        ARTICLE, *[F.when(F.col(f"n_{f}") > 0, F.col(f"s_{f}")).alias(f"s_{f}") for f in dist.REGISTRY],
        *[F.col(f"n_{f}").alias(f"_n_{f}") for f in dist.REGISTRY])
    both = wide.drop(*[f"n_{f}" for f in dist.REGISTRY]).join(spread, ARTICLE, "left")
    return both.withColumns({f"p_{f}": renormalise(F.lit(f), F.col(f"p_{f}")) for f in dist.REGISTRY}).withColumnsRenamed(
        {f"_n_{f}": f"n_{f}" for f in dist.REGISTRY})


def stats_long(shots: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """article, feature, n, mean, std, proto for all features an article has."""
    double, vector = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"m_{f}").alias("mean"),
                     F.col(f"s_{f}").alias("std"), vector.alias("proto")) for f in C.SCALAR_FEATURES]
    rows += [F.struct(F.lit(f).alias("feature"), F.coalesce(f"n_{f}", F.lit(0)).alias("n"), double.alias("mean"),
                      F.col(f"s_{f}").alias("std"), F.col(f"p_{f}").alias("proto")) for f in C.PROTO_FEATURES]
    return _wide(shots, lengths).select(ARTICLE, F.inline(F.array(*rows))).where("n > 0")


# --- mergeable form ---------------------------------------------------------

_LAB, _HU = ("delta_e_center", "delta_e_rim"), "hu_log"


def _shares(vec: Column) -> Column:
    """sqrt(v / sum v) per bin of a histogram read as 32-bit floats; zeros where it is empty."""
    total = dist.mass(vec)
    return F.transform(dist.roots(vec), lambda x: F.when(total > 0, x / F.sqrt(F.when(total > 0, total))).otherwise(0.0))


def moments(shots: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """One row per article that merges with others of the same article: counts, sums and centred squares.

    Scalars: n, mean, sum of squares about it, least and greatest value. Vectors: n, least and greatest length, mean;
    for Lab vectors the sum of squares about it; for histograms the mean of the root shares, in which
    the squared distance to any histogram is linear.
    """
    lengths = lengths or vector_lengths(shots)
    aggs = [F.count(F.lit(1)).alias("n_shots")]
    for f in C.SCALAR_FEATURES:
        c = dist.scalar_value(f).cast("double")
        aggs += [F.count(c).alias(f"n_{f}"), F.avg(c).alias(f"m_{f}"), (F.var_pop(c) * F.count(c)).alias(f"q_{f}"),
                 F.min(c).alias(f"lo_{f}"), F.max(c).alias(f"hi_{f}")]
    shares = {f"_r_{f}": F.when(F.size(dist.REGISTRY[f][0]) > 0, _shares(F.col(dist.REGISTRY[f][0]))) for f in C.HIST_FEATURES}
    for f, (src, _) in dist.REGISTRY.items():
        v, n = F.when(F.size(src) > 0, F.col(src)), lengths[src]
        aggs += [F.count(v).alias(f"n_{f}"), F.min(F.size(v)).alias(f"lo_{f}"), F.max(F.size(v)).alias(f"hi_{f}"),
                 mean_of(v, n).alias(f"m_{f}")]
        if f in _LAB:
            aggs.append(_total([F.coalesce(F.var_pop(F.get(v, i)), F.lit(0.0)) * F.count(v) for i in range(n)]).alias(f"q_{f}"))
        if f in C.HIST_FEATURES:
            aggs.append(mean_of(F.col(f"_r_{f}"), n).alias(f"r_{f}"))
    return shots.withColumns(shares).groupBy(ARTICLE).agg(*aggs)


def _total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def merged(rows: DataFrame, hu: DataFrame) -> DataFrame:
    """Statistics in long form from ``moments`` rows, and from the Hu vectors (article, hu_moments) for their spread."""
    lengths = vector_lengths(rows, [f"m_{f}" for f in dist.REGISTRY])
    lengths = {f: lengths[f"m_{f}"] for f in dist.REGISTRY}

    def mean(f: str, col: str) -> Column:
        return F.sum(F.col(col) * F.col(f"n_{f}")) / F.when(F.sum(f"n_{f}") > 0, F.sum(f"n_{f}"))

    def means_of(f: str, col: str) -> Column:
        n = F.when(F.col(f"n_{f}") > 0, F.col(f"n_{f}"))
        parts = [F.sum(F.get(col, i) * n) / F.sum(F.when(F.get(col, i).isNotNull(), n)) for i in range(lengths[f])]
        return F.array(*parts) if parts else F.array().cast("array<double>")

    aggs = [F.sum("n_shots").alias("n_shots")]
    for f in C.SCALAR_FEATURES:
        aggs += [F.sum(f"n_{f}").alias(f"n_{f}"), mean(f, f"m_{f}").alias(f"m_{f}"), F.sum(f"q_{f}").alias(f"q_{f}"),
                 F.min(f"lo_{f}").alias(f"lo_{f}"), F.max(f"hi_{f}").alias(f"hi_{f}")]
    for f in dist.REGISTRY:
        aggs += [F.sum(f"n_{f}").alias(f"n_{f}"), F.min(f"lo_{f}").alias(f"lo_{f}"), F.max(f"hi_{f}").alias(f"hi_{f}"),
                 means_of(f, f"m_{f}").alias(f"m_{f}")]
        if f in _LAB:
            aggs.append(F.sum(f"q_{f}").alias(f"q_{f}"))
        if f in C.HIST_FEATURES:
            aggs.append(means_of(f, f"r_{f}").alias(f"r_{f}"))
    whole = rows.groupBy(ARTICLE).agg(*aggs)
    # What the means of the parts add to the squares about the mean of all.
    mid = {f: F.col(f"_mid_{f}") for f in (*C.SCALAR_FEATURES, *_LAB)}
    joined = rows.join(whole.select(ARTICLE, *[F.col(f"m_{f}").alias(f"_mid_{f}") for f in mid]), ARTICLE)
    between = joined.groupBy(ARTICLE).agg(
        *[F.sum(F.col(f"n_{f}") * (F.col(f"m_{f}") - mid[f]) * (F.col(f"m_{f}") - mid[f])).alias(f"_b_{f}") for f in C.SCALAR_FEATURES],
        *[F.sum(F.col(f"n_{f}") * _total([F.coalesce((F.get(f"m_{f}", i) - F.get(mid[f], i)) * (F.get(f"m_{f}", i) - F.get(mid[f], i)), F.lit(0.0))
                                          for i in range(lengths[f])])).alias(f"_b_{f}") for f in _LAB])
    plain = whole.withColumns({f"m_{f}": _one_length(F.col(f"m_{f}"), F.col(f"lo_{f}"), F.col(f"hi_{f}")) for f in dist.REGISTRY})
    d = dist.proto_distance(_HU, F.col("hu_moments"), F.col(f"m_{_HU}"), lengths[_HU])
    spread = hu.join(plain.select(ARTICLE, f"m_{_HU}"), ARTICLE).groupBy(ARTICLE).agg(rms(d).alias("_s_hu"))
    g = plain.join(between, ARTICLE).join(spread, ARTICLE, "left")
    rows_out, none = [], F.lit(None)
    for f in C.SCALAR_FEATURES:
        n = F.col(f"n_{f}")
        s = F.when(F.col(f"lo_{f}") == F.col(f"hi_{f}"), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(F.col(f"q_{f}") + F.col(f"_b_{f}"), n - 1)))
        rows_out.append(F.struct(F.lit(f).alias("feature"), n.alias("n"), F.col(f"m_{f}").alias("mean"), F.coalesce(s, F.lit(0.0)).alias("std"),
                                 none.cast("array<double>").alias("proto")))
    for f in dist.REGISTRY:
        n, m = F.when(F.col(f"m_{f}").isNotNull(), F.col(f"n_{f}")).otherwise(F.lit(0)), F.col(f"m_{f}")
        if f in _LAB:
            s = F.sqrt((F.col(f"q_{f}") + F.col(f"_b_{f}")) / F.when(n > 0, n))
        elif f in C.HIST_FEATURES:
            overlap = F.aggregate(F.zip_with(_shares(m), F.slice(f"r_{f}", 1, F.size(m)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            s = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - overlap))
        else:
            s = F.col("_s_hu")
        rows_out.append(F.struct(F.lit(f).alias("feature"), n.alias("n"), none.cast("double").alias("mean"),
                                 F.when(n < 2, F.lit(0.0)).otherwise(s).alias("std"), renormalise(F.lit(f), m).alias("proto")))
    return g.select(ARTICLE, F.inline(F.array(*rows_out))).where("n > 0")


# --- robust form ------------------------------------------------------------

def _vector_median(shots: DataFrame) -> DataFrame:
    long = vector_long(shots)
    per_pos = long.select(ARTICLE, "feature", F.posexplode("vec"))
    med = quantiles(per_pos, [ARTICLE, "feature", "pos"], "col", {"m": MEDIAN})
    ok = long.groupBy(ARTICLE, "feature").agg(
        F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"),
        F.count(F.lit(1)).alias("n")).where("lo = hi")
    arr = med.groupBy(ARTICLE, "feature").agg(
        F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_p"))
    return arr.join(ok, [ARTICLE, "feature"]).select(
        ARTICLE, "feature", "n", F.col("_p.m").alias("proto"))


def robust_stats(shots: DataFrame) -> DataFrame:
    """Median and scaled MAD for scalars, median prototype and distance for vectors."""
    sca = scalar_long(shots)
    med = quantiles(sca, [ARTICLE, "feature"], "value", {"mean": MEDIAN}, count="n")
    dev = sca.join(med, [ARTICLE, "feature"]).withColumn(
        "dev", F.abs(F.col("value") - F.col("mean")))
    mad = quantiles(dev, [ARTICLE, "feature"], "dev", {"mad": MEDIAN})
    scalars = med.join(mad, [ARTICLE, "feature"]).select(
        ARTICLE, "feature", "n", "mean",
        F.when(F.col("n") > 1, C.MAD_SCALE * F.col("mad")).otherwise(0.0).alias("std"),
        F.lit(None).cast("array<double>").alias("proto"))
    protos = _vector_median(shots)
    d = vector_long(shots).join(protos, [ARTICLE, "feature"]).withColumn(
        "d", distance_to(F.col("feature"), F.col("vec"), F.col("proto")))
    dm = quantiles(d, [ARTICLE, "feature"], "d", {"md": MEDIAN})
    vectors = protos.join(dm, [ARTICLE, "feature"]).select(
        ARTICLE, "feature", "n", F.lit(None).cast("double").alias("mean"),
        F.when(F.col("n") > 1, C.MAD_SCALE * F.col("md")).otherwise(0.0).alias("std"),
        renormalise(F.col("feature"), F.col("proto")).alias("proto"))
    return scalars.unionByName(vectors)


# --- floors -----------------------------------------------------------------

def floor_key(feature: Column) -> Column:
    return F.create_map(*[x for kv in C.FLOOR_KEYS.items() for x in map(F.lit, kv)])[feature]


def floor_samples(series: DataFrame, group: str = "series", ref: str = "ref") -> DataFrame:
    """group, floor_key, ref, value: scalars and distances to the series prototype.

    The two zones of a shared floor key are pooled by concatenation.
    """
    s = series.withColumn(ARTICLE, F.col(group))
    protos = prototypes(s).withColumn("proto", renormalise(F.col("feature"), F.col("proto")))
    d = vector_long(s, [ARTICLE, ref]).join(protos, [ARTICLE, "feature"]).select(
        ARTICLE, ref, "feature",
        distance_to(F.col("feature"), F.col("vec"), F.col("proto")).alias("value"))
    both = scalar_long(s, [ARTICLE, ref]).unionByName(d).where("value is not null")
    return both.select(F.col(ARTICLE).alias(group), F.col(ref), "feature",
                       floor_key(F.col("feature")).alias("floor_key"), "value")


def floor_estimate(samples: DataFrame, group: str = "series") -> DataFrame:
    scalar = F.col("floor_key").isin(*C.SCALAR_FEATURES)
    agg = samples.groupBy(group, "floor_key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        sample_std("value").alias("std"),
        rms(F.col("value")).alias("rms"), F.min("value").alias("minimum"),
        F.max("value").alias("maximum"))
    return agg.select(group, "floor_key", "n", "mean", "std",
                      F.when(scalar, F.col("std")).otherwise(F.col("rms")).alias("floor"),
                      "minimum", "maximum", (F.col("n") < C.MIN_FLOOR_N).alias("low_n_warning"))


def floor_outliers(samples: DataFrame, group: str = "series", ref: str = "ref") -> DataFrame:
    est = floor_estimate(samples, group).select(group, "floor_key", "mean", "std")
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    return (samples.join(est.where("std > 0"), [group, "floor_key"]).withColumn("z", z)
            .where(F.col("z") > C.OUTLIER_Z)
            .select(group, "floor_key", ref, "value", F.round("z", 2).alias("z")))


# --- leave-one-out diagnostics ----------------------------------------------

def loo_classic_z(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(x - mean of others) / sample std of others from group sums minus the own value."""
    g = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"),
                              F.var_pop(value).alias("_v"))
    j = _null_safe_join(df, g, list(keys), "left")
    n, x = F.col("_n"), F.col(value) - F.col("_m")          # centred: sums stay small
    others_mean = F.try_divide(-x, n - 1)
    ss = n * F.col("_v") - x * x - F.try_divide(x * x, n - 1)
    # A sum of squares at rounding level means the others are all equal.
    ss = F.when(ss > 1e-12 * n * F.col("_v"), ss)
    sd = F.sqrt(F.try_divide(ss, n - 2))
    return j.withColumn(out, F.when((n >= 3) & (sd > 0), (x - others_mean) / sd)).drop(
        "_n", "_m", "_v")


def loo_robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(x - median of others) / (1.4826 MAD of others), NULL when that MAD is 0.

    The median of the others takes at most three values per group. For each of them
    the deviations of the whole group form one more group whose leave-one-out median
    is the MAD asked for.
    """
    med = loo_median(df, keys, value, "_lmed")
    centers = med.where("_lmed is not null").select(*keys, "_lmed").distinct()
    dev = (_null_safe_join(df.select(*keys, value), centers, list(keys))
           .withColumn("_dev", F.abs(F.col(value) - F.col("_lmed"))))
    mads = loo_median(dev, [*keys, "_lmed"], "_dev", "_lmad").select(
        *keys, "_lmed", "_dev", "_lmad").distinct()
    own = med.withColumn("_dev", F.abs(F.col(value) - F.col("_lmed")))
    j = _null_safe_join(own, mads, [*keys, "_lmed", "_dev"], "left")
    z = (F.col(value) - F.col("_lmed")) / (C.MAD_SCALE * F.col("_lmad"))
    return j.withColumn(out, F.when(F.col("_lmad") > 0, z)).drop("_lmed", "_dev", "_lmad")


def global_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds z_classic and z_robust of a distance set; NULL without spread."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("_m"), sample_std(value).alias("_s"))
    med = quantiles(df, keys, value, {"_med": MEDIAN})
    j = _null_safe_join(_null_safe_join(df, g, list(keys), "left"), med, list(keys), "left")
    j = j.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(j, keys, "_dev", {"_mad": MEDIAN})
    j = _null_safe_join(j, mad, list(keys), "left")
    x = F.col(value)
    return (j.withColumn("z_classic", F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s")))
            .withColumn("z_robust", F.when(F.col("_mad") > 0, (x - F.col("_med"))
                                           / (C.MAD_SCALE * F.col("_mad"))))
            .drop("_m", "_s", "_med", "_dev", "_mad"))


def loo_prototype_distance(shots: DataFrame, shot_id: str) -> DataFrame:
    """article, feature, shot, d: distance of each vector to the mean of the others.

    Needs at least 3 vectors of one length; uses (n * mean - own) / (n - 1).
    """
    long = vector_long(shots, [ARTICLE, shot_id])
    n = long.groupBy(ARTICLE, "feature").agg(F.count(F.lit(1)).alias("n"))
    protos = vector_mean(long, [ARTICLE, "feature"]).join(n, [ARTICLE, "feature"]).where("n >= 3")
    nn = F.col("n")
    others = F.zip_with("proto", "vec", lambda m, x: (m * nn - x) / (nn - 1))
    j = long.join(protos, [ARTICLE, "feature"])
    return j.select(ARTICLE, "feature", shot_id,
                    distance_to(F.col("feature"), F.col("vec"), others).alias("d"))


def enrollment_sheet(shots: DataFrame, shot_id: str, stored: DataFrame | None = None,
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """Per article and feature: spread table, the most extreme shot and its z values."""
    keys = [ARTICLE, "feature"]
    sca = scalar_long(shots, [ARTICLE, shot_id], extra)
    enough = sca.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    sca = sca.join(enough, keys, "left_semi")
    sca = loo_robust_z(loo_classic_z(sca, keys, "value", "z_classic"), keys, "value",
                       "z_robust")
    vec = loo_prototype_distance(shots, shot_id).withColumnRenamed("d", "value")
    vec = global_z(vec.where("value is not null"), keys, "value")
    cols = [*keys, shot_id, "value", "z_classic", "z_robust"]
    rows = sca.select(*cols, F.lit("scalar").alias("kind")).unionByName(
        vec.select(*cols, F.lit("vector").alias("kind")))
    has_robust = F.max(F.col("z_robust").isNotNull().cast("int"))

    def ext(z: str) -> Column:
        return F.max(F.when(F.col(z).isNotNull(), F.struct(
            F.abs(F.col(z)).alias("a"), (-F.col(shot_id)).alias("t"),
            F.col("z_classic").alias("zc"), F.col("z_robust").alias("zr"))))

    agg = rows.groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        sample_std("value").alias("std"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"),
        has_robust.alias("_hr"), ext("z_robust").alias("_er"), ext("z_classic").alias("_ec"))
    pick = F.when(F.col("_hr") == 1, F.col("_er")).otherwise(F.col("_ec"))
    out = agg.withColumn("_e", pick).select(
        *keys, "kind", "n", "mean", "std", "vmin", "vmax",
        (F.col("vmax") - F.col("vmin")).alias("span"),
        (-F.col("_e.t")).alias("extreme_shot"), F.col("_e.zc").alias("z_classic_extreme"),
        F.col("_e.zr").alias("z_robust_extreme"))
    if stored is not None:
        out = out.join(stored.select(*keys, F.col("std").alias("stored_sigma")), keys, "left")
    return out


def conspicuity(sheet: DataFrame) -> DataFrame:
    """How many features each shot is the extreme one of."""
    return sheet.where("extreme_shot is not null").groupBy(ARTICLE, "extreme_shot").agg(
        F.count(F.lit(1)).alias("n_features"))
