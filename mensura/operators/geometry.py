"""Contours and width profiles on point tables.

A point row is (shape, pos, x, y). One shape is one outline from one image, so its
points are bounded by the image size; windows and arrays per shape stay small, and
the shapes themselves spread over the cluster. What spans shapes (mean and median
profiles) is aggregated with map-side combine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import MEDIAN, quantiles

S = "shape_id"


def thin_points(points: DataFrame, n: int = 400) -> DataFrame:
    """Every step-th point, step = max(1, count // n); ``pos`` starts at 1."""
    count = F.count(F.lit(1)).over(Window.partitionBy(S))
    step = F.greatest(F.lit(1), F.floor(count / n))
    return points.withColumn("_s", step).where((F.col("pos") - 1) % F.col("_s") == 0).drop("_s")


def edges(points: DataFrame) -> DataFrame:
    """Each point with its successor on the closed outline (x1, y1)."""
    w = Window.partitionBy(S).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {f"{c}1": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y")}
    return points.withColumns(nxt)


def densify(points: DataFrame, step: float = 0.5) -> DataFrame:
    """Points spaced evenly along every edge, k = max(1, int(length / step))."""
    e = edges(points)
    d = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x"))
               + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")))
    e = e.withColumn("_k", F.greatest(F.lit(1), F.floor(d / step)).cast("int"))
    e = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    t = F.col("j") / F.col("_k")
    return e.select(S, "pos", "j", (F.col("x") + (F.col("x1") - F.col("x")) * t).alias("x"),
                    (F.col("y") + (F.col("y1") - F.col("y")) * t).alias("y"))


def pca_axes(points: DataFrame) -> DataFrame:
    """shape, cx, cy, ux, uy (main axis), vx, vy (minor), closed form of the 2 x 2 case."""
    g = points.groupBy(S).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"),
                              F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    half = (F.col("a") - F.col("b")) / 2.0
    lam = (F.col("a") + F.col("b")) / 2.0 + F.sqrt(half * half + F.col("c") * F.col("c"))
    px = F.when(F.col("c") != 0, lam - F.col("b")).otherwise(F.when(F.col("a") >= F.col("b"), 1.0).otherwise(0.0))
    py = F.when(F.col("c") != 0, F.col("c")).otherwise(F.when(F.col("a") >= F.col("b"), 0.0).otherwise(1.0))
    g = g.withColumns({"_px": px, "_py": py}).withColumn("_n", F.sqrt(F.col("_px") * F.col("_px") + F.col("_py") * F.col("_py")))
    ux, uy = F.col("_px") / F.col("_n"), F.col("_py") / F.col("_n")
    return g.select(S, "cx", "cy", ux.alias("ux"), uy.alias("uy"), (-uy).alias("vx"), ux.alias("vy"))


def project(points: DataFrame, axes: DataFrame, mm: float = 1.0) -> DataFrame:
    """Adds t (along the main axis) and n (across), in mm from the centroid."""
    j = points.join(axes, S)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return j.withColumns({"t": (dx * F.col("ux") + dy * F.col("uy")) * mm,
                          "n": (dx * F.col("vx") + dy * F.col("vy")) * mm})


def extents(points: DataFrame, mm: float = 1.0, step: float = 0.5) -> DataFrame:
    """ext_full, ext_p99, ext_p98 along and lat_p98 across; 0 below 5 points."""
    dense = densify(points, step)
    axes = pca_axes(dense)
    full = project(points, axes, mm).groupBy(S).agg(
        (F.max("t") - F.min("t")).alias("_f"), F.count(F.lit(1)).alias("_n"))
    qs = F.array(*[F.lit(q) for q in (0.005, 0.995, 0.01, 0.99)])
    pct = project(dense, axes, mm).groupBy(S).agg(F.percentile("t", qs).alias("_t"), F.percentile("n", qs).alias("_m"))

    def ok(c: Column) -> Column:
        return F.when(F.col("_n") >= 5, c).otherwise(0.0)

    return full.join(pct, S).select(
        S, ok(F.col("_f")).alias("ext_full"), ok(F.get("_t", 1) - F.get("_t", 0)).alias("ext_p99"),
        ok(F.get("_t", 3) - F.get("_t", 2)).alias("ext_p98"), ok(F.get("_m", 3) - F.get("_m", 2)).alias("lat_p98"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain); one or two points stay as they are."""
    xy = np.unique(xy, axis=0)                      # sorted by x, then y
    if len(xy) < 3:
        return xy
    chains = []
    for points in (xy.tolist(), xy[::-1].tolist()):
        chain: list = []
        for p in points:
            while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                      - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def _width(h: np.ndarray) -> float:
    """Largest distance of two hull corners, by rotating calipers."""
    n = len(h)
    if n < 2:
        return 0.0
    if n == 2:
        return float(np.hypot(*(h[1] - h[0])))
    x, y = h[:, 0].tolist(), h[:, 1].tolist()
    best, j = 0.0, 1
    for i in range(n):
        k = (i + 1) % n
        ex, ey = x[k] - x[i], y[k] - y[i]
        for _ in range(n):                          # the farthest corner from the edge i, k only moves on
            m = (j + 1) % n
            here, there = ex * (y[j] - y[i]) - ey * (x[j] - x[i]), ex * (y[m] - y[i]) - ey * (x[m] - x[i])
            for t in ((j, m) if there == here else (j,)):
                for s in (i, k):
                    best = max(best, (x[t] - x[s]) ** 2 + (y[t] - y[s]) ** 2)
            if there <= here:
                break
            j = m
    return math.sqrt(best)


def convex_hull(points: DataFrame) -> DataFrame:
    """shape_id, x, y: corners of each shape's hull. Points without both coordinates don't count.

    The hull of hulls is the hull: each batch of a task keeps only the corners of what it holds of a shape,
    so what is exchanged and meets in the end are corners, however many points a shape has.
    """
    schema = points.select(S, F.col("x").cast("double"), F.col("y").cast("double")).schema

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        h = _hull(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({S: [rows[S].iloc[0]] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(S, sort=False, dropna=False):
                yield corners(rows)

    clean = points.select(S, F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null")
    return clean.mapInPandas(partial, schema).groupBy(S).applyInPandas(corners, schema)


def point_set_diameter(points: DataFrame, circle: DataFrame | None = None, tol: float = 0.5) -> DataFrame:
    """Largest distance of two points, and whether a given circle has that diameter.

    The two ends are corners of the convex hull; calipers walk around it once, so a round shape costs
    no more than any other.
    """
    kind = points.schema[S].dataType.simpleString()

    def widest(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({S: [rows[S].iloc[0]], "diameter": [_width(_hull(rows[["x", "y"]].to_numpy()))]})

    out = convex_hull(points).groupBy(S).applyInPandas(widest, f"{S} {kind}, diameter double")
    if circle is not None:
        out = out.join(circle.select(S, "circle_diameter"), S).withColumn(
            "two_point", F.abs(F.col("circle_diameter") - F.col("diameter")) <= tol)
    return out


def polygon_measures(points: DataFrame, mm: float = 1.0) -> DataFrame:
    """Area, perimeter, circularity, equivalent diameter and centroid of the outline."""
    e = edges(points)
    a = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    g = e.groupBy(S).agg(
        F.sum(a).alias("_a2"), F.sum(F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).alias("_p"),
        F.sum((F.col("x") + F.col("x1")) * a).alias("_mx"), F.sum((F.col("y") + F.col("y1")) * a).alias("_my"))
    area = F.abs(F.col("_a2")) / 2.0
    return g.select(
        S, (area * mm * mm).alias("area"), (F.col("_p") * mm).alias("perimeter"),
        F.coalesce(F.try_divide(4.0 * F.pi() * area, F.col("_p") * F.col("_p")), F.lit(0.0)).alias("circularity"),
        (2.0 * F.sqrt(area / F.pi()) * mm).alias("equiv_diameter"),
        F.try_divide(F.col("_mx"), 3.0 * F.col("_a2")).alias("centroid_x"),
        F.try_divide(F.col("_my"), 3.0 * F.col("_a2")).alias("centroid_y"))


def hu_moments_log(points: DataFrame) -> DataFrame:
    """shape, hu: seven Hu invariants of the polygon as -sign * log10.

    Moments are edge sums (Green), taken around the mean point so that they do not
    cancel.
    """
    c = points.groupBy(S).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    p = points.join(c, S).select(S, "pos", (F.col("x") - F.col("_cx")).alias("x"), (F.col("y") - F.col("_cy")).alias("y"))
    e = edges(p)
    x, y, u, v = (F.col(k) for k in ("x", "y", "x1", "y1"))
    a = x * v - u * y
    sums = {
        "m00": a / 2, "m10": a * (x + u) / 6, "m01": a * (y + v) / 6,
        "m20": a * (x * x + x * u + u * u) / 12, "m02": a * (y * y + y * v + v * v) / 12,
        "m11": a * (x * (2 * y + v) + u * (y + 2 * v)) / 24,
        "m30": a * (x + u) * (x * x + u * u) / 20, "m03": a * (y + v) * (y * y + v * v) / 20,
        "m21": a * (x * x * (3 * y + v) + 2 * x * u * (y + v) + u * u * (y + 3 * v)) / 60,
        "m12": a * (y * y * (3 * x + u) + 2 * y * v * (x + u) + v * v * (x + 3 * u)) / 60}
    g = e.groupBy(S).agg(*[F.sum(val).alias(k) for k, val in sums.items()])
    sign = F.signum("m00")
    g = g.select(S, *[(F.col(k) * sign).alias(k) for k in sums])
    m = {k: F.col(k) for k in sums}
    cx, cy = m["m10"] / m["m00"], m["m01"] / m["m00"]
    g = g.withColumns({"cx": cx, "cy": cy})
    cx, cy = F.col("cx"), F.col("cy")
    mu = {
        "n20": m["m20"] - cx * m["m10"], "n02": m["m02"] - cy * m["m01"], "n11": m["m11"] - cx * m["m01"],
        "n30": m["m30"] - 3 * cx * m["m20"] + 2 * cx * cx * m["m10"],
        "n03": m["m03"] - 3 * cy * m["m02"] + 2 * cy * cy * m["m01"],
        "n21": m["m21"] - 2 * cx * m["m11"] - cy * m["m20"] + 2 * cx * cx * m["m01"],
        "n12": m["m12"] - 2 * cy * m["m11"] - cx * m["m02"] + 2 * cy * cy * m["m10"]}
    order2, order3 = F.pow(m["m00"], F.lit(2.0)), F.pow(m["m00"], F.lit(2.5))
    g = g.withColumns({k: val / (order2 if k in ("n20", "n02", "n11") else order3) for k, val in mu.items()})
    n20, n02, n11, n30, n03, n21, n12 = (F.col(k) for k in ("n20", "n02", "n11", "n30", "n03", "n21", "n12"))
    p_, q_ = n30 + n12, n21 + n03
    r_, s_ = n30 - 3 * n12, 3 * n21 - n03
    hu = [n20 + n02, (n20 - n02) * (n20 - n02) + 4 * n11 * n11, r_ * r_ + s_ * s_, p_ * p_ + q_ * q_,
          r_ * p_ * (p_ * p_ - 3 * q_ * q_) + s_ * q_ * (3 * p_ * p_ - q_ * q_),
          (n20 - n02) * (p_ * p_ - q_ * q_) + 4 * n11 * p_ * q_,
          s_ * p_ * (p_ * p_ - 3 * q_ * q_) - r_ * q_ * (3 * p_ * p_ - q_ * q_)]
    g = g.select(S, F.array(*hu).alias("h"))
    return g.select(S, F.transform("h", lambda h: F.when(h == 0, 0.0).otherwise(
        -F.signum(h) * F.log10(F.abs(h)))).alias("hu"))


# --- width profiles ---------------------------------------------------------

def width_bins(points: DataFrame, mm: float = 1.0, step: float = 0.5) -> DataFrame:
    """shape, length, w: smoothed widths per 1-mm bin along the axis, as one array.

    Bins with fewer than 2 points are filled linearly; smoothing is a 3-bin mean with
    zero edges. Shapes of fewer than 5 bins or 3 filled bins drop out.
    """
    dense = densify(points, step)
    pr = project(dense, pca_axes(dense), mm)
    base = pr.groupBy(S).agg(F.min("t").alias("_t0"), (F.max("t") - F.min("t")).alias("length"),
                             F.count(F.lit(1)).alias("_np"))
    b = F.least(F.floor(F.col("t") - F.col("_t0")), F.floor("length")).cast("int")
    raw = pr.join(base, S).groupBy(S, "length", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("_c"), (F.max("n") - F.min("n")).alias("w"))
    got = raw.groupBy(S, "length").agg(F.sort_array(F.collect_list(F.when(
        F.col("_c") >= 2, F.struct("bin", "w")))).alias("g"))
    got = got.withColumn("nb", (F.floor("length") + 1).cast("int")).where("nb >= 5 and size(g) >= 3")

    def fill(i: Column) -> Column:
        left = F.element_at(F.filter("g", lambda p: p["bin"] <= i), -1)
        right = F.get(F.filter("g", lambda p: p["bin"] >= i), 0)
        gap = right["bin"] - left["bin"]
        inner = F.when(gap == 0, left["w"]).otherwise(
            left["w"] + (right["w"] - left["w"]) * (i - left["bin"]) / F.when(gap != 0, gap))
        return F.when(left.isNull(), right["w"]).when(right.isNull(), left["w"]).otherwise(inner)

    # try_element_at on an empty filter would be an error under ANSI mode
    def safe(i: Column) -> Column:
        first, last = F.get("g", 0), F.element_at("g", -1)
        return F.when(i <= first["bin"], first["w"]).when(i >= last["bin"], last["w"]).otherwise(fill(i))

    full = got.withColumn("f", F.transform(F.sequence(F.lit(0), F.col("nb") - 1), safe))
    zero = F.lit(0.0)
    smooth = F.transform("f", lambda x, i: (F.coalesce(F.get("f", i - 1), zero) + x
                                            + F.coalesce(F.get("f", i + 1), zero)) / 3.0)
    return full.select(S, "length", smooth.alias("w"))


def _argmax(arr: str | Column) -> Column:
    """First index of the largest element."""
    return -F.array_max(F.transform(arr, lambda x, i: F.struct(x.alias("v"), (-i).alias("n"))))["n"]


def width_profile(profile: DataFrame) -> DataFrame:
    """shape, s, w: the profile turned so that its maximum lies in the first half;
    s is measured from the maximum."""
    p = profile.withColumn("_i", _argmax("w"))
    at = F.col("_i") + 0.5
    turn = at > F.col("length") / 2.0
    p = p.withColumns({"_w": F.when(turn, F.reverse("w")).otherwise(F.col("w")),
                       "_s": F.when(turn, F.col("length") - at).otherwise(at)})
    return p.select(S, "_s", F.posexplode("_w").alias("bin", "w")).select(
        S, "bin", (F.col("bin") + 0.5 - F.col("_s")).alias("s"), "w")


def oriented(profile: DataFrame) -> DataFrame:
    p = profile.withColumn("_i", _argmax("w"))
    turn = F.col("_i") + 0.5 > F.col("length") / 2.0
    return p.select(S, "length", F.when(turn, F.reverse("w")).otherwise(F.col("w")).alias("w"))


def normalised_profile(profile: DataFrame, n: int = 101, centred: bool = False) -> DataFrame:
    """shape, profile: n values at u = s / L by linear interpolation.

    ``centred`` takes bin centres (i + 0.5) / count as positions, else i / (count - 1).
    """
    m = F.size("w")

    def at(g: Column) -> Column:
        u = g / float(n - 1)
        t = (u * m - 0.5) if centred else u * (m - 1)
        t = F.least(F.greatest(t, F.lit(0.0)), (m - 1).cast("double"))
        lo = F.least(F.floor(t), m - 2).cast("int")
        a, b = F.get("w", lo), F.get("w", lo + 1)
        return a + (t - lo) * (b - a)

    return profile.where(m >= 5).select(S, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at).alias("profile"))


def profile_landmarks(profile: DataFrame) -> DataFrame:
    """Width maximum and neck, 50 % crossing and the three lengths of every shape."""
    p = profile.withColumn("i", _argmax("w"))
    L = F.col("length")
    p = p.withColumns({"s_max": F.col("i") + 0.5, "w_max": F.get("w", F.col("i"))})
    near = F.col("s_max") <= L / 2.0
    pts = F.transform("w", lambda x, k: F.struct(x.alias("v"), k.alias("k")))
    low = F.array_min(F.filter(pts, lambda q: F.when(near, q["k"] >= F.col("i")).otherwise(q["k"] <= F.col("i"))))
    p = p.withColumns({"near0": near, "_low": low, "_half": 0.5 * F.col("w_max")})
    below = F.transform(F.filter(pts, lambda q: (q["v"] < F.col("_half")) & F.when(
        F.col("near0"), q["k"] >= F.col("i")).otherwise(q["k"] <= F.col("i"))), lambda q: q["k"])
    p = p.withColumn("_k", F.when(F.col("near0"), F.array_min(below)).otherwise(F.array_max(below)))
    k = F.col("_k")
    prev = F.when(F.col("near0"), k - 1).otherwise(k + 1)
    x0, x1 = F.get("w", prev), F.get("w", k)
    frac = F.when(x0 != x1, (x0 - F.col("_half")) / F.when(x0 != x1, x0 - x1)).otherwise(0.0)
    half = F.when(F.col("near0"), k - 0.5 + frac).otherwise(k + 1.5 - frac)
    near_end, far_end = F.when(F.col("near0"), 0.0).otherwise(L), F.when(F.col("near0"), L).otherwise(0.0)
    s_min = F.col("_low.k") + 0.5
    return p.select(
        S, L.alias("ext_full"), F.abs(F.col("s_max") - near_end).alias("d_bowl"),
        F.abs(s_min - F.col("s_max")).alias("d_mid"), F.abs(far_end - s_min).alias("d_handle"), "w_max",
        F.col("_low.v").alias("w_neck"), half.alias("s_half"),
        F.abs(F.coalesce(half, F.col("s_max")) - near_end).alias("bowl_half_len"))


# --- aligned comparison -----------------------------------------------------

def halfwidths(points: DataFrame, mm: float = 1.0, step: float = 0.5) -> DataFrame:
    """shape, bin, up, down: half widths per 1-mm bin, wider half at the negative end.

    ``bin`` is floor(s) with s from the centroid; bins with one point count as empty.
    """
    dense = densify(points, step)
    pr = project(dense, pca_axes(dense), mm)

    def span(cond: Column) -> Column:
        n = F.when(cond, F.col("n"))
        return F.coalesce(F.max(n) - F.min(n), F.lit(0.0))

    turn = pr.groupBy(S).agg((span(F.col("t") >= 0) > span(F.col("t") < 0)).alias("_turn"))
    f = F.when(F.col("_turn"), -1.0).otherwise(1.0)
    a = pr.join(turn, S).withColumns({"t": F.col("t") * f, "n": F.col("n") * f})
    return a.groupBy(S, F.floor("t").cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.greatest(F.max("n"), F.lit(0.0)).alias("up"),
        F.greatest(-F.min("n"), F.lit(0.0)).alias("down")).where("_c >= 2").drop("_c")


def profile_deficit(cases: DataFrame, references: DataFrame, group: str = "grp", *, present_mm: float = 0.5,
                    end_mm: float = 10.0, loo: bool = False) -> DataFrame:
    """Length deficit of each case against the mean reference profile of its group.

    Inputs have (group, shape, bin, up, down). With ``loo`` the cases are the
    references themselves, each against the mean of the others (sum minus own).
    """
    tot = (F.col("up") + F.col("down"))
    n_ref = references.groupBy(group).agg(F.count_distinct(S).alias("_n"))
    ref = references.groupBy(group, "bin").agg(F.sum(tot).alias("_sum"))
    own = cases.select(group, S, "bin", tot.alias("_own"))
    shapes = cases.select(group, S).distinct()
    # every bin of the group for every case; absent bins have width 0
    rows = shapes.join(n_ref, group).join(ref, group).join(own, [group, S, "bin"], "left").withColumn(
        "_own", F.coalesce("_own", F.lit(0.0)))
    mean = (F.col("_sum") - F.col("_own")) / (F.col("_n") - 1) if loo else F.col("_sum") / F.col("_n")
    rows = rows.withColumns({"_ref": mean}).withColumn("d", F.col("_ref") - F.col("_own"))
    rows = rows.where(F.col("_ref") > present_mm)
    edge = rows.groupBy(group, S).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"),
                                      F.avg("_ref").alias("w_mean"), F.count(F.lit(1)).alias("_p"))
    j = rows.join(edge.where("_p >= 5"), [group, S])
    first, last = F.col("bin") < F.col("_lo") + end_mm, F.col("bin") >= F.col("_hi") - end_mm
    mid = ~first & (F.col("bin") < F.col("_hi") - end_mm)
    g = j.groupBy(group, S, "w_mean").agg(
        F.sum("d").alias("_all"), F.coalesce(F.sum(F.when(first, F.col("d"))), F.lit(0.0)).alias("_f"),
        F.coalesce(F.sum(F.when(last, F.col("d"))), F.lit(0.0)).alias("_l"),
        F.sqrt(F.avg(F.when(mid, F.col("d") * F.col("d")))).alias("resid"))
    w = F.col("w_mean")
    return g.select(group, S, "w_mean", (F.col("_all") / w).alias("len_def"), (F.col("_f") / w).alias("first"),
                    (F.col("_l") / w).alias("last"),
                    ((F.col("_all") - F.col("_f") - F.col("_l")) / w).alias("bulk"), "resid")


def noise_gate(deficits: DataFrame, group: str = "grp", limit_mm: float = 2.0) -> DataFrame:
    """Median absolute leave-one-out deficit per group and whether it is usable."""
    q = quantiles(deficits.withColumn("_a", F.abs("len_def")), [group], "_a", {"noise_mm": MEDIAN}, count="n")
    return q.withColumn("usable", F.col("noise_mm") < limit_mm)


def polar_signature(points: DataFrame, mm: float = 1.0, k: int = 180, step: float = 0.5) -> DataFrame:
    """shape, r: largest radius per angle bin of the aligned outline, filled round the circle."""
    pr = project(points, pca_axes(densify(points, step)), mm)
    # turned like the width profile: maximum in the first half
    turn = width_bins(points, mm, step).select(S, (_argmax("w") + 0.5 > F.col("length") / 2.0).alias("_turn"))
    f = F.when(F.col("_turn"), -1.0).otherwise(1.0)
    pr = pr.join(turn, S).withColumns({"t": F.col("t") * f, "n": F.col("n") * f})
    two_pi = 2.0 * F.pi()
    theta = F.atan2("n", "t")
    theta = F.when(theta < 0, theta + two_pi).otherwise(theta)
    b = F.least(F.lit(k - 1), F.floor(theta / two_pi * k)).cast("int")
    per = pr.groupBy(S, b.alias("bin")).agg(F.max(F.hypot("t", "n")).alias("r"))
    g = per.groupBy(S).agg(F.sort_array(F.collect_list(F.struct("bin", "r"))).alias("g")).where(F.size("g") >= k // 2)
    first, last = F.get("g", 0), F.element_at("g", -1)
    ring = F.concat(F.array(F.struct((last["bin"] - k).alias("bin"), last["r"].alias("r"))), F.col("g"),
                    F.array(F.struct((first["bin"] + k).alias("bin"), first["r"].alias("r"))))
    g = g.withColumn("ring", ring)

    def at(i: Column) -> Column:
        lo = F.element_at(F.filter("ring", lambda p: p["bin"] <= i), -1)
        hi = F.get(F.filter("ring", lambda p: p["bin"] >= i), 0)
        gap = hi["bin"] - lo["bin"]
        return F.when(gap == 0, lo["r"]).otherwise(
            lo["r"] + (hi["r"] - lo["r"]) * (i - lo["bin"]) / F.when(gap != 0, gap))

    return g.select(S, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at).alias("r"))


def polar_outlier(signatures: DataFrame, group: str = "grp") -> DataFrame:
    """group, farthest shape from the median outline, median residual; NULL below 2."""
    long = signatures.select(group, S, F.posexplode("r").alias("bin", "r"))
    med = quantiles(long, [group, "bin"], "r", {"m": MEDIAN})
    d = long.join(med, [group, "bin"]).withColumn("_d", F.col("r") - F.col("m")).groupBy(group, S).agg(
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("dist"))
    far = d.groupBy(group).agg(F.count(F.lit(1)).alias("n_shapes"),
                               F.max(F.struct(F.col("dist"), (-F.col(S)).alias("t"))).alias("_x"))
    res = quantiles(d, [group], "dist", {"residual": MEDIAN})
    two = F.col("n_shapes") >= 2
    return far.join(res, group).select(group, "n_shapes", F.when(two, -F.col("_x.t")).alias("farthest"),
                                       F.when(two, F.col("residual")).alias("residual"))
