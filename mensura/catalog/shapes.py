"""Contour, profile and group-statistics queries (G, A44, A45, A49-A52, A59, A60, W19-W21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import stats as ST
from .base import query
from .views import stored


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


EDGE = """ed as (select *, coalesce(lead(x) over w, first(x) over (partition by shape_id order by pos rows between unbounded preceding and unbounded following)) as x1,
  coalesce(lead(y) over w, first(y) over (partition by shape_id order by pos rows between unbounded preceding and unbounded following)) as y1 from fx_contour window w as (partition by shape_id order by pos)),
kk as (select *, greatest(1, cast(floor(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / 0.5e0) as bigint)) as kn from ed),
dn as (select shape_id, pos, j, x + (x1 - x) * (j * 1e0 / kn) as x, y + (y1 - y) * (j * 1e0 / kn) as y from (select *, unnest(range(0, kn)) as j from kk))"""
AXES = f"""{EDGE}, g as (select shape_id, avg(x) as cx, avg(y) as cy, var_samp(x) as a, var_samp(y) as b, covar_samp(x, y) as c from dn group by 1),
ax0 as (select *, (a + b) / 2e0 + sqrt(power((a - b) / 2e0, 2) + c * c) - b as px from g),
ax as (select shape_id, cx, cy, px / sqrt(px * px + c * c) as ux, c / sqrt(px * px + c * c) as uy from ax0),
pj as (select d.*, (d.x - cx) * ux + (d.y - cy) * uy as t, (d.x - cx) * -uy + (d.y - cy) * ux as n from dn d join ax using (shape_id))"""


@query("G01_densify", f"with {EDGE} select shape_id, count(*) as n, round(sum(x), 3) as sx, round(sum(y), 3) as sy from dn group by 1")
def g01(v, spark, sf):
    d = G.densify(v("fx_contour"))
    return d.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


@query("G02_pca_axes", f"with {AXES} select shape_id, round(cx, 4) as cx, round(cy, 4) as cy, round(abs(ux), 5) as ux, round(abs(uy), 5) as uy from ax")
def g02(v, spark, sf):
    a = G.pca_axes(G.densify(v("fx_contour")))
    return a.select("shape_id", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"),
                    F.round(F.abs("ux"), 5).alias("ux"), F.round(F.abs("uy"), 5).alias("uy"))


@query("G03_extents", f"""with {AXES}, q as (select shape_id, quantile_cont(t, 0.995) - quantile_cont(t, 0.005) as p99, quantile_cont(t, 0.99) - quantile_cont(t, 0.01) as p98, quantile_cont(n, 0.99) - quantile_cont(n, 0.01) as lat from pj group by 1),
f as (select shape_id, max((c.x - cx) * ux + (c.y - cy) * uy) - min((c.x - cx) * ux + (c.y - cy) * uy) as full_ from fx_contour c join ax using (shape_id) group by 1)
select shape_id, round(full_, 4) as ext_full, round(p99, 4) as ext_p99, round(p98, 4) as ext_p98, round(lat, 4) as lat_p98 from q join f using (shape_id)""")
def g03(v, spark, sf):
    return r(G.extents(v("fx_contour")), 4, "ext_full", "ext_p99", "ext_p98", "lat_p98")


@query("G04_point_set_diameter", "select a.shape_id, round(max(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 4) as diameter from fx_contour a join fx_contour b using (shape_id) group by 1")
def g04(v, spark, sf):
    return r(G.point_set_diameter(v("fx_contour")), 4, "diameter")


@query("G05_polygon_measures", f"""with {EDGE}, m as (select shape_id, sum(x * y1 - x1 * y) as a2, sum(sqrt(power(x1 - x, 2) + power(y1 - y, 2))) as p, sum((x + x1) * (x * y1 - x1 * y)) as mx, sum((y + y1) * (x * y1 - x1 * y)) as my from ed group by 1)
select shape_id, round(abs(a2) / 2e0, 3) as area, round(p, 4) as perimeter, round(2e0 * pi() * abs(a2) / (p * p), 5) as circularity, round(2e0 * sqrt(abs(a2) / 2e0 / pi()), 4) as equiv_diameter,
  round(mx / (3e0 * a2), 4) as centroid_x, round(my / (3e0 * a2), 4) as centroid_y from m""")
def g05(v, spark, sf):
    return r(r(r(G.polygon_measures(v("fx_contour")), 4, "perimeter", "equiv_diameter", "centroid_x", "centroid_y"), 3, "area"), 5, "circularity")


@query("G06_hu_moments_log", f"""with {EDGE}, c as (select shape_id, avg(x) as cx, avg(y) as cy from fx_contour group by 1), e as (select shape_id, x - cx as x, y - cy as y, x1 - cx as u, y1 - cy as v from ed join c using (shape_id)),
m as (select shape_id, sum(a / 2) as m00, sum(a * (x + u) / 6) as m10, sum(a * (y + v) / 6) as m01, sum(a * (x * x + x * u + u * u) / 12) as m20, sum(a * (y * y + y * v + v * v) / 12) as m02,
  sum(a * (x * (2 * y + v) + u * (y + 2 * v)) / 24) as m11 from (select *, x * v - u * y as a from e) group by 1),
n as (select shape_id, (m20 - m10 * m10 / m00) / (m00 * m00) as n20, (m02 - m01 * m01 / m00) / (m00 * m00) as n02, (m11 - m10 * m01 / m00) / (m00 * m00) as n11 from m)
select shape_id, round(-log10(n20 + n02), 5) as h1, round(-log10(power(n20 - n02, 2) + 4 * n11 * n11), 5) as h2 from n""")
def g06(v, spark, sf):
    h = G.hu_moments_log(v("fx_contour"))
    return h.select("shape_id", F.round(F.get("hu", 0), 5).alias("h1"), F.round(F.get("hu", 1), 5).alias("h2"))


_CM = {"20": "m20 - cx * m10", "02": "m02 - cy * m01", "11": "m11 - cx * m01", "30": "m30 - 3 * cx * m20 + 2 * cx * cx * m10",
       "03": "m03 - 3 * cy * m02 + 2 * cy * cy * m01", "21": "m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01",
       "12": "m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10"}
_RAW = ("00", "10", "01", "20", "02", "11", "30", "03", "21", "12")
_ORDER = {k: "2e0" if k in ("20", "02", "11") else "2.5e0" for k in _CM}


@query("G06_all_hu_invariants", f"""with {EDGE}, c as (select shape_id, avg(x) as cx, avg(y) as cy from fx_contour group by 1), e as (select shape_id, x - cx as x, y - cy as y, x1 - cx as u, y1 - cy as v from ed join c using (shape_id)),
m0 as (select shape_id, sum(a / 2) as m00, sum(a * (x + u) / 6) as m10, sum(a * (y + v) / 6) as m01, sum(a * (x * x + x * u + u * u) / 12) as m20, sum(a * (y * y + y * v + v * v) / 12) as m02,
  sum(a * (x * (2 * y + v) + u * (y + 2 * v)) / 24) as m11, sum(a * (x * x * x + x * x * u + x * u * u + u * u * u) / 20) as m30, sum(a * (y * y * y + y * y * v + y * v * v + v * v * v) / 20) as m03,
  sum(a * (x * x * (3 * y + v) + 2 * x * u * (y + v) + u * u * (y + 3 * v)) / 60) as m21, sum(a * (y * y * (3 * x + u) + 2 * y * v * (x + u) + v * v * (x + 3 * u)) / 60) as m12
  from (select *, x * v - u * y as a from e) group by 1),
m as (select shape_id, {', '.join(f'm{k} * sign(m00) as m{k}' for k in _RAW)}, m10 / m00 as cx, m01 / m00 as cy from m0),
n as (select shape_id, {', '.join(f'({body}) / power(m00, {_ORDER[k]}) as n{k}' for k, body in _CM.items())} from m),
h as (select shape_id, n20 + n02 as h1, power(n20 - n02, 2) + 4 * n11 * n11 as h2, r * r + s * s as h3, p * p + q * q as h4, r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q) as h5,
  (n20 - n02) * (p * p - q * q) + 4 * n11 * p * q as h6, s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q) as h7
  from (select *, n30 + n12 as p, n21 + n03 as q, n30 - 3 * n12 as r, 3 * n21 - n03 as s from n))
select shape_id, {', '.join(f'round(-sign(h{i}) * log10(abs(h{i})), 4) as h{i}' for i in range(1, 7))}, abs(h7) < 1e-12 as h7_vanishes from h""")
def g06_all(v, spark, sf):
    """All seven invariants; the outlines are mirror images of themselves, so the seventh is 0 but for rounding."""
    h = G.hu_moments_log(v("fx_contour"))
    seventh = F.abs(F.get("hu", 6))
    return h.select("shape_id", *[F.round(F.get("hu", i), 4).alias(f"h{i + 1}") for i in range(6)],
                    ((seventh == 0) | (seventh > 12)).alias("h7_vanishes"))


PROF = f"""{AXES}, ln as (select shape_id, min(t) as t0, max(t) - min(t) as len_ from pj group by 1), nb as (select *, cast(floor(len_) as bigint) + 1 as nb from ln),
rb as (select shape_id, cast(least(floor(t - t0), floor(len_)) as bigint) as bin, max(n) - min(n) as w from pj join ln using (shape_id) group by 1, 2 having count(*) >= 2),
al as (select shape_id, len_, nb, unnest(range(0, nb)) as bin from nb where nb >= 5),
jn as (select a.*, w, case when w is not null then a.bin end as gb from al a left join rb using (shape_id, bin)),
fl as (select *, last_value(w ignore nulls) over b as wl, last_value(gb ignore nulls) over b as bl, first_value(w ignore nulls) over f as wr, first_value(gb ignore nulls) over f as br from jn
  window b as (partition by shape_id order by bin rows between unbounded preceding and current row), f as (partition by shape_id order by bin rows between current row and unbounded following)),
fw as (select shape_id, len_, nb, bin, case when wl is null then wr when wr is null then wl when br = bl then wl else wl + (wr - wl) * (bin - bl) / (br - bl) end as w from fl),
sm as (select shape_id, len_, nb, bin, (coalesce(lag(w) over o, 0e0) + w + coalesce(lead(w) over o, 0e0)) / 3e0 as w from fw window o as (partition by shape_id order by bin)),
mx as (select shape_id, any_value(len_) as len_, any_value(nb) as nb, max(w) as wmax, arg_max(bin, (w, -bin)) as im from sm group by 1)"""
# The sign of the axis is free: both engines use the same closed form, so bins agree.


def prof(v, spark, sf):
    return stored(spark, sf, "profiles", lambda: G.width_bins(v("fx_contour")))


@query("G07_width_profile", f"""with {PROF}, o as (select s.shape_id, case when im + 0.5e0 > m.len_ / 2e0 then m.nb - 1 - bin else bin end as bin, w, case when im + 0.5e0 > m.len_ / 2e0 then m.len_ - (im + 0.5e0) else im + 0.5e0 end as s0 from sm s join mx m using (shape_id))
select shape_id, bin, round(bin + 0.5e0 - s0, 3) as s, round(w, 3) as w from o""")
def g07(v, spark, sf):
    p = G.width_profile(prof(v, spark, sf))
    return r(p.withColumn("bin", F.col("bin").cast("long")), 3, "s", "w")


@query("G08_normalised_profile", f"""with {PROF}, o as (select s.shape_id, m.nb, case when im + 0.5e0 > m.len_ / 2e0 then m.nb - 1 - bin else bin end as bin, w from sm s join mx m using (shape_id)),
g8 as (select shape_id, nb, g, cast(least(floor(g / 100e0 * (nb - 1)), nb - 2) as bigint) as lo, g / 100e0 * (nb - 1) as t from (select distinct shape_id, nb, unnest(range(0, 101)) as g from mx))
select g8.shape_id, list(round(a.w + (t - lo) * (b.w - a.w), 3) order by g) as profile from g8 join o a on a.shape_id = g8.shape_id and a.bin = lo join o b on b.shape_id = g8.shape_id and b.bin = lo + 1 group by 1""")
def g08(v, spark, sf):
    n = G.normalised_profile(G.oriented(prof(v, spark, sf)))
    return n.select("shape_id", F.transform("profile", lambda x: F.round(x, 3)).alias("profile"))


@query("G09_profile_landmarks", f"""with {PROF}, k as (select *, im + 0.5e0 <= len_ / 2e0 as near0 from mx), c as (select s.shape_id, s.bin, s.w, k.im, k.near0, k.wmax, k.len_ from sm s join k using (shape_id) where case when near0 then s.bin >= im else s.bin <= im end),
n as (select shape_id, any_value(near0) as near0, any_value(len_) as len_, any_value(im) as im, any_value(wmax) as wmax, min(w) as w_neck, arg_min(bin, (w, bin)) as i2, case when any_value(near0) then min(case when w < 0.5e0 * wmax then bin end) else max(case when w < 0.5e0 * wmax then bin end) end as kh from c group by 1),
h as (select n.*, case when near0 then kh - 0.5e0 + (p.w - 0.5e0 * wmax) / (p.w - q.w) else kh + 1.5e0 - (p.w - 0.5e0 * wmax) / (p.w - q.w) end as s_half from n left join sm q on q.shape_id = n.shape_id and q.bin = kh left join sm p on p.shape_id = n.shape_id and p.bin = case when near0 then kh - 1 else kh + 1 end)
select shape_id, round(len_, 3) as ext_full, round(abs(im + 0.5e0 - case when near0 then 0e0 else len_ end), 3) as d_bowl, round(abs(i2 - im) * 1e0, 3) as d_mid, round(abs(case when near0 then len_ else 0e0 end - (i2 + 0.5e0)), 3) as d_handle,
  round(wmax, 3) as w_max, round(w_neck, 3) as w_neck, round(abs(coalesce(s_half, im + 0.5e0) - case when near0 then 0e0 else len_ end), 3) as bowl_half_len from h""")
def g09(v, spark, sf):
    return r(G.profile_landmarks(prof(v, spark, sf)), 3, "ext_full", "d_bowl", "d_mid", "d_handle", "w_max", "w_neck", "bowl_half_len").drop("s_half")


HALF = f"""{AXES}, tn as (select shape_id, coalesce(max(n) filter (where t >= 0) - min(n) filter (where t >= 0), 0e0) > coalesce(max(n) filter (where t < 0) - min(n) filter (where t < 0), 0e0) as turn from pj group by 1),
hp as (select shape_id, t * case when turn then -1e0 else 1e0 end as t, n * case when turn then -1e0 else 1e0 end as n from pj join tn using (shape_id)),
hw as (select shape_id, shape_id % 5 as grp, cast(floor(t) as int) as bin, greatest(max(n), 0e0) as up, greatest(-min(n), 0e0) as down from hp group by 1, 2, 3 having count(*) >= 2)"""


def halves(v, spark, sf):
    return stored(spark, sf, "halfwidths", lambda: G.halfwidths(v("fx_contour"))).withColumn("grp", F.col("shape_id") % 5)


@query("G12_aligned_halfwidths", f"with {HALF} select shape_id, bin, round(up, 3) as up, round(down, 3) as down from hw")
def g12(v, spark, sf):
    return r(halves(v, spark, sf).drop("grp"), 3, "up", "down")


def _deficit_sql(mean: str) -> str:
    return f"""with {HALF}, nr as (select grp, count(distinct shape_id) as nn from hw group by 1), sr as (select grp, bin, sum(up + down) as sm from hw group by 1, 2),
al as (select s.grp, s.shape_id, r.bin, nn, sm, coalesce(h.up + h.down, 0e0) as own from (select distinct grp, shape_id from hw) s join nr using (grp) join sr r on r.grp = s.grp left join hw h on h.shape_id = s.shape_id and h.bin = r.bin),
df as (select *, {mean} as rf from al), pr as (select *, rf - own as d from df where rf > 0.5e0), ed2 as (select grp, shape_id, min(bin) as lo, max(bin) as hi, avg(rf) as wm from pr group by 1, 2 having count(*) >= 5),
dd as (select grp, shape_id, wm, sum(d) as al_, coalesce(sum(d) filter (where bin < lo + 10), 0e0) as fi, coalesce(sum(d) filter (where bin >= hi - 10), 0e0) as la, sqrt(avg(case when not (bin < lo + 10) and bin < hi - 10 then d * d end)) as rs from pr join ed2 using (grp, shape_id) group by 1, 2, 3)"""


@query("G10_mean_profile_deficit", f"{_deficit_sql('(sm - own) / (nn - 1)')} select grp, shape_id, round(wm, 4) as w_mean, round(al_ / wm, 4) as len_def, round(fi / wm, 4) as first, round(la / wm, 4) as last, round((al_ - fi - la) / wm, 4) as bulk, round(rs, 4) as resid from dd")
def g10(v, spark, sf):
    h = halves(v, spark, sf)
    return r(G.profile_deficit(h, h, loo=True), 4, "w_mean", "len_def", "first", "last", "bulk", "resid")


@query("G12_noise_gate", f"{_deficit_sql('(sm - own) / (nn - 1)')} select grp, count(*) as n, round(median(abs(al_ / wm)), 4) as noise_mm, median(abs(al_ / wm)) < 2e0 as usable from dd group by 1")
def g12b(v, spark, sf):
    h = halves(v, spark, sf)
    return r(G.noise_gate(G.profile_deficit(h, h, loo=True)), 4, "noise_mm")


@query("G11_polar_outlier")
def g11(v, spark, sf):
    sig = stored(spark, sf, "polar", lambda: G.polar_signature(v("fx_contour"), k=48))
    return G.polar_outlier(sig.withColumn("grp", F.col("shape_id") % 5))


# --- statistics -----------------------------------------------------------

@query("A44_position_correlation", """select count(*) as n, round(corr(d, e), 4) as r, case when abs(round(corr(d, e), 4)) < 0.3e0 then 'keine Positionsabhaengigkeit' else 'Positionsabhaengigkeit' end as verdict
from (select sqrt(power(cx - 1920e0, 2) + power(cy - 1080e0, 2)) as d, circle_diameter_mm - (60e0 + 1.9e0 * c) as e from fx_rep where cx is not null)""")
def a44(v, spark, sf):
    p = v("select circle_diameter_mm as measured, 60e0 + 1.9e0 * c as mean, cx as x, cy as y, 3840e0 as width, 2160e0 as height from fx_rep")
    return ST.position_correlation(p)


_TREND = "(select c as key_, k as shot, circle_diameter_mm as length, equiv_diameter_mm as width, coalesce(cx, 1e0) as x, coalesce(cy, 1e0) as y from fx_rep)"


@query("A45_linear_trend", f"""select key_, count(*) as n, round(regr_slope(length, y), 8) as slope_length, round(max(length) - min(length), 6) as span_length, round(corr(y, length), 5) as r_y, round(corr(sqrt(x * x + y * y), length), 5) as r_radius,
  round(corr(shot, length), 5) as r_time, (arg_max(length, shot) filter (where shot <= 7000) - arg_min(length, shot) filter (where shot <= 7000)) * (arg_max(length, shot) filter (where shot > 7000) - arg_min(length, shot) filter (where shot > 7000)) < 0 as opposite
from {_TREND} t group by 1 having count(*) >= 3""")
def a45(v, spark, sf):
    t = ST.linear_trend(v(f"select * from {_TREND} t"), "key_", 7000)
    out = r(r(t, 5, "r_y", "r_radius", "r_time"), 6, "span_length")
    return out.select("key_", "n", F.round("slope_length", 8).alias("slope_length"), "span_length", "r_y", "r_radius", "r_time", "opposite")


_IQR = ("area_mm2", "perimeter_mm", "circularity")


@query("A49_median_iqr_by_group", " union all ".join(f"select session, k % 9 = 0 as is_tail, '{m}' as metric, count(*) as n, round(median({m}), 7) as median, round(quantile_cont({m}, 0.25), 7) as p25, round(quantile_cont({m}, 0.75), 7) as p75 from fx_rep group by 1, 2" for m in _IQR))
def a49(v, spark, sf):
    rows = v("select session, k % 9 = 0 as is_tail, area_mm2, perimeter_mm, circularity from fx_rep")
    return r(ST.median_iqr(rows, ["session", "is_tail"], _IQR), 7, "median", "p25", "p75")


def _clip_sql() -> str:
    parts = ["c0 as (select grp, median(ev) as lim from fx_pixels group by 1)"]
    for i in range(4):
        parts.append(f"c{i + 1} as (select grp, avg(ev) + 1.2e0 * stddev_pop(ev) as lim from fx_pixels join c{i} using (grp) where ev <= lim group by 1)")
    return "with " + ", ".join(parts) + " select grp, round(greatest(2e0, lim), 4) as ceiling from c4"


@query("A50_sigma_clipped_ceiling", _clip_sql())
def a50(v, spark, sf):
    return r(ST.sigma_clipped_ceiling(v("fx_pixels"), "grp", "ev", 1.2), 4, "ceiling")


@query("A51_hist2d", """with z as (select grp, case when radius < 0.6e0 then 'center' when radius > 0.75e0 then 'rim' end as zone, hue * 16 // 180 * 8 + sat * 8 // 256 as bin from fx_pixels),
t as (select grp, zone, count(*) as t from z where zone is not null group by 1, 2), c as (select grp, zone, bin, count(*) as c from z where zone is not null group by 1, 2, 3),
d as (select t.grp, t.zone, b, round(coalesce(c, 0) / t.t, 6) as h from (select *, unnest(range(0, 128)) as b from t) t left join c on c.grp = t.grp and c.zone = t.zone and c.bin = b)
select e.grp, e.zone, coalesce(any_value(x.hist), []) as hist from (select distinct grp, unnest(['center', 'rim']) as zone from fx_pixels) e left join (select grp, zone, list(h order by b) as hist from d group by 1, 2) x using (grp, zone) group by 1, 2""")
def a51(v, spark, sf):
    return ST.hist2d(v("fx_pixels"), "grp")


@query("A51_hue_hist", """with c as (select grp, hue * 32 // 180 as bin, count(*) as c from fx_pixels group by 1, 2), t as (select grp, count(*) as t from fx_pixels group by 1)
select grp, list(round(coalesce(c, 0) / t, 6) order by b) as hist from (select *, unnest(range(0, 32)) as b from t) left join c using (grp) where true and (c.bin = b or c.bin is null or true) group by 1""".replace("left join c using (grp) where true and (c.bin = b or c.bin is null or true)", "x left join c on c.grp = x.grp and c.bin = x.b").replace("select grp, list", "select x.grp, list"))
def a51b(v, spark, sf):
    return ST.hue_hist(v("fx_pixels"), "grp")


@query("A52_zone_means", """select grp, case when radius < 0.6e0 then 'center' else 'rim' end as zone, round(avg(lab_l + 0.0000137e0), 3) as lab_l, round(avg(lab_a + 0.0000137e0), 3) as lab_a, round(avg(lab_b + 0.0000137e0), 3) as lab_b from fx_pixels where radius < 0.6e0 or radius > 0.75e0 group by 1, 2""")
def a52(v, spark, sf):
    p = v("fx_pixels").withColumns({c: F.col(c) + 0.0000137 for c in ("lab_l", "lab_a", "lab_b")})
    return ST.zone_means(p, "grp", ["lab_l", "lab_a", "lab_b"])


_TAIL = "(select report_id, session, concat('A', cast(c % 25 as string)) as article_number, area_mm2, perimeter_mm, circularity, equiv_diameter_mm - 60e0 - 1.9e0 * c as rest from fx_rep)"
_TST = f"(select article_number, avg(perimeter_mm) as mean, stddev_samp(perimeter_mm) / 2e0 as std from {_TAIL} t group by 1)"
_TF = f"(select t.*, (perimeter_mm - mean) / std as z_self, coalesce(abs((perimeter_mm - mean) / std) > 3e0, false) as is_tail from {_TAIL} t join {_TST} s using (article_number))"


def tails(v):
    return ST.tail_flags(v(f"select * from {_TAIL} t"), v(f"select * from {_TST} t"), "perimeter_mm")


@query("W19_z_self_is_tail", f"select report_id, round(z_self, 5) as z_self, is_tail from {_TF} t")
def w19(v, spark, sf):
    return tails(v).select("report_id", F.round("z_self", 5).alias("z_self"), "is_tail")


@query("A59_clean_group_noise", f"""with g as (select article_number, session, coalesce(stddev_samp(area_mm2), 0e0) as area_mm2, coalesce(stddev_samp(rest), 0e0) as rest from {_TF} t group by 1, 2 having count(*) >= 4 and max(is_tail::int) = 0),
l as (select 'area_mm2' as landmark, area_mm2 as s from g union all select 'rest', rest from g) select landmark, count(*) as n_groups, round(median(s), 5) as median_std, count_if(s < 1.1e0) as below, median(s) < 1.1e0 as usable from l group by 1""")
def a59(v, spark, sf):
    return r(ST.clean_group_noise(tails(v), ["article_number", "session"], ["area_mm2", "rest"], 1.1), 5, "median_std")


_REF = f"""(select article_number, metric, median(x) as md, min(x) as mn, max(x) as mxx, count(*) as n_ref from (select article_number, unnest(['area_mm2', 'rest', 'circularity']) as metric, unnest([area_mm2, rest, circularity]) as x from {_TF} t where not is_tail) group by 1, 2 having count(*) >= 3)"""
_OWN = f"(select report_id, article_number, unnest(['area_mm2', 'rest', 'circularity']) as metric, unnest([area_mm2, rest, circularity]) as value from {_TF} t where is_tail)"


@query("W21_hard_case_vs_reference", f"select report_id, metric, round(value, 6) as value, round(md, 7) as median, round(mn, 6) as minimum, round(mxx, 6) as maximum, n_ref from {_OWN} o join {_REF} r using (article_number, metric)")
def w21(v, spark, sf):
    t = tails(v)
    out = ST.group_reference(t.where("is_tail"), t, ["article_number"], ["area_mm2", "rest", "circularity"], "report_id")
    return r(r(out, 6, "value", "minimum", "maximum"), 7, "median").select("report_id", "metric", "value", "median", "minimum", "maximum", "n_ref")


@query("A60_segment_deficit", f"""with d as (select report_id, metric, value, md, md - value as deficit from {_OWN} o join {_REF} r using (article_number, metric)), t as (select report_id, deficit as tt from d where metric = 'area_mm2')
select report_id, metric as segment, round(value, 6) as value, round(md, 7) as median, round(deficit, 6) as deficit, round(case when abs(tt) > 1e-6 then 100e0 * deficit / tt end, 5) as share_pct from d join t using (report_id) where metric <> 'area_mm2'""")
def a60(v, spark, sf):
    t = tails(v)
    out = ST.segment_deficit(t.where("is_tail"), t, ["article_number"], ["rest", "circularity"], "area_mm2", "report_id")
    return r(r(r(out, 6, "value", "deficit"), 7, "median"), 5, "share_pct")


def _match_sql(c: str, p: str, keys: str) -> str:
    return f"""(with pm as (select {keys}, median(area_mm2) as m from {p} group by all), pn as (select {keys}, report_id as control, row_number() over (partition by {keys} order by abs(area_mm2 - m), report_id) as n from {p} join pm using ({keys})),
  cn as (select {keys}, report_id, row_number() over (partition by {keys} order by report_id) as n from {c}) select report_id, control from cn join pn using ({keys}, n))"""


@query("W20_matched_controls", f"""with tf as (select * from {_TF} t), tl as (select * from tf where is_tail), rs as (select * from tf where not is_tail), same as (select * from {_match_sql('tl', 'rs', 'article_number, session')}),
lf as (select * from tl where report_id not in (select report_id from same)), fr as (select * from rs where report_id not in (select control from same)), oth as (select * from {_match_sql('lf', 'fr', 'article_number')})
select report_id, control from tl left join (select * from same union all select * from oth) using (report_id)""")
def w20(v, spark, sf):
    return ST.matched_controls(tails(v), "report_id", "area_mm2")
