"""Enrollment, floor, diagnostic and pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import distances as dist
from ..operators import enroll as E, master_sync, pairs, ranks
from .base import query
from .identify import (FLOOR_SQL, NOM, bhatta_sql, dist_sql, euclid_sql, l1_sql, scal_long_sql, shot_stats,
                       stats_ctes, vec_long_sql)
from .views import table

R = F.round


@query("A01_enrollment_scalar_stats", f"with {stats_ctes('fx_shots')} select article_number, feature, n, round(mean, 11) as mean, round(std, 6) as std from sc")
def a01(v, spark, sf):
    return E.scalar_stats(v("fx_shots")).withColumns({"mean": R("mean", 11), "std": R("std", 6)})


@query("A02_prototype_mean", f"with {stats_ctes('fx_shots')} select article_number, feature, list_transform(proto, lambda x: round(x, 11)) as proto from pr")
def a02(v, spark, sf):
    return E.prototypes(v("fx_shots")).withColumn("proto", F.transform("proto", lambda x: F.round(x, 11)))


@query("A03_prototype_spread", f"with {stats_ctes('fx_shots')} select p.article_number, p.feature, p.n, round(s.std, 5) as spread from pr p join sp s using (article_number, feature)")
def a03(v, spark, sf):
    return E.prototype_spread(v("fx_shots")).withColumn("spread", R("spread", 5))


@query("A04_renormalise_hist", f"with {stats_ctes('fx_shots')} select article_number, feature, list_transform(proto, lambda x: round(x, 11)) as proto from st where proto is not null")
def a04(v, spark, sf):
    s = E.stats_long(v("fx_shots")).where("proto is not null")
    return s.select("article_number", "feature", F.transform("proto", lambda x: F.round(x, 11)).alias("proto"))


@query("A05_robust_enrollment_stats", f"""with {stats_ctes('fx_emb')}, md as (select article_number, feature, count(*) as n, median(value) as mean from sl group by 1, 2),
sr as (select article_number, feature, any_value(n) as n, any_value(mean) as mean, case when any_value(n) > 1 then 1.4826e0 * median(abs(value - mean)) else 0e0 end as std from sl join md using (article_number, feature) group by 1, 2),
pm as (select article_number, feature, list(m order by pos) as proto from (select article_number, feature, pos, median(vec[pos]) as m from (select article_number, feature, vec, unnest(range(1, len(vec) + 1)) as pos from vl) group by 1, 2, 3) group by 1, 2),
vr as (select article_number, feature, count(*) as n, 1.4826e0 * median({dist_sql('feature', 'vec', 'proto')}) as std from vl join pm using (article_number, feature) group by 1, 2)
select article_number, feature, n, round(mean, 6) as mean, round(std, 5) as std from sr union all select article_number, feature, n, null, round(std, 5) from vr""")
def a05(v, spark, sf):
    return E.robust_stats(v("fx_emb")).select("article_number", "feature", "n", R("mean", 6).alias("mean"), R("std", 5).alias("std"))


def floor_ctes(src: str) -> str:
    fk = "case feature " + " ".join(f"when '{f}' then '{k}'" for f, k in C.FLOOR_KEYS.items()) + " end"
    return f"""{stats_ctes(src)}, smp as (select article_number as series, {fk} as floor_key, ref, value from ({scal_long_sql(src, 'article_number, report_id as ref')})
  union all select article_number, {fk}, ref, {dist_sql('feature', 'vec', 'proto')} from ({vec_long_sql(src, 'article_number, report_id as ref')}) join (select article_number, feature, proto from st where proto is not null) using (article_number, feature)),
est as (select series, floor_key, count(*) as n, avg(value) as mean, coalesce(stddev_samp(value), 0e0) as std, sqrt(avg(value * value)) as rms, min(value) as minimum, max(value) as maximum from smp group by 1, 2)"""


@query("A06_floor_estimate", f"""with {floor_ctes('fx_emb')} select series, floor_key, n, round(mean, 4) as mean, round(std, 4) as std,
  round(case when floor_key in ('diameter_mm', 'circularity', 'solidity') then std else rms end, 4) as floor, round(minimum, 4) as minimum, round(maximum, 4) as maximum, n < 10 as low_n_warning from est""")
def a06(v, spark, sf):
    out = E.floor_estimate(E.floor_samples(v("fx_emb"), "article_number", "report_id"), "article_number")
    return out.withColumnRenamed("article_number", "series").withColumns(
        {c: R(c, 4) for c in ("mean", "std", "floor", "minimum", "maximum")})


@query("A07_floor_outliers", f"""with {floor_ctes('fx_emb')} select series, floor_key, ref, round(value, 5) as value, round(abs(value - mean) / std, 2) as z from smp join est using (series, floor_key) where std > 0 and abs(value - mean) / std > 3e0""")
def a07(v, spark, sf):
    out = E.floor_outliers(E.floor_samples(v("fx_emb"), "article_number", "report_id"), "article_number", "report_id")
    return out.select(F.col("article_number").alias("series"), "floor_key", F.col("report_id").alias("ref"), R("value", 5).alias("value"), "z")


@query("X03_pooled_samples", f"with {floor_ctes('fx_emb')} select series, floor_key, count(*) as n, count(distinct ref) as n_refs from smp group by 1, 2")
def x03(v, spark, sf):
    s = E.floor_samples(v("fx_emb"), "article_number", "report_id")
    return s.groupBy(F.col("article_number").alias("series"), "floor_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("report_id").alias("n_refs"))


_W5 = """(select a.article_number, a.report_id, a.circle_diameter_mm as x, avg(b.circle_diameter_mm) as m, stddev_samp(b.circle_diameter_mm) as s, median(b.circle_diameter_mm) as md, count(*) as n
  from fx_emb a join fx_emb b on a.article_number = b.article_number and a.report_id <> b.report_id group by 1, 2, 3)"""


@query("W05_loo_classic_z", f"select article_number, report_id, round(case when n >= 2 and s > 0 then (x - m) / s end, 5) as z from {_W5} t")
def w05(v, spark, sf):
    return E.loo_classic_z(v("fx_emb"), ["article_number"], "circle_diameter_mm", "z").select("article_number", "report_id", R("z", 5).alias("z"))


_W6 = f"""(select t.article_number, t.report_id, t.x, t.md, median(abs(b.circle_diameter_mm - t.md)) as mad from {_W5} t join fx_emb b on b.article_number = t.article_number and b.report_id <> t.report_id group by 1, 2, 3, 4)"""


@query("W06_loo_robust_z", f"select article_number, report_id, round(case when mad > 0 then (x - md) / (1.4826e0 * mad) end, 5) as z from {_W6} t")
def w06(v, spark, sf):
    return E.loo_robust_z(v("fx_emb").select("article_number", "report_id", "circle_diameter_mm"), ["article_number"],
                          "circle_diameter_mm", "z").select("article_number", "report_id", R("z", 5).alias("z"))


_W9 = f"""(select c.article_number, c.report_id, c.feature, {dist_sql('c.feature', 'any_value(c.vec)', 'list(p.m order by p.pos)')} as d from ({vec_long_sql('fx_emb', 'article_number, report_id')}) c
  join (select x.article_number, x.report_id, x.feature, pos, avg(y.vec[pos]) as m from ({vec_long_sql('fx_emb', 'article_number, report_id')}) x join (select *, unnest(range(1, len(vec) + 1)) as pos from ({vec_long_sql('fx_emb', 'article_number, report_id')})) y
    on y.article_number = x.article_number and y.feature = x.feature and y.report_id <> x.report_id group by 1, 2, 3, 4) p using (article_number, report_id, feature) group by 1, 2, 3)"""


@query("W09_loo_prototype_distance", f"select article_number, report_id, feature, round(d, 5) as d from {_W9} t")
def w09(v, spark, sf):
    return E.loo_prototype_distance(v("fx_emb"), "report_id").select("article_number", "report_id", "feature", R("d", 5).alias("d"))


_W8 = f"""w9 as (select * from {_W9} t), g8 as (select article_number, feature, avg(d) as m, stddev_samp(d) as s, median(d) as md from w9 group by 1, 2),
m8 as (select article_number, feature, median(abs(d - md)) as mad from w9 join g8 using (article_number, feature) group by 1, 2),
z8 as (select w9.*, case when s > 0 then (d - m) / s end as zc, case when mad > 0 then (d - md) / (1.4826e0 * mad) end as zr from w9 join g8 using (article_number, feature) join m8 using (article_number, feature))"""


@query("W08_global_z", f"with {_W8} select article_number, report_id, feature, round(zc, 4) as z_classic, round(zr, 4) as z_robust from z8")
def w08(v, spark, sf):
    d = E.loo_prototype_distance(v("fx_emb"), "report_id")
    return E.global_z(d, ["article_number", "feature"], "d").select(
        "article_number", "report_id", "feature", R("z_classic", 4).alias("z_classic"), R("z_robust", 4).alias("z_robust"))


@query("W07_driving_feature", """select report_id, coalesce(f.feature, '') as feature, f.z from fx_rep left join (select report_id, feature, z from fx_feat where cand_rank = 1
  qualify row_number() over (partition by report_id order by abs(z) desc, fpos) = 1) f using (report_id)""")
def w07(v, spark, sf):
    from ..operators.regression import driving_feature
    return v("fx_reports").select("report_id", driving_feature(F.get("candidates", 0)["features"]).alias("d")).select("report_id", "d.*")


_S10 = "(" + scal_long_sql("fx_emb", "article_number, report_id") + " union all select article_number, report_id, 'aspect_ratio', aspect_ratio from fx_emb union all select article_number, report_id, 'area', area_mm2 from fx_emb)"
_SHEET = f"""s10 as (select * from {_S10}), l10 as (select a.article_number, a.feature, a.report_id, a.value, avg(b.value) as m, stddev_samp(b.value) as s, median(b.value) as md, count(*) as n from s10 a join s10 b on a.article_number = b.article_number and a.feature = b.feature and a.report_id <> b.report_id group by 1, 2, 3, 4),
r10 as (select l.article_number, l.feature, l.report_id, l.value, l.m, l.s, l.md, median(abs(b.value - l.md)) as mad from l10 l join s10 b on b.article_number = l.article_number and b.feature = l.feature and b.report_id <> l.report_id where l.n >= 2 group by 1, 2, 3, 4, 5, 6, 7),
{_W8}, all10 as (select article_number, feature, report_id, value, 'scalar' as kind, case when s > 0 then (value - m) / s end as zc, case when mad > 0 then (value - md) / (1.4826e0 * mad) end as zr from r10
  union all select article_number, feature, report_id, d, 'vector', zc, zr from z8),
x10 as (select *, row_number() over (partition by article_number, feature order by abs(zr) desc nulls last, report_id) as rr from all10),
sheet as (select article_number, feature, kind, count(*) as n, avg(value) as mean, stddev_samp(value) as std, min(value) as vmin, max(value) as vmax, max(case when rr = 1 then report_id end) as extreme_shot,
  max(case when rr = 1 then zc end) as zc, max(case when rr = 1 then zr end) as zr from x10 group by 1, 2, 3)"""


def _sheet(v):
    return E.enrollment_sheet(v("fx_emb"), "report_id", E.stats_long(v("fx_emb")),
                              {"aspect_ratio": F.col("aspect_ratio"), "area": F.col("area_mm2")})


@query("W10_enrollment_sheet_rows", f"""with {_SHEET}, {stats_ctes('fx_emb')} select article_number, feature, kind, sheet.n, round(sheet.mean, 5) as mean, round(sheet.std, 5) as std, round(vmin, 5) as vmin, round(vmax, 5) as vmax,
  extreme_shot, round(zc, 4) as z_classic_extreme, round(zr, 4) as z_robust_extreme, round(st.std, 5) as stored_sigma from sheet left join st using (article_number, feature)""")
def w10(v, spark, sf):
    s = _sheet(v)
    return s.select("article_number", "feature", "kind", "n", *[R(c, 5).alias(c) for c in ("mean", "std", "vmin", "vmax", "stored_sigma")],
                    "extreme_shot", R("z_classic_extreme", 4).alias("z_classic_extreme"), R("z_robust_extreme", 4).alias("z_robust_extreme"))


@query("W10_conspicuity", f"with {_SHEET} select article_number, extreme_shot, count(*) as n_features from sheet group by 1, 2")
def w10b(v, spark, sf):
    return E.conspicuity(_sheet(v))


_SYNC = f"""(select a.article_number, n_shots, {NOM} as nom, a.diameter_mm, a.width_mm, a.depth_mm, case when a.article_id % 17 = 0 then null else mean + 0.00013e0 end as mean,
  coalesce(a.diameter_mm, 0e0) <> 0 as rnd, coalesce(a.width_mm, 0e0) <> 0 and coalesce(a.depth_mm, 0e0) <> 0 as both_
  from fx_articles a join (select article_number, count(*) as n_shots, avg(circle_diameter_mm) as mean from fx_shots group by 1) s using (article_number))"""
_SY = f"""(select *, case when mean is null then 'Referenzen ohne Ø-Statistik' when n_shots < 20 then 'zu wenige Shots' when nom is null then 'keine Maße in den Stammdaten' end as skipped from {_SYNC} t)"""


def _proposal(v, spark, sf):
    st = shot_stats(v, spark, sf).select("article_number", "n_shots", "m_diameter_mm")
    num = F.substring("article_number", 5, 20).cast("long")
    return master_sync.propose(v("fx_articles"), st.withColumn("m_diameter_mm", F.when(num % 17 != 0, F.col("m_diameter_mm") + 0.00013)), 20)


@query("V15_master_sync", f"""select article_number, n_shots, skipped, case when skipped is null then round(nom, 2) end as nominal_old, case when skipped is null then round(mean, 2) end as nominal_new,
  case when skipped is null and rnd then round(mean, 2) end as new_diameter_mm, case when skipped is null and not rnd then case when both_ then round(width_mm * (mean / nom), 2) else round(mean, 2) end end as new_width_mm,
  case when skipped is null and not rnd and both_ then round(depth_mm * (mean / nom), 2) end as new_depth_mm from {_SY} t""")
def v15(v, spark, sf):
    return _proposal(v, spark, sf).drop("diff_mm")


@query("V15_master_sync_summary", f"""select count_if(skipped is null) as n, count(skipped) as n_skipped, round(avg(d), 5) as diff_mean, round(min(d), 5) as diff_min, round(max(d), 5) as diff_max
from (select skipped, case when skipped is null then round(mean, 2) - round(nom, 2) end as d from {_SY} t)""")
def v15b(v, spark, sf):
    out = master_sync.summary(_proposal(v, spark, sf))
    return out.withColumns({c: R(c, 5) for c in ("diff_mean", "diff_min", "diff_max")})


@query("T04_sync_worst_first", f"""select article_number, n_shots, nominal_old, nominal_new, round(nominal_new - nominal_old, 4) as diff_mm, row_number() over (order by abs(nominal_new - nominal_old) desc, article_number) as place
from (select article_number, n_shots, round(nom, 2) as nominal_old, round(mean, 2) as nominal_new from {_SY} t where skipped is null)""")
def t04_sync(v, spark, sf):
    """Sync rows by absolute difference, with their place in that order."""
    rows = master_sync.worst_first(_proposal(v, spark, sf)).select("article_number", "n_shots", "nominal_old", "nominal_new", "diff_mm")
    placed = ranks.global_position(rows, [], [F.abs("diff_mm").desc(), F.col("article_number")], "place")
    return placed.withColumns({"diff_mm": R("diff_mm", 4), "place": F.col("place") + 1})


def _rms(a, b):
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) / len({a}))"


_PROF = f"""pf as (select article_number, profile, circle_diameter_mm as len_ from fx_emb), pp_ as (select article_number, list(m order by pos) as proto from
  (select article_number, pos, avg(profile[pos]) as m from (select article_number, profile, unnest(range(1, 65)) as pos from pf) group by 1, 2) group by 1),
pq as (select article_number, proto, sqrt(avg(power({_rms('profile', 'proto')}, 2))) as sigma, avg(len_) as length_mm from pf join pp_ using (article_number) group by 1, 2),
pr_ as (select a.article_number as a, b.article_number as b, {_rms('a.proto', 'b.proto')} as d, {_rms('a.proto', 'b.proto')} / sqrt((a.sigma * a.sigma + b.sigma * b.sigma) / 2e0) as d_sigma,
  abs(a.length_mm - b.length_mm) as d_length from pq a join pq b on a.article_number < b.article_number)"""


def _profiles(v):
    return pairs.article_profiles(v("fx_emb"), "profile", "circle_diameter_mm")


def _pr(df):
    return df.select("a", "b", R("d", 6).alias("d"), R("d_sigma", 5).alias("d_sigma"), R("d_length", 4).alias("d_length"))


@query("J10_all_pairs_distance", f"with {_PROF} select a, b, round(d, 6) as d, round(d_sigma, 5) as d_sigma, round(d_length, 4) as d_length from pr_")
def j10(v, spark, sf):
    return _pr(pairs.all_pairs(_profiles(v)))


LIMIT = 0.95


@query("V16_duplicate_scan", f"with {_PROF} select a, b, round(d, 6) as d, round(d_sigma, 5) as d_sigma, round(d_length, 4) as d_length from pr_ where d_sigma < {LIMIT}e0")
def v16(v, spark, sf):
    return _pr(pairs.close_pairs(_profiles(v), LIMIT))


@query("W14_gap_candidates", f"""with {_PROF}, l as (select d_sigma, row_number() over (order by d_sigma, a, b) as below, lead(d_sigma) over (order by d_sigma, a, b) as upper_, count(*) over () as n from pr_ qualify below <= 25)
select below, round(d_sigma, 5) as "lower", round(upper_, 5) as "upper", round(upper_ / d_sigma, 5) as factor, round(below / n, 5) as share from l where below < least(25, n) and d_sigma > 0 order by upper_ / d_sigma desc, below limit 3""")
def w14(v, spark, sf):
    out = pairs.gap_candidates(_profiles(v), 25, 3)
    return out.withColumns({c: R(c, 5) for c in ("lower", "upper", "factor", "share")})


# pairs of suppliers sharing a nation and a neighbouring key: chains of many lengths
_EDGES = "(select a.s_suppkey as a, a.s_suppkey + 1 + (a.s_suppkey * 7) % 3 as b from supplier a where a.s_suppkey % 5 <> 4)"


@query("V17_duplicate_clusters", f"""with recursive e as (select a, b from {_EDGES} x union select b, a from {_EDGES} y),
r(n, m) as (select a, b from e union select r.n, e.b from r join e on e.a = r.m) select n as node, least(n, min(m)) as cluster from r group by 1""".replace("with recursive", "with recursive"))
def v17(v, spark, sf):
    return pairs.clusters(v(f"select * from {_EDGES} t"))


@query("V18_runnable_check", """select count(*) as n_articles, cast(sum(n) as bigint) as n_references, cast(sum(i) as bigint) as n_images, count_if(p > 0) as n_usable, case when sum(i) = 0 then 'keine Referenzbilder' when count_if(p > 0) < 2 then 'weniger als zwei verwertbare Artikel' end as reason
from (select article_number, count(*) as n, count(case when shot_id % 2 = 0 then 1 end) as i, count_if(len(profile) > 0) as p from fx_emb group by 1)""")
def v18(v, spark, sf):
    s = v("fx_emb").withColumn("image_path", F.when(F.col("shot_id") % 2 == 0, "x.png"))
    return pairs.runnable(s, "profile", "image_path")


_UN = "(select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / (sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double)))) + 1e-9)) as u from embeddings)"


@query("J18_embedding_knn", f"""with n as {_UN} select q.vec_id, i.vec_id as neighbour, i.label, round(list_sum(list_transform(list_zip(q.u, i.u), lambda t: t[1] * t[2])), 5) as similarity,
  row_number() over (partition by q.vec_id order by list_sum(list_transform(list_zip(q.u, i.u), lambda t: t[1] * t[2])) desc, i.vec_id) as "rank" from n q cross join n i qualify "rank" <= 5""")
def j18(v, spark, sf):
    e = table(spark, sf, "embeddings")
    return pairs.embedding_knn(e, e, 5).withColumn("similarity", R("similarity", 5))
