"""Identification and what-if scoring queries (V, J01-J04, J19, A08-A11, W01-W04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import distances as dist
from ..operators import analysis as A
from ..operators import enroll, joins, loo, ranks, scoring, whatif
from ..params import Params
from .base import query
from .views import stored

P = Params()

# --- shared SQL pieces --------------------------------------------------------
NOM = ("case when coalesce(diameter_mm, 0e0) <> 0 then diameter_mm "
       "when coalesce(width_mm, 0e0) <> 0 and coalesce(depth_mm, 0e0) <> 0 then greatest(width_mm, depth_mm) "
       "when coalesce(width_mm, 0e0) <> 0 then width_mm end")
CAT = f"cat as (select *, {NOM} as nominal_mm, coalesce(height_mm, 0e0) as h from fx_articles)"


def pairs_sql(measured: str, cat: str = "cat", tol: str = "6e0") -> str:
    corr = "m.circle_diameter_mm * (300e0 - least(a.h, 240e0)) / 300e0"
    f = "((300e0 - least(a.h, 240e0)) / 300e0)"
    return f"""select m.*, a.article_number as cand, a.name, a.nominal_mm, a.diameter_mm as nom_d, a.h,
  {corr} as corrected_mm, abs({corr} - a.nominal_mm) as geo_err,
  abs(m.area_mm2 * {f} * {f} - pi() * power(a.nominal_mm / 2e0, 2)) / (pi() * power(a.nominal_mm / 2e0, 2)) as area_rel
from {measured} m join {cat} a on m.circle_diameter_mm
  between (a.nominal_mm - {tol}) * 300e0 / (300e0 - least(a.h, 240e0)) - 1e-6
      and (a.nominal_mm + {tol}) * 300e0 / (300e0 - least(a.h, 240e0)) + 1e-6
where abs({corr} - a.nominal_mm) <= {tol}"""


PASSING = "not (coalesce(nom_d, 0e0) <> 0 and area_rel > 0.24e0)"


def bhatta_sql(a: str, b: str) -> str:
    fa, fb = f"cast({a} as float[])", f"cast({b} as float[])"
    da, db = f"cast({fa} as double[])", f"cast({fb} as double[])"
    mass = f"(list_sum({da}) * list_sum({db}))"
    ov = f"list_sum(list_transform(list_zip({da}, {db}), lambda t: sqrt(t[1] * t[2])))"
    return (f"sqrt(greatest(0e0, 1e0 - {ov} * case when {mass} > 1.1920928955078125e-07"
            f" then 1e0 / sqrt({mass}) else 1e0 end))")


def euclid_sql(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
            "lambda t: (t[1] - t[2]) * (t[1] - t[2]))))")


def l1_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2]))) / len({a})"


def dist_sql(feature: str, a: str, b: str) -> str:
    """Distance by a feature column/expression."""
    return (f"case when {feature} in ('delta_e_center', 'delta_e_rim') then {euclid_sql(a, b)} "
            f"when {feature} in ('hist_center', 'hist_rim') then {bhatta_sql(a, b)} "
            f"else {l1_sql(a, b)} end")


FLOOR_SQL = "case {f} " + " ".join(
    f"when '{f}' then {C.SIGMA_FLOORS[C.FLOOR_KEYS[f]]!r}e0" for f in C.ALL_FEATURES) + " end"
WEIGHT_SQL = "case {f} " + " ".join(
    f"when '{f}' then {C.FEATURE_WEIGHTS[f]!r}e0" for f in C.ALL_FEATURES) + " end"


def scal_long_sql(src: str, keys: str) -> str:
    return f"""select {keys}, 'diameter_mm' as feature, circle_diameter_mm as value from {src}
union all select {keys}, 'circularity', circularity from {src}
union all select {keys}, 'solidity', solidity from {src} where solidity > 0"""


def vec_long_sql(src: str, keys: str) -> str:
    parts = [f"select {keys}, '{f}' as feature, {col} as vec from {src} where len({col}) > 0"
             for f, (col, _) in dist.REGISTRY.items()]
    return "\nunion all ".join(parts)


def stats_ctes(src: str, p: str = "") -> str:
    """CTEs {p}sc, {p}pr, {p}sp, {p}st (article, feature, n, mean, std, proto), {p}ns."""
    return f"""{p}sl as ({scal_long_sql(src, 'article_number')}),
{p}sc as (select article_number, feature, count(*) as n, avg(value) as mean,
  coalesce(stddev_samp(value), 0e0) as std from {p}sl group by 1, 2),
{p}vl as ({vec_long_sql(src, 'article_number')}),
{p}pp as (select article_number, feature, pos, avg(vec[pos]) as m
  from (select article_number, feature, vec, unnest(range(1, len(vec) + 1)) as pos from {p}vl) group by 1, 2, 3),
{p}ok as (select article_number, feature, count(*) as n from {p}vl group by 1, 2 having min(len(vec)) = max(len(vec))),
{p}pr as (select article_number, feature, any_value(o.n) as n, list(m order by pos) as proto
  from {p}pp join {p}ok o using (article_number, feature) group by 1, 2),
{p}sp as (select v.article_number, v.feature, case when count(*) < 2 then 0e0
    else sqrt(avg(power({dist_sql('v.feature', 'v.vec', 'p.proto')}, 2))) end as std
  from {p}vl v join {p}pr p using (article_number, feature) group by 1, 2),
{p}st as (select article_number, feature, n, mean, std, cast(null as double[]) as proto from {p}sc
  union all select article_number, feature, p.n, null, s.std,
    case when feature in ('hist_center', 'hist_rim') and list_sum(p.proto) > 0
         then list_transform(p.proto, lambda x: x / list_sum(p.proto)) else p.proto end
  from {p}pr p join {p}sp s using (article_number, feature)),
{p}ns as (select article_number, count(*) as n_shots from {src} group by 1)"""


def rows_ctes(measured: str, cat: str = "cat", st: str = "st", ns: str = "ns", tol: str = "6e0",
              extra: str = "") -> str:
    """CTEs pairs and rows_ (report, candidate, feature, d, se, loc)."""
    vec = " ".join(f"when '{f}' then {c}" for f, (c, _) in dist.REGISTRY.items())
    return f"""pairs as (select * from ({pairs_sql(measured, cat, tol)}) where {PASSING}),
cands as (select p.*, n.n_shots from pairs p left join {ns} n on n.article_number = p.cand),
rows_ as (
  select report_id, cand, feature, abs(mv - mean) as d, std as se, mean as loc{extra} from (
    select c.*, s.feature, s.mean, s.std, case s.feature when 'diameter_mm' then circle_diameter_mm
      when 'circularity' then circularity when 'solidity' then case when solidity > 0 then solidity end end as mv
    from cands c join {st} s on s.article_number = c.cand and s.mean is not null) where mv is not null
  union all
  select report_id, cand, feature, d, std as se, d as loc{extra} from (
    select *, {dist_sql('feature', 'vec', 'proto')} as d from (
      select c.*, s.feature, s.std, s.proto, case s.feature {vec} end as vec
      from cands c join {st} s on s.article_number = c.cand and s.proto is not null)
    where len(vec) = len(proto))
  union all
  select report_id, cand, 'diameter_mm', geo_err, 0e0, nominal_mm{extra} from cands where n_shots is null)"""


def score_ctes(alpha: str = "2e0", rows: str = "rows_", key: str = "report_id",
               floor: str = FLOOR_SQL, weight: str = WEIGHT_SQL, contrib: str | None = None,
               params: str = "") -> str:
    """CTEs fi, we, fs, sc_, rk, rep over ``rows``; ``key`` may be several columns.

    ``floor`` and ``weight`` use {f}; ``contrib`` may use we, wr, ll, wsum.
    """
    contrib = contrib or "round(we * ll / wsum, 4)"
    fl = floor.format(f="feature")
    w = weight.format(f="feature")
    using = f"using ({key})"
    feats = ", ".join(f"('{f}')" for f in C.ALL_FEATURES)
    return f"""base as (select r.*, {fl} as fl{params} from {rows} r),
nc as (select {key}, count(distinct cand) as n_cand from base group by all),
fi as (select {key}, feature, case when count(*) >= 2 and avg(se * se + fl * fl) > 0
    then var_pop(loc) / avg(se * se + fl * fl) end as dd from base group by all),
ft as (select {key}, sum(coalesce(dd, 0e0)) as tot from fi group by all),
wr_ as (select {key}, feature, case when n_cand >= 2 and {alpha} > 0 and tot > 0
    then w * (1e0 + {alpha} * coalesce(dd, 0e0) / tot) else w end as wr,
    n_cand >= 2 and {alpha} > 0 and tot > 0 as adapt
  from (select *, {w} as w from ft join nc {using} cross join (values {feats}) ff(feature))
  left join fi using ({key}, feature)),
we_ as (select *, case when adapt then wr / sum(wr) over (partition by {key}) else wr end as we from wr_),
fs as (select *, {contrib} as wt from (select b.*, e.we, e.wr, b.d / sqrt(se * se + fl * fl) as z,
    -0.5e0 * power(b.d / sqrt(se * se + fl * fl), 2) as ll,
    sum(e.we) over (partition by {', '.join('b.' + k.strip() for k in key.split(','))}, b.cand) as wsum
  from base b join we_ e using ({key}, feature))),
sc_ as (select {key}, cand, round(sum(wt), 4) as log_score, max(round(abs(z), 4)) as max_abs_z,
    count(*) as n_feat from fs group by all),
rk as (select *, row_number() over w as rank_, round(log_score - lead(log_score) over w, 4) as margin_to_next,
    count(*) over (partition by {key}) as n_candidates
  from sc_ window w as (partition by {key} order by log_score desc, cand)),
rep as (select {key}, max(case when rank_ = 1 then cand end) as top1,
    round(max(case when rank_ = 1 then log_score end) - max(case when rank_ = 2 then log_score end), 4) as llr_margin,
    max(case when rank_ = 1 then max_abs_z end) as max_z_winner, max(n_candidates) as n_candidates,
    string_agg(cand, ',' order by rank_) as ranking from rk group by all)"""


DECIDE = ("case when top1 is null or max_z_winner > {gate} then 'reject' "
          "when (llr_margin is null or llr_margin >= {mm}) and refs then 'accept' else 'ambiguous' end")
V01_BODY = f"with {CAT}, {stats_ctes('fx_shots')}, {rows_ctes('fx_measured')}, {score_ctes()}"


def shot_stats(v, spark, sf):
    """The statistics table of the shots; it is kept, as the matcher reads it often."""
    return stored(spark, sf, "stats_shots", lambda: enroll.stats_wide(v("fx_shots")))


@query("V01_identify", f"""{V01_BODY}
select m.report_id, m.label, {DECIDE.format(gate='3.5e0', mm='2e0')} as decision, top1, llr_margin, max_z_winner,
  coalesce(n_candidates, 0) as n_candidates, coalesce(max_z_winner <= 3.5e0, false) as gate_passed
from fx_measured m left join (select rep.*, top1 in (select article_number from ns) as refs from rep) r using (report_id)""")
def v01(v, spark, sf):
    stats = shot_stats(v, spark, sf)
    out = scoring.identify(v("fx_measured"), v("fx_articles"), stats, P, nested=False, keep=["label"],
                           lengths=scoring.vector_lengths(stats))
    return out.select("report_id", "label", "decision", "top1", "llr_margin", "max_z_winner",
                      "n_candidates", "gate_passed")


NAMED = "(select article_number, cast(substr(article_number, 5) as bigint) as art from fx_articles)"
REASON = "case why when 1 then 'diameter' when 2 then 'area' end"
#: Measurements of which some lie 4 or 12 mm beyond the tolerance of their own article.
OFF = """(select report_id, label, area_mm2, circle_diameter_mm + case when report_id % 10 = 0 then 10e0 when report_id % 10 = 1 then 18e0
  else 0e0 end as circle_diameter_mm from fx_measured)"""
ALL_PAIRS = f"""select *, case when geo_err > 6e0 then 1 when not ({{PASSING}}) then 2 end as why, round(geo_err - 6e0, 2) as over_mm from (
  select m.report_id, m.art, a.art as cand, a.diameter_mm as nom_d, abs({{corr}} - a.nominal_mm) as geo_err,
  abs(m.area_mm2 * {{f}} * {{f}} - pi() * power(a.nominal_mm / 2e0, 2)) / (pi() * power(a.nominal_mm / 2e0, 2)) as area_rel
  from (select *, cast(substr(label, 5) as bigint) as art from {OFF} o) m cross join (select *, cast(substr(article_number, 5) as bigint) as art from cat) a where a.nominal_mm is not null)""".format(
    PASSING=PASSING, corr="m.circle_diameter_mm * (300e0 - least(a.h, 240e0)) / 300e0", f="((300e0 - least(a.h, 240e0)) / 300e0)")


_SHIFT = "case when report_id % 10 = 0 then 10e0 when report_id % 10 = 1 then 18e0 else 0e0 end"
OFF_WIDE = f"(select * replace (circle_diameter_mm + {_SHIFT} as circle_diameter_mm) from fx_measured)"


def off(m):
    r = F.col("report_id") % 10
    return m.withColumn("circle_diameter_mm", F.col("circle_diameter_mm") + F.when(r == 0, 10.0).when(r == 1, 18.0).otherwise(0.0))


def off_measured(v):
    return off(v("fx_measured").select("report_id", "label", "area_mm2", "circle_diameter_mm"))


def off_whole(measured):
    """``off`` for whole measurements. Those whose key comes more than once have the diameters of all rows of their key."""
    once, again = scoring.by_repeats(measured)
    if again is None:
        return off(once)
    each = again.drop("circle_diameter_mm").join(off(again).select("report_id", "circle_diameter_mm"), "report_id")
    return off(once).unionByName(each)


@query("V01_identify_nested", f"""{V01_BODY}, ap as ({ALL_PAIRS.replace(OFF, 'fx_measured')}),
kn as (select report_id, count(why) as n_kills, count(*) filter (where why = 2) as n_kills_area, count(*) filter (where why = 1 and over_mm > 6e0) as n_kills_far from ap group by 1),
kp as (select report_id, string_agg(article_number || ' ' || {REASON}, ',' order by article_number) as prefiltered
  from (select * from ap where why = 2 or (why = 1 and (over_mm <= 6e0 or cand = ap.art))) k join {NAMED} a on a.art = k.cand group by 1),
kl as (select * from kn left join kp using (report_id)),
bf as (select report_id, cand, string_agg(feature, ',' order by feature) as features, round(sum(wt), 4) as weighted from fs group by 1, 2),
cl as (select k.report_id, string_agg(concat_ws(' ', k.cand, features), ',' order by rank_) as candidates,
    round(max(case when rank_ = 1 then weighted end), 4) as top1_weighted, max(case when rank_ = 1 then coalesce(n_shots, 0) end) as top1_shots,
    round(max(case when rank_ = 1 then round(p.geo_err, 2) end), 2) as top1_geometry_error_mm
  from rk k join bf using (report_id, cand) join (select pairs.report_id, pairs.cand, geo_err, n_shots from pairs left join ns on ns.article_number = pairs.cand) p using (report_id, cand)
  group by 1)
select m.report_id, m.label, {DECIDE.format(gate='3.5e0', mm='2e0')} as decision, top1, llr_margin, candidates, top1_weighted, top1_shots, top1_geometry_error_mm,
  kl.prefiltered, n_kills, n_kills_area, n_kills_far
from fx_measured m left join (select rep.*, top1 in (select article_number from ns) as refs from rep) r using (report_id)
left join cl using (report_id) join kl using (report_id)""")
def v01n(v, spark, sf):
    """Nested report rows (candidates, feature scores, weights, message, kills), shown as one line of text and numbers each."""
    out = scoring.identify(v("fx_measured"), v("fx_articles"), shot_stats(v, spark, sf), P,
                           keep=["label"], kills=True)
    names = F.transform("candidates", lambda c: F.concat_ws(" ", c["article_number"], F.array_join(F.array_sort(c["features"]["feature"]), ",")))
    kills = F.transform("prefiltered", lambda k: F.concat_ws(" ", k["article_number"], k["reason"]))
    best = F.get("candidates", 0)
    weighted = F.aggregate(best["features"]["weighted"], F.lit(0.0), lambda a, x: a + x)
    return out.select("report_id", "label", "decision", "top1", "llr_margin", F.array_join(names, ",").alias("candidates"),
                      F.round(weighted, 4).alias("top1_weighted"), best["n_shots"].alias("top1_shots"),
                      F.round(best["geometry_error_mm"], 2).alias("top1_geometry_error_mm"),
                      F.nullif(F.array_join(kills, ","), F.lit("")).alias("prefiltered"), "n_kills", "n_kills_area", "n_kills_far")


# --- joins ------------------------------------------------------------------

@query("J01_geometry_prefilter", f"with {CAT}, p as ({pairs_sql('fx_measured')}) select report_id, cand as article_number, round(geo_err, 5) as geo_err from p")
def j01(v, spark, sf):
    m = v("fx_measured").select("report_id", "circle_diameter_mm", "area_mm2")
    return joins.geometry_pairs(m, v("fx_articles"), 6.0).select(
        "report_id", "article_number", F.round("geo_err", 5).alias("geo_err"))


@query("J02_area_gate", f"with {CAT}, p as ({pairs_sql('fx_measured')}) select report_id, cand as article_number, round(area_rel, 5) as area_rel, {PASSING} as area_ok from p")
def j02(v, spark, sf):
    m = v("fx_measured").select("report_id", "circle_diameter_mm", "area_mm2")
    return joins.area_gate(joins.geometry_pairs(m, v("fx_articles"), 6.0), 12.0).select(
        "report_id", "article_number", F.round("area_rel", 5).alias("area_rel"), "area_ok")


@query("J03_prefilter_kills", f"""with {CAT}, ap as ({ALL_PAIRS})
select report_id, article_number, {REASON} as reason, round(geo_err, 2) as geometry_error_mm, over_mm as over_tolerance_mm,
  case when why = 2 then round(area_rel * 100e0, 1) end as area_error_pct, cand = own as true_article
from (select *, ap.art as own from ap where why = 2 or (why = 1 and (over_mm <= 6e0 or cand = ap.art))) k join {NAMED} a on a.art = k.cand""")
def j03(v, spark, sf):
    kills = joins.prefilter_kills(off_measured(v), v("fx_articles"), 6.0, 12.0, label="label")
    return kills.select("report_id", "article_number", "reason", "geometry_error_mm", "over_tolerance_mm", "area_error_pct",
                        (F.col("article_number") == F.col("label")).alias("true_article"))


@query("J03_kill_counts", f"""with {CAT}, ap as ({ALL_PAIRS})
select report_id, count(why) as n_kills, count(*) filter (where why = 1) as n_kills_diameter, count(*) filter (where why = 2) as n_kills_area,
  count(*) filter (where why = 1 and over_mm > 6e0) as n_kills_far from ap group by 1""")
def j03b(v, spark, sf):
    """All kills of every report, counted without listing the far ones."""
    return joins.kill_summary(off_measured(v), v("fx_articles"), 6.0, 12.0).drop("prefiltered")


@query("A29_identified_funnel", f"""{V01_BODY.replace("from fx_measured m join", "from " + OFF_WIDE + " m join")}, ap as (select * from ({ALL_PAIRS}) where cand = art),
c as (select m.report_id, m.label, case when rank_ = 1 then 'rank_1' when rank_ is not null then 'in_set' when why = 2 then 'kill_area'
    when why = 1 and over_mm <= 6e0 then 'kill_near' when why = 1 then 'kill_far' else 'not_in_set' end as cat
  from {OFF} m left join (select report_id, cand, rank_ from rk) k on k.report_id = m.report_id and k.cand = m.label left join ap on ap.report_id = m.report_id)
select label, """ + ", ".join(f"count_if(cat = '{c}') as {c}" for c in A.FUNNEL) + " from c group by 1")
def a29b(v, spark, sf):
    """The funnel of freshly identified reports, where own articles are killed 4 and 12 mm beyond the tolerance."""
    seen = off_whole(v("fx_measured"))
    return A.prefilter_funnel(scoring.identify(seen, v("fx_articles"), shot_stats(v, spark, sf), P, keep=["label"], kills=True))


@query("J04_candidate_stats_join", f"""with {CAT}, p as (select * from ({pairs_sql('fx_measured')}) where {PASSING}), n as (select article_number, count(*) as n_shots from fx_emb group by 1)
select report_id, cand as article_number, n_shots is not null as has_references, coalesce(n_shots, 0) as n_shots, round(case when n_shots is null then corrected_mm else circle_diameter_mm end, 5) as measured_mm from p left join n on n.article_number = p.cand""")
def j04(v, spark, sf):
    m = v("fx_measured")
    n = v("fx_emb").groupBy("article_number").agg(F.count(F.lit(1)).alias("n_shots"))
    rows = scoring.attach_stats(joins.prefilter(m, v("fx_articles"), 6.0, 12.0), n)
    has = F.col("n_shots").isNotNull()
    return rows.select("report_id", "article_number", has.alias("has_references"), F.coalesce("n_shots", F.lit(0)).alias("n_shots"),
                       F.round(F.when(has, F.col("circle_diameter_mm")).otherwise(F.col("corrected_mm")), 5).alias("measured_mm"))


# --- scoring steps, on the embedding shots ------------------------------------

EMB_BODY = f"with {CAT}, {stats_ctes('fx_emb')}, {rows_ctes('fx_emb')}, {score_ctes()}"


def emb_rows(v, spark, sf):
    def build():
        e = v("fx_emb").drop("article_number", "article_id", "profile", "shot_id", "aspect_ratio")
        return scoring.candidate_rows(e, v("fx_articles"), enroll.stats_wide(v("fx_emb")), P)
    return stored(spark, sf, "emb_rows", build)


def emb_scored(v, spark, sf):
    return scoring.score(emb_rows(v, spark, sf), P)


FS = C.ALL_FEATURES


@query("A08_fisher_ratio", f"{EMB_BODY} select report_id, " + ", ".join(f"round(max(case when feature = '{f}' then dd end), 5) as {f}" for f in FS) + " from fi group by 1")
def a08(v, spark, sf):
    return emb_scored(v, spark, sf).groupBy("report_id").agg(*[F.round(F.max(f"fd_{f}"), 5).alias(f) for f in FS])


@query("A09_adaptive_weights", f"{EMB_BODY} select report_id, " + ", ".join(f"round(max(case when feature = '{f}' then we end), 6) as {f}" for f in FS) + " from we_ group by 1")
def a09(v, spark, sf):
    return emb_scored(v, spark, sf).groupBy("report_id").agg(*[F.round(F.max(f"we_{f}"), 6).alias(f) for f in FS])


@query("A10_log_score", f"{EMB_BODY} select report_id, cand as article_number, log_score, max_abs_z, n_feat from sc_")
def a10(v, spark, sf):
    n = sum((F.when(F.col(f"d_{f}").isNotNull(), 1).otherwise(0) for f in FS), F.lit(0))
    return emb_scored(v, spark, sf).select("report_id", "article_number", "log_score", "max_abs_z", n.cast("long").alias("n_feat"))


_CHW = ", ".join("round(coalesce(sum(case when feature in (" + ", ".join(f"'{f}'" for f in fs) + f") then wt end), 0e0), 4) as {ch}" for ch, fs in C.CHANNELS.items())


@query("A11_channel_scores", f"{EMB_BODY} select report_id, cand as article_number, {_CHW} from fs group by 1, 2")
def a11(v, spark, sf):
    from ..operators import reports
    return emb_scored(v, spark, sf).select("report_id", "article_number", scoring.feature_structs().alias("features")).select(
        "report_id", "article_number", *[c.alias(ch) for ch, c in reports.channel_scores(F.col("features")).items()])


@query("W01_rank_candidates", f"{EMB_BODY} select report_id, cand as article_number, rank_ as cand_rank from rk")
def w01(v, spark, sf):
    return emb_scored(v, spark, sf).select("report_id", "article_number", F.col("rank").cast("long").alias("cand_rank"))


@query("W02_margin_to_next", f"{EMB_BODY} select report_id, cand as article_number, margin_to_next from rk")
def w02(v, spark, sf):
    return emb_scored(v, spark, sf).select("report_id", "article_number", "margin_to_next")


@query("W03_softmax_posterior", f"""{EMB_BODY} select report_id, cand as article_number, round(e / sum(e) over (partition by report_id), 4) as posterior
from (select *, exp(log_score - max(log_score) over (partition by report_id)) as e from rk)""")
def w03(v, spark, sf):
    return emb_scored(v, spark, sf).select("report_id", "article_number", "posterior")


@query("W04_llr_margin", f"{EMB_BODY} select report_id, llr_margin, top1 from rep")
def w04(v, spark, sf):
    return scoring.summarise(emb_scored(v, spark, sf)).select("report_id", "llr_margin", "top1")


_EVAL = f"""{EMB_BODY}, ev as (select m.report_id, m.article_number as truth, r.top1, {DECIDE.format(gate='3.5e0', mm='2e0')} as decision
from fx_emb m left join (select rep.*, top1 in (select article_number from ns) as refs from rep) r using (report_id))"""


@query("V02_evaluate", f"{_EVAL} select truth, count(*) as n, count_if(top1 = truth) as hits, count_if(decision = 'accept') as accept, count_if(decision = 'ambiguous') as ambiguous, count_if(decision = 'reject') as reject from ev group by 1")
def v02(v, spark, sf):
    rows = whatif.case_rows(emb_scored(v, spark, sf), v("fx_emb").select("report_id", F.col("article_number").alias("truth")), ["base"])
    return rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("hits"),
                                     *[F.count_if(F.col("decision") == d).alias(d) for d in C.DECISIONS])


@query("V02_evaluate_misses", f"{_EVAL} select report_id, truth, coalesce(top1, 'NO_MATCH') as predicted, decision from ev where top1 is distinct from truth")
def v02b(v, spark, sf):
    rows = whatif.case_rows(emb_scored(v, spark, sf), v("fx_emb").select("report_id", F.col("article_number").alias("truth")), ["base"])
    return rows.where("not correct").select("report_id", "truth", F.coalesce("top1", F.lit(C.NO_MATCH)).alias("predicted"), "decision")


# --- sweeps over stored reports -----------------------------------------------

ZS, MS = whatif.grid(2.0, 6.0, 0.1), whatif.grid(0.0, 5.0, 0.1)
_FLAT = "(select report_id, session, label, pred as top1, n_cand, max_z_winner, llr_margin, decision, coalesce(has_references, false) as refs from fx_rep left join (select report_id, has_references from fx_cand where cand_rank = 1) using (report_id))"


def sweep_sql(zs: list, ms: list, by: str = "") -> str:
    g = by + ", " if by else ""
    za, ma = str([float(x) for x in zs]), str([float(x) for x in ms])
    # counting first keeps the grid join small
    return f"""with f as {_FLAT}, c as (select {g}max_z_winner as z, llr_margin as m, n_cand > 0 and max_z_winner is not null as has, refs,
  coalesce(label, '') <> '' and top1 <> label as wrong, count(*) as n from f group by all),
gr as (select cast(z as double) as max_z_accept, cast(m as double) as min_llr_margin from (select unnest({za}) as z) cross join (select unnest({ma}) as m))
select {g}max_z_accept, min_llr_margin, cast(sum(case when has and z <= max_z_accept and (m is null or m >= min_llr_margin) and refs then n else 0 end) as bigint) as accept,
  cast(sum(case when has and z <= max_z_accept and (m is null or m >= min_llr_margin) and refs and wrong then n else 0 end) as bigint) as false_accept,
  cast(sum(case when not has or z > max_z_accept then n else 0 end) as bigint) as reject,
  cast(sum(case when has and z <= max_z_accept and not ((m is null or m >= min_llr_margin) and refs) then n else 0 end) as bigint) as ambiguous, cast(sum(n) as bigint) as n
from c cross join gr group by all"""


def flat(v):
    return whatif.flat(v("fx_heads"))


@query("V03_threshold_sweep", sweep_sql(ZS, MS))
def v03(v, spark, sf):
    return whatif.threshold_sweep(flat(v), ZS, MS)


@query("V04_operating_curve", f"select min_llr_margin as threshold, round(accept / n, 6) as accept_rate, round(coalesce(false_accept / nullif(accept, 0), 0e0), 6) as false_rate from ({sweep_sql([3.5], MS)})")
def v04(v, spark, sf):
    c = whatif.operating_curve(whatif.threshold_sweep(flat(v), ZS, MS), max_z=3.5)
    return c.withColumns({"accept_rate": F.round("accept_rate", 6), "false_rate": F.round("false_rate", 6)})


@query("V05_pinning_check", "select 0::bigint as mismatches, count(*) as n from fx_rep")
def v05(v, spark, sf):
    return whatif.pinning_check(flat(v), P)


FINE = whatif.grid(1.9, 2.1, 0.01)


@query("A57_fine_grid_counts", f"select min_llr_margin, accept, false_accept from ({sweep_sql([3.5], FINE)})")
def a57(v, spark, sf):
    return whatif.fine_grid_counts(flat(v), FINE, 3.5)


_WR = f"(select * from {_FLAT} t where coalesce(label, '') <> '' and n_cand > 0 and refs and top1 <> label and llr_margin is not null and max_z_winner <= 3.5e0)"


@query("W18_knee_point", f"select report_id, label, top1 as accepted, llr_margin as knee, round(2e0 - llr_margin, 4) as distance, (select count(*) from {_WR} u) as n_wrong from {_WR} t order by llr_margin desc, report_id limit 1")
def w18(v, spark, sf):
    return whatif.knee_point(flat(v), P)


@query("W18_z_gains", f"select report_id, top1, coalesce(top1 = label, false) as correct, max_z_winner as enters_at_z from {_FLAT} t where n_cand > 0 and max_z_winner > 3.5e0 and refs and (llr_margin is null or llr_margin >= 2e0)")
def w18b(v, spark, sf):
    return whatif.z_gains(flat(v), P).select("report_id", "top1", "correct", "enters_at_z")


# --- leave-one-out ------------------------------------------------------------

LOO_CTES = f"""cat as (select *, {NOM} as nominal_mm, coalesce(height_mm, 0e0) as h from fx_stock), {stats_ctes('fx_emb')},
cs as (select * from fx_emb where article_number in (select article_number from fx_emb group by 1 having count(*) >= 13)),
lsl as (select c.report_id, s.feature, s.value from cs c join ({scal_long_sql('fx_emb', 'article_number, report_id as rid')}) s on s.article_number = c.article_number and s.rid <> c.report_id),
lsc as (select report_id, feature, avg(value) as mean, coalesce(stddev_samp(value), 0e0) as std from lsl group by 1, 2),
lvl as (select c.report_id, s.feature, s.vec from cs c join ({vec_long_sql('fx_emb', 'article_number, report_id as rid')}) s on s.article_number = c.article_number and s.rid <> c.report_id),
lpr as (select report_id, feature, list(m order by pos) as proto from (select report_id, feature, pos, avg(vec[pos]) as m from (select report_id, feature, vec, unnest(range(1, len(vec) + 1)) as pos from lvl) group by 1, 2, 3) group by 1, 2),
lsp as (select v.report_id, v.feature, sqrt(avg(power({dist_sql('v.feature', 'v.vec', 'p.proto')}, 2))) as std from lvl v join lpr p using (report_id, feature) group by 1, 2),
lst as (select report_id, feature, mean, std, cast(null as double[]) as proto from lsc union all select report_id, feature, null, s.std,
  case when feature in ('hist_center', 'hist_rim') then list_transform(p.proto, lambda x: x / list_sum(p.proto)) else p.proto end from lpr p join lsp s using (report_id, feature)),
pairs as (select * from ({pairs_sql('cs')}) where {PASSING}),
cst as (select p.*, s.feature, s.mean, s.std, s.proto from pairs p join st s on s.article_number = p.cand where p.cand <> p.article_number
  union all select p.*, s.feature, s.mean, s.std, s.proto from pairs p join lst s on s.report_id = p.report_id where p.cand = p.article_number),
rows_ as (select report_id, cand, feature, abs(mv - mean) as d, std as se, mean as loc from (select *, case feature when 'diameter_mm' then circle_diameter_mm when 'circularity' then circularity
    when 'solidity' then case when solidity > 0 then solidity end end as mv from cst where mean is not null) where mv is not null
  union all select report_id, cand, feature, d, std, d from (select *, {dist_sql('feature', 'vec', 'proto')} as d from (select *, case feature {' '.join(f"when '{f}' then {c}" for f, (c, _) in dist.REGISTRY.items())} end as vec from cst where proto is not null)))"""


def loo_base(v, spark, sf):
    def build():
        shots = v("fx_emb").drop("article_id", "profile", "shot_id", "aspect_ratio")
        return loo.loo_rows(shots, v("fx_stock"), P)
    return stored(spark, sf, "loo_rows", build)


def cases(v):
    return v("fx_emb").select("report_id", F.col("article_number").alias("truth"))


@query("J19_leave_one_out_join", f"with {LOO_CTES} select report_id, cand as article_number, feature, round(d, 5) as d, round(se, 5) as se from rows_")
def j19(v, spark, sf):
    return scoring.feature_rows(loo_base(v, spark, sf)).select(
        "report_id", "article_number", "feature", F.round("distance", 5).alias("d"), F.round("sigma_enroll", 5).alias("se"))


def variant_sql(rows: str, alpha: str = "2e0", weight: str | None = None, floor: str | None = None, contrib: str | None = None) -> str:
    body = score_ctes(alpha, "vrows", "variant, report_id", floor=floor or FLOOR_SQL, weight=weight or WEIGHT_SQL, contrib=contrib)
    return f"with {LOO_CTES}, vrows as ({rows}), {body}"


_OUT = """, o as (select c.report_id, c.article_number as truth, vv.variant, r.top1, r.llr_margin, r.max_z_winner, coalesce(r.n_candidates, 0) as n_candidates, r.ranking,
  {dec} as decision from cs c cross join (select distinct variant from vrows) vv left join rep r using (variant, report_id))"""
OUT = _OUT.format(dec="case when r.top1 is null or r.max_z_winner > 3.5e0 then 'reject' when r.llr_margin is null or r.llr_margin >= 2e0 then 'accept' else 'ambiguous' end")
_SEL = "select variant, report_id, decision, top1, llr_margin, max_z_winner from o"


def outcome(scored, v, names):
    return whatif.case_rows(scored, cases(v), names).select("variant", "report_id", "decision", "top1", "llr_margin", "max_z_winner")


_MODES = "select *, unnest(['mean', 'sum_weighted', 'sum_unweighted', 'sum_fisher']) as variant from rows_"
_MODE_C = "round(case variant when 'mean' then we * ll / wsum when 'sum_weighted' then we * ll when 'sum_unweighted' then ll else wr * ll end, 4)"


def mode_params():
    return [P.with_(name=m, mode=m) for m in ("mean", "sum_weighted", "sum_unweighted", "sum_fisher")]


@query("V06_scoring_variants", variant_sql(_MODES, contrib=_MODE_C) + OUT + _SEL)
def v06(v, spark, sf):
    ps = mode_params()
    return outcome(scoring.score(loo_base(v, spark, sf), ps), v, [p.name for p in ps])


# a given inverse: unit diagonal, -0.2 between neighbours in feature order
INVERSE = {a: {b: (1.0 if a == b else -0.2 if abs(FS.index(a) - FS.index(b)) == 1 else 0.0) for b in FS} for a in FS}
_POS = "case {c} " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(FS)) + " end"
_MAHA = f"""{variant_sql("select *, 'maha' as variant from rows_")}, mq as (select a.report_id, a.cand, round(-0.5e0 * sum(round(a.z, 4) * round(b.z, 4) * sqrt(a.we * b.we)
    * case when a.feature = b.feature then 1e0 when abs({_POS.format(c='a.feature')} - {_POS.format(c='b.feature')}) = 1 then -0.2e0 else 0e0 end), 4) as log_score
  from fs a join fs b on a.report_id = b.report_id and a.cand = b.cand group by 1, 2)"""


@query("V07_mahalanobis_score", f"{_MAHA} select report_id, cand as article_number, log_score from mq")
def v07(v, spark, sf):
    sc = scoring.score(loo_base(v, spark, sf), P.with_(name="maha", mode="maha"), inverse=INVERSE)
    return sc.select("report_id", "article_number", "log_score")


@query("V07_mahalanobis_pooled")
def v07b(v, spark, sf):
    """The inverse comes from the pooled second moments of the data, plain and shrunk."""
    z = whatif.z_vectors(loo_base(v, spark, sf), P)
    mom = whatif.second_moments(z)
    plain, _ = whatif.inverse_matrix(mom)
    shrunk, _ = whatif.inverse_matrix(mom, shrink=0.5)
    reduced, _ = whatif.inverse_matrix(mom, only_above=whatif.correlation_matrix(z))
    out = None
    for name, inv in (("maha", plain), ("maha_shrink", shrunk), ("maha_reduced", reduced)):
        part = outcome(scoring.score(loo_base(v, spark, sf), P.with_(name=name, mode="maha"), inverse=inv), v, [name])
        out = part if out is None else out.unionByName(part)
    return out


def _rule(name: str, se: str, where: str = ""):
    return variant_sql(f"select report_id, cand, feature, d, {se} as se, loc, '{name}' as variant from rows_ {where}") + OUT + _SEL


def _ruled(rows, v, name):
    return outcome(scoring.score(rows, P.with_(name=name)), v, [name])


_FLR = FLOOR_SQL.format(f="feature")


@query("V08_sigma_cap_median", _rule("cap_median", "least(se, 1.1e0 * md)", "join (select feature, median(std) as md from st group by 1) using (feature)"))
def v08a(v, spark, sf):
    st = enroll.stats_wide(v("fx_emb"))
    return _ruled(whatif.cap_at_median(loo_base(v, spark, sf), st, 1.1), v, "cap_median")


@query("V08_sigma_cap_floor", _rule("cap_floor", f"least(se, 0.5e0 * {_FLR})"))
def v08b(v, spark, sf):
    return _ruled(whatif.cap_at_floor(loo_base(v, spark, sf), 0.5, P), v, "cap_floor")


@query("V08_sigma_same_pool", _rule("pool", "sqrt(avg(se * se) over (partition by report_id, feature))"))
def v08c(v, spark, sf):
    return _ruled(whatif.same_sigma(loo_base(v, spark, sf), "pool"), v, "pool")


@query("V08_sigma_same_median", _rule("med", "median(se) over (partition by report_id, feature)"))
def v08c2(v, spark, sf):
    return _ruled(whatif.same_sigma(loo_base(v, spark, sf), "median"), v, "med")


@query("V08_sigma_drop_wide", _rule("drop", "se", f"where not (se > 1e0 * {_FLR})"))
def v08d(v, spark, sf):
    return _ruled(whatif.drop_wide(loo_base(v, spark, sf), 1.0, P), v, "drop")


_V9 = """select r.report_id, r.cand, r.feature, r.d, r.se, r.loc, variant from rows_ r join (select report_id, cand, geo_err from pairs) p using (report_id, cand)
  cross join (values ('base'), ('color_half'), ('floor_half'), ('tol_4'), ('no_color')) vv(variant)
  where (variant <> 'tol_4' or geo_err <= 4e0) and (variant <> 'no_color' or feature not in ('delta_e_center', 'delta_e_rim', 'hist_center', 'hist_rim'))"""
_COL = "{f} in ('delta_e_center', 'delta_e_rim', 'hist_center', 'hist_rim')"
_W9 = f"(case when variant = 'no_color' then case when {_COL} then 0e0 else 1e0 / 0.7e0 end when variant = 'color_half' then case when {_COL} then 0.5e0 else 1e0 end / 0.85e0 else 1e0 end * ({WEIGHT_SQL}))"
_F9 = f"(case when variant = 'floor_half' then 0.5e0 else 1e0 end * ({FLOOR_SQL}))"


@query("V09_variant_params", variant_sql(_V9, weight=_W9, floor=_F9) + OUT + _SEL)
def v09(v, spark, sf):
    ps = [P, P.variant("color_half", color=0.5), P.variant("floor_half", floor=0.5), P.variant("tol_4", tol=4.0),
          P.variant("no_color", features=tuple(f for f in FS if f not in C.COLOR_FEATURES))]
    return outcome(scoring.score(loo_base(v, spark, sf), ps), v, [p.name for p in ps])


_W10 = "(case substr(variant, 1, 2) " + " ".join(f"when '{s}' then case {{f}} " + " ".join(f"when '{f}' then {w / sum(ws.values())!r}::double" for f, w in ws.items()) + " end" for s, ws in C.WEIGHT_SCHEMES.items()) + " end)"
_V10 = "select r.*, concat(s, '/', cast(a as string)) as variant from rows_ r cross join (select unnest(['S0', 'S1', 'S2', 'S3', 'S4']) as s) cross join (select unnest([0, 2, 8, 32]) as a)"
_A10 = "cast(substr(variant, 4) as double)"


def scheme_params():
    return [P.with_(name=f"{s}/{int(a)}", weights=dict(w), alpha=a) for s, w in C.WEIGHT_SCHEMES.items() for a in C.WEIGHT_ALPHAS]


@query("V10_weight_schemes", variant_sql(_V10, alpha=_A10, weight=_W10) + OUT + """select variant, count(*) as n, count_if(top1 = truth) as top1, count_if(decision = 'accept') as accept,
  count_if(decision = 'ambiguous') as ambiguous, count_if(decision = 'reject') as reject, count_if(decision = 'accept' and top1 <> truth) as false_accept, round(median(llr_margin), 6) as llr_med from o group by 1""")
def v10(v, spark, sf):
    ps = scheme_params()
    rows = whatif.case_rows(scoring.score(loo_base(v, spark, sf), ps), cases(v), [p.name for p in ps])
    m = whatif.run_measures(rows, P)
    return m.select("variant", "n", "top1", "accept", "ambiguous", "reject", "false_accept", F.round("llr_p50", 6).alias("llr_med"))


_XD, _XS = "((report_id * 7 + strlen(cand) + cast(substr(cand, 5) as bigint) * 13) % 100) / 100e0", "0.2e0 + (report_id % 7) / 20e0"
_V11 = f"select *, 'extra' as variant from rows_ union all select report_id, cand, 'w_profile', {_XD}, {_XS}, {_XD}, 'extra' from (select distinct report_id, cand from rows_)"
_W11 = "(case {f} " + " ".join(f"when '{f}' then {w!r}e0" for f, w in C.FEATURE_WEIGHTS.items()) + " when 'w_profile' then 0.25e0 end / 1.25e0)"
_F11 = "(case {f} " + " ".join(f"when '{f}' then {C.SIGMA_FLOORS[C.FLOOR_KEYS[f]]!r}e0" for f in FS) + " when 'w_profile' then 0.5e0 end)"


@query("V11_extra_feature", variant_sql(_V11, weight=_W11, floor=_F11).replace("('hu_log')) ff", "('hu_log'), ('w_profile')) ff") + OUT + _SEL)
def v11(v, spark, sf):
    base = loo_base(v, spark, sf)
    num = F.substring("article_number", 5, 20).cast("long")
    lookup = base.select("report_id", "article_number",
                         (((F.col("report_id") * 7 + F.length("article_number") + num * 13) % 100) / 100.0).alias("distance"),
                         (F.lit(0.2) + (F.col("report_id") % 7) / 20.0).alias("sigma"))
    rows = whatif.with_extra_feature(base, lookup, "w_profile")
    fs = (*FS, "w_profile")
    p = P.with_(name="extra", features=fs, weights={**P.weights, "w_profile": 0.25}, floors={**P.floors, "w_profile": 0.5})
    return outcome(scoring.score(rows, p, fs), v, ["extra"])


_PW = f"""{variant_sql("select *, 'pair' as variant from rows_")}, prows as (select r.report_id, r.cand, r.feature, r.d, r.se, r.loc from rows_ r join rk k on k.report_id = r.report_id and k.cand = r.cand where k.rank_ <= 2),
{score_ctes('8e0', 'prows').replace('base as', 'base2 as').replace('from base ', 'from base2 ').replace('nc as', 'nc2 as').replace('join nc ', 'join nc2 ').replace('fi as', 'fi2 as').replace('from fi ', 'from fi2 ').replace('join fi ', 'join fi2 ').replace('ft as (', 'ft2 as (').replace('from ft ', 'from ft2 ').replace('wr_ as', 'wr2 as').replace('from wr_', 'from wr2').replace('we_ as', 'we2 as').replace('join we_', 'join we2').replace('fs as (', 'fs2 as (').replace('from fs ', 'from fs2 ').replace('sc_ as', 'sc2 as').replace('from sc_', 'from sc2').replace('rk as', 'rk2 as').replace('from rk ', 'from rk2 ').replace('rep as', 'rep2 as')}"""


@query("V12_pairwise_rescore", f"""{_PW}, ns2 as (select k.report_id, k.cand, k.rank_, k.n_candidates, case when k.n_candidates >= 2 and f.tot > 0 then s.log_score else k.log_score end as score
  from rk k join sc2 s using (report_id, cand) join ft2 f using (report_id) where k.rank_ <= 2),
o2 as (select *, row_number() over (partition by report_id order by score desc, rank_) as nr from ns2)
select report_id, max(case when nr = 1 then cand end) as top1, round(max(case when nr = 1 then score end) - max(case when nr = 2 then score end), 4) as llr_margin, max(case when nr = 1 then rank_ end) <> 1 as swapped from o2 group by 1""")
def v12(v, spark, sf):
    out = whatif.pairwise_rescore(scoring.score(loo_base(v, spark, sf), P), 8.0)
    return out.select("report_id", "top1", "llr_margin", "swapped")


_TB = f"""{variant_sql("select *, 'base' as variant from rows_")}{OUT}, amb as (select report_id from o where decision = 'ambiguous'),
sep as (select a.report_id, a.feature, ka.cand as ca, kb.cand as cb, -0.5e0 * power(a.d / sqrt(a.se * a.se + {FLOOR_SQL.format(f='a.feature')} * {FLOOR_SQL.format(f='a.feature')}), 2) as la,
    -0.5e0 * power(b.d / sqrt(b.se * b.se + {FLOOR_SQL.format(f='a.feature')} * {FLOOR_SQL.format(f='a.feature')}), 2) as lb,
    case when sa.mean is not null then abs(sa.mean - sb.mean) else {dist_sql('a.feature', 'sa.proto', 'sb.proto')} end
      / sqrt((a.se * a.se + b.se * b.se + 2 * {FLOOR_SQL.format(f='a.feature')} * {FLOOR_SQL.format(f='a.feature')}) / 2e0) as sep
  from amb join rk ka on ka.report_id = amb.report_id and ka.rank_ = 1 join rk kb on kb.report_id = amb.report_id and kb.rank_ = 2
  join rows_ a on a.report_id = amb.report_id and a.cand = ka.cand join rows_ b on b.report_id = amb.report_id and b.cand = kb.cand and b.feature = a.feature
  join st sa on sa.article_number = ka.cand and sa.feature = a.feature join st sb on sb.article_number = kb.cand and sb.feature = a.feature),
tb as (select report_id, case when sum(la) >= sum(lb) then any_value(ca) else any_value(cb) end as winner, abs(sum(la) - sum(lb)) as lead from
  (select *, row_number() over (partition by report_id order by sep desc) as rn from sep) where rn <= 2 group by 1)"""


def _tiebreak(v, spark, sf):
    return whatif.tiebreak(scoring.score(loo_base(v, spark, sf), P), enroll.stats_wide(v("fx_emb")), P, 2)


@query("V13_tiebreak", f"{_TB} select report_id, winner, round(lead, 5) as lead from tb")
def v13(v, spark, sf):
    return _tiebreak(v, spark, sf).select("report_id", "winner", F.round("lead", 5).alias("lead"))


@query("V13_tiebreak_curve", f"""{_TB} select t as threshold, count_if(lead >= t) as solved, count_if(lead >= t and winner = article_number) as right, count_if(lead >= t and winner <> article_number) as wrong, count_if(lead < t) as open
from tb join cs using (report_id) cross join (select unnest([0e0, 0.5e0, 1e0, 2e0, 5e0]) as t) group by 1""")
def v13b(v, spark, sf):
    return whatif.tiebreak_curve(_tiebreak(v, spark, sf), cases(v), (0.0, 0.5, 1.0, 2.0, 5.0)).drop("variant")


@query("V14_simulator_equals_matcher", "select count(*) as n, 0::bigint as differ from fx_emb")
def v14(v, spark, sf):
    """Single-run form against the variant form on the same rows."""
    rows = emb_rows(v, spark, sf)
    a = scoring.summarise(scoring.score(rows, P)).select("report_id", F.struct("ranking", "llr_margin", "max_z_winner").alias("a"))
    b = scoring.summarise(scoring.score(rows, mode_params())).where("variant = 'mean'").select(
        "report_id", F.struct("ranking", "llr_margin", "max_z_winner").alias("b"))
    j = v("fx_emb").select("report_id").join(a, "report_id", "left").join(b, "report_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))


def mode_rows(v, spark, sf):
    def build():
        ps = mode_params()
        return whatif.case_rows(scoring.score(loo_base(v, spark, sf), ps), cases(v), [p.name for p in ps])
    return stored(spark, sf, "mode_rows", build)


_MO = variant_sql(_MODES, contrib=_MODE_C) + OUT


@query("A48_run_kennzahlen", f"""{_MO} select variant, count(*) as n, count_if(top1 = truth) as top1, count_if(list_contains(string_split(ranking, ',')[1:3], truth)) as top3, count_if(decision = 'accept') as accept,
  count_if(decision = 'accept' and top1 <> truth) as false_accept, round(quantile_cont(llr_margin, 0.1), 5) as llr_p10, round(quantile_cont(llr_margin, 0.9), 5) as llr_p90,
  round(median(max_z_winner), 5) as mz_p50, round(quantile_cont(max_z_winner, 0.99), 5) as mz_p99, count_if(llr_margin >= 2e0) as llr_ge_min, count_if(max_z_winner > 3.5e0) as over_gate,
  round(avg(n_candidates), 5) as set_size from o group by 1""")
def a48(v, spark, sf):
    m = whatif.run_measures(mode_rows(v, spark, sf), P)
    return m.select("variant", "n", "top1", "top3", "accept", "false_accept",
                    *[F.round(c, 5).alias(c) for c in ("llr_p10", "llr_p90", "mz_p50", "mz_p99")],
                    "llr_ge_min", "over_gate", F.round("set_size", 5).alias("set_size"))


@query("W11_k_safe", f"""{_MO}, c as (select variant, top1 = truth as ok, row_number() over (partition by variant order by coalesce(llr_margin, 'inf'::double) desc, report_id) as rn from o where decision <> 'reject')
select variant, coalesce(min(case when not ok then rn - 1 end), count(*)) as k_safe, count(*) as n_cases from c group by 1""")
def w11(v, spark, sf):
    return ranks.k_safe(mode_rows(v, spark, sf), ["variant"], margin="llr_margin", correct="correct", decision="decision", order="report_id")


@query("W11_k_safe_all", f"""{_MO}, c as (select variant, coalesce(top1 = truth, false) as ok, row_number() over (partition by variant order by coalesce(llr_margin, 'inf'::double) desc, report_id) as rn from o)
select variant, coalesce(min(case when not ok then rn - 1 end), count(*)) as k_safe, count(*) as n_cases from c group by 1""")
def w11b(v, spark, sf):
    return ranks.k_safe(mode_rows(v, spark, sf), ["variant"], margin="llr_margin", correct="correct", decision="decision", order="report_id", include_rejects=True)


@query("W12_equivalent_threshold", f"""{_MO}, m as (select variant, report_id, coalesce(llr_margin, 'inf'::double) as m from o), n as (select variant, count_if(m >= 2e0) as n_accept from m group by 1),
b as (select report_id, m as bm, row_number() over (order by m desc) as rn from m where variant = 'mean'), t as (select n.*, (select bm from b where rn = n_accept) as threshold from n)
select t.variant, n_accept, round(threshold, 5) as threshold, count_if(m.m >= 2e0 and b.bm >= t.threshold) as overlap from t join m using (variant) join b using (report_id) group by 1, 2, 3""")
def w12(v, spark, sf):
    out = whatif.equivalent_threshold(mode_rows(v, spark, sf), "mean", 2.0)
    return out.withColumn("threshold", F.round("threshold", 5))


@query("W13_spearman", f"""{_MO}, j as (select a.variant, a.llr_margin as a, b.llr_margin as b from o a join o b on b.report_id = a.report_id and b.variant = 'mean' where a.variant <> 'mean' and a.llr_margin is not null and b.llr_margin is not null),
r as (select variant, rank() over (partition by variant order by a) + (count(*) over (partition by variant, a) - 1) / 2e0 as ra, rank() over (partition by variant order by b) + (count(*) over (partition by variant, b) - 1) / 2e0 as rb from j)
select variant, round(corr(ra, rb), 5) as rho, count(*) as n from r group by 1""")
def w13(v, spark, sf):
    return whatif.spearman(mode_rows(v, spark, sf), "mean").withColumn("rho", F.round("rho", 5))


_ZV = f"""with {LOO_CTES}, zz as (select r.report_id, c.article_number as truth, r.feature, r.d / sqrt(r.se * r.se + {FLOOR_SQL.format(f='r.feature')} * {FLOOR_SQL.format(f='r.feature')}) as z
  from rows_ r join cs c on c.report_id = r.report_id and c.article_number = r.cand), full_ as (select report_id from zz group by 1 having count(*) = 8), z as (select zz.* from zz join full_ using (report_id)),
zp as (select a.truth, a.feature as a, b.feature as b, a.z as za, b.z as zb from z a join z b using (report_id))"""
_ORD = "{a} < {b}".format(a=_POS.format(c="a"), b=_POS.format(c="b"))


@query("A46_correlation_matrix", f"{_ZV} select a, b, round(corr(za, zb), 5) as r from zp where {_ORD} group by 1, 2")
def a46(v, spark, sf):
    return whatif.correlation_matrix(whatif.z_vectors(loo_base(v, spark, sf), P)).withColumn("r", F.round("r", 5))


@query("A47_second_moment_matrix", f"""{_ZV}, s as (select truth, a, b, sum(za * zb) as s from zp group by 1, 2, 3), t as (select a, b, sum(s) as s from s group by 1, 2),
l as (select s.truth as left_out, a, b, t.s - s.s as s from s join t using (a, b) union all select null, a, b, s from t)
select l.left_out, l.a, l.b, round(l.s / sqrt(x.s * y.s), 5) as c from l join l x on x.left_out is not distinct from l.left_out and x.a = l.a and x.b = l.a
join l y on y.left_out is not distinct from l.left_out and y.a = l.b and y.b = l.b where {_POS.format(c='l.a')} <= {_POS.format(c='l.b')}""")
def a47(v, spark, sf):
    return whatif.second_moments(whatif.z_vectors(loo_base(v, spark, sf), P)).withColumn("c", F.round("c", 5))
