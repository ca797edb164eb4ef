"""Report-analysis queries (A12-A37, A56, A58, A61, J05, J08, J09, J11, J12, T, W15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import analysis as A
from ..operators import enroll, reports
from ..params import Params
from .base import query
from .functions import wilson_sql
from .identify import CAT, NOM, dist_sql, stats_ctes

P = Params()


def r4(df, *cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("A12_batch_summary", """select session, count(*) as total, count(ok) as labeled, count_if(ok) as correct, count_if(decision = 'accept') as accept,
  count_if(decision = 'ambiguous') as ambiguous, count_if(decision = 'reject') as reject,
  round(case when count(ok) > 0 then count_if(ok) / count(ok) else 0e0 end, 6) as accuracy from fx_judged group by 1""")
def a12(v, spark, sf):
    return r4(A.batch_summary(v("fx_heads"), "session"), "accuracy", digits=6)


@query("A13_top_k_accuracy", """select count_if(exists(select 1 from fx_cand c where c.report_id = r.report_id and c.cand_rank <= 3 and c.article_number = r.label)) as hits,
  count(*) as scored from fx_rep r where coalesce(label, '') <> ''""")
def a13(v, spark, sf):
    return A.top_k_accuracy(v("fx_heads"), 3)


_LOWQ = ", ".join(f"max(case when rn = cast(floor({q}e0 * (n - 1)) as bigint) then x end) as {name}" for name, q in
                  (("minimum", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("maximum", 1.0)))


@query("A14_max_z_distribution", f"""select session, max(n) as n, {_LOWQ} from (select session, max_z_winner as x,
  row_number() over (partition by session order by max_z_winner) - 1 as rn, count(*) over (partition by session) as n
  from fx_rep where max_z_winner is not null) group by 1""")
def a14(v, spark, sf):
    return A.max_z_distribution(v("fx_heads"), "session")


def _round_sql(side: str, cond: str) -> str:
    base = f"(select * from fx_judged where {cond})"
    qs = "\nunion all ".join(
        f"select 'max_z_{n}', {n} from q_{side}" for n in ("minimum", "p25", "median", "p75", "maximum"))
    return f"""q_{side} as (select {_LOWQ} from (select max_z_winner as x, row_number() over (order by max_z_winner) - 1 as rn, count(*) over () as n
  from {base} where max_z_winner is not null)),
m_{side} as (select unnest(['total', 'labeled', 'accuracy_pct', 'accept_pct', 'ambiguous_pct', 'reject_pct']) as metric,
    unnest([count(*) * 1e0, count(ok) * 1e0, count_if(ok) * 100e0 / count(ok), count_if(decision = 'accept') * 100e0 / count(*),
      count_if(decision = 'ambiguous') * 100e0 / count(*), count_if(decision = 'reject') * 100e0 / count(*)]) as value from {base}
  union all select 'top_k_pct', count_if(exists(select 1 from fx_cand c where c.report_id = r.report_id and c.cand_rank <= 3 and c.article_number = r.label)) * 100e0 / count(*)
    from {base} r where coalesce(label, '') <> ''
  union all {qs})"""


@query("A15_ab_compare", f"""with {_round_sql('a', "session < 'S20'")}, {_round_sql('b', "session >= 'S20'")}
select metric, round(a.value, 4) as a, round(b.value, 4) as b, round(case when abs(b.value - a.value) >= 0.05e0 then b.value - a.value end, 4) as delta
from m_a a join m_b b using (metric)""")
def a15(v, spark, sf):
    r = v("fx_heads")
    return r4(A.ab_compare(r.where("session < 'S20'"), r.where("session >= 'S20'")), "a", "b", "delta")


_CONF = "(select label, pred, count(*) as n, count_if(decision = 'accept') as n_accept from fx_judged where coalesce(label, '') <> '' group by 1, 2)"


@query("A16_confusion_matrix", f"select * from {_CONF} t")
def a16(v, spark, sf):
    return A.confusion(v("fx_heads"))


@query("A17_confusion_focus", f"""select label, pred, n, row_total, diag = 0 as never_hit from (select *, sum(n) over (partition by label)::bigint as row_total,
  sum(case when pred = label then n else 0 end) over (partition by label)::bigint as diag from {_CONF} t) where diag < row_total""")
def a17(v, spark, sf):
    return A.confusion_focus(v("fx_heads"))


def hist_sql(rows: str, flag: str, bins: int, lo: str = "min(value)", hi: str = "max(value)", panel: str = "panel") -> str:
    return f"""select {panel}, {flag}, cast(greatest(0, least({bins - 1}, coalesce(floor((value - lo) * {bins} / nullif(hi - lo, 0e0)), 0))) as bigint) as bin, count(*) as n
from {rows} join (select {panel}, {lo} as lo, case when {hi} = 0 then 1e0 else {hi} end as hi from {rows} group by 1) b using ({panel}) group by 1, 2, 3"""


@query("A18_score_distribution", "with h as (select 'max_z_winner' as panel, ok, max_z_winner as value from fx_judged where ok is not null and max_z_winner is not null "
       "union all select 'llr_margin', ok, llr_margin from fx_judged where ok is not null and llr_margin is not null) " + hist_sql("h", "ok", 19))
def a18(v, spark, sf):
    return A.score_histograms(v("fx_heads"))


@query("A18_score_distribution_raw", "with j as (select *, pred = label as hit from fx_judged where coalesce(label, '') <> ''), "
       "h as (select 'max_z_winner' as panel, hit as ok, max_z_winner as value from j where max_z_winner is not null "
       "union all select 'llr_margin', hit, llr_margin from j where llr_margin is not null) " + hist_sql("h", "ok", 21))
def a18b(v, spark, sf):
    return A.score_histograms(v("fx_heads"), 21, against_label=True)


@query("A18_score_rows", """select report_id, ok as korrekt, decision, top_log_score as log_score, max_z_winner, llr_margin from fx_judged""")
def a18c(v, spark, sf):
    return A.score_rows(v("fx_heads")).select("report_id", "korrekt", "decision", "log_score", "max_z_winner", "llr_margin")


def quota_union(rows: list[tuple[str, str, str]], src: str, corpus: bool = False, by: str = "") -> str:
    w = wilson_sql("k", "n", corpus)
    inner = "\nunion all ".join(f"select {by + ', ' if by else ''}'{m}' as metric, {k} as k, {n} as n from {src}"
                                + (f" group by {by}" if by else "") for m, k, n in rows)
    return (f"select {by + ', ' if by else ''}metric, k, n, {w['p']} as p, {w['lo']} as wilson_lo, {w['hi']} as wilson_hi from ({inner})")


_T3 = """(select r.*, coalesce(label, '') <> '' as lab, (exists(select 1 from fx_cand c where c.report_id = r.report_id and c.cand_rank <= 3 and c.article_number = r.label)
  or (n_cand = 0 and label = 'NO_MATCH')) as top3 from fx_judged r)"""
_QROWS = [("accuracy_top1", "count_if(ok)", "count(ok)"), ("accuracy_top3", "count_if(lab and top3)", "count_if(lab)"),
          ("auto_accept_rate", "count_if(decision = 'accept')", "count(*)"),
          ("false_accept_rate", "count_if(decision = 'accept' and ok = false)", "count(case when decision = 'accept' then ok end)")]


@query("A19_quotas", f"""with t3 as {_T3}, q as ({quota_union(_QROWS, 't3', by='session')})
select *, round(case when metric = 'false_accept_rate' and k = 0 and n > 0 then 3e0 / n when metric = 'accuracy_top1' and k = n and n > 0 then 3e0 / n end, 6) as rule_of_three from q""")
def a19(v, spark, sf):
    return A.quotas(v("fx_heads"), "session")


_PA = wilson_sql("k", "n")


@query("A20_per_article_quota", f"""select label, k, n, {_PA['p']} as p, {_PA['lo']} as wilson_lo, {_PA['hi']} as wilson_hi
from (select label, count_if(ok) as k, count(*) as n from fx_judged where coalesce(label, '') <> '' and ok is not null group by 1)""")
def a20(v, spark, sf):
    return A.per_article_quota(v("fx_heads"))


TIER2 = [("accuracy_top1", "count_if(lab and pred = label)", "count_if(lab)"), ("accuracy_top3", "count_if(lab and top3)", "count_if(lab)"),
         ("auto_accept_rate", "count_if(decision = 'accept')", "count(*)"),
         ("false_accept_rate", "count_if(decision = 'accept' and lab and n_cand > 0 and pred <> label)", "count_if(decision = 'accept')"),
         ("accuracy_top1_verdict", "count_if(ok)", "count(ok)")]


@query("A21_tier2_quotas", f"with t3 as {_T3} {quota_union(TIER2, 't3', True, 'session')}")
def a21(v, spark, sf):
    from ..operators import regression
    return regression.tier2_quotas(v("fx_heads"), "session")


@query("A22_verdict_by_prediction", """select case when grouping(pred) = 1 then 'gesamt' when pred = 'NO_MATCH' then '— kein Kandidat' else pred end as artikel,
  cast(grouping(pred) as bigint) as is_total, count_if(ok) as richtig, count_if(ok = false) as falsch, count_if(ok is null) as unbewertet,
  round(count_if(ok) / nullif(count(ok), 0), 6) as quote from fx_judged group by rollup(pred)""")
def a22(v, spark, sf):
    return r4(A.verdict_by_prediction(v("fx_heads")), "quote", digits=6)


@query("A23_margin_by_setsize", """select cast(n_cand as bigint) as set_size, count(*) as n, round(median(llr_margin), 6) as median
from fx_rep where n_cand > 0 and llr_margin is not null group by 1""")
def a23(v, spark, sf):
    out = A.margin_by_setsize(v("fx_heads"))
    return r4(out, "median", digits=6)


@query("A24_diameter_vs_nominal", """select report_id, label, circle_diameter_mm as measured_mm, nominal_mm from fx_rep join
  (select label, arg_max(nominal_size_mm, (stem, report_id)) as nominal_mm from (select r.label, r.stem, r.report_id, c.nominal_size_mm
    from fx_rep r join fx_cand c on c.report_id = r.report_id and c.article_number = r.label) group by 1) using (label)""")
def a24(v, spark, sf):
    return A.diameter_vs_nominal(v("fx_heads"))


_TR = """(select r.*, t.cand_rank as tr from fx_judged r left join fx_cand t on t.report_id = r.report_id and t.article_number = r.label
  where coalesce(r.label, '') <> '')"""


@query("A25_true_rank_buckets", f"""select label, cast(grouping(label) as bigint) as is_total, count_if(tr = 1) as rank_1, count_if(tr = 2) as rank_2, count_if(tr = 3) as rank_3,
  count_if(tr > 3) as rank_more, count_if(tr is null) as not_in_set from {_TR} t group by rollup(label)""")
def a25(v, spark, sf):
    return A.true_rank_buckets(v("fx_heads"))


@query("A26_decision_per_article", """select label, count_if(decision = 'accept') as accept, count_if(decision = 'ambiguous') as ambiguous, count_if(decision = 'reject') as reject,
  round(count_if(decision = 'accept') / count(*), 6) as accept_share from fx_rep where coalesce(label, '') <> '' group by 1""")
def a26(v, spark, sf):
    return r4(A.decision_per_article(v("fx_heads")), "accept_share", digits=6)


def upper_median_sql(src: str, keys: str, x: str, out: str) -> str:
    return f"""select {keys}, max(n) as n, round(max(case when rn = n // 2 then x end), 5) as {out} from (select {keys}, {x} as x,
  row_number() over (partition by {keys} order by {x}) - 1 as rn, count(*) over (partition by {keys}) as n from {src}) group by all"""


_FK = "case feature " + " ".join(f"when '{f}' then '{k}'" for f, k in C.FLOOR_KEYS.items()) + " end"


@query("A27_recover_sigma_floors", f"with s as (select {_FK} as floor_key, sqrt(sigma_eff * sigma_eff - sigma_enroll * sigma_enroll) as f from fx_feat "
       "where sigma_eff * sigma_eff - sigma_enroll * sigma_enroll > 0) " + upper_median_sql("s", "floor_key", "f", "floor"))
def a27(v, spark, sf):
    return r4(A.recover_sigma_floors(v("fx_reports")), "floor", digits=5)


@query("A28_recover_scale", "with s as (select session, circle_diameter_mm / (400e0 + (k * 7) % 50) as f from fx_rep) "
       + upper_median_sql("s", "session", "f", "mm_per_px"))
def a28(v, spark, sf):
    px = F.lit(400.0) + (F.col("k") * 7) % 50
    return r4(A.recover_scale(v("fx_heads"), px), "mm_per_px", digits=5)


_FUN = """(select r.label, case when t.cand_rank = 1 then 'rank_1' when t.cand_rank is not null then 'in_set' when kl.reason is null then 'not_in_set'
  when kl.reason = 'area' then 'kill_area' when kl.over_tolerance_mm <= kl.tolerance_mm then 'kill_near' else 'kill_far' end as cat
from fx_rep r left join fx_cand t on t.report_id = r.report_id and t.article_number = r.label
left join (select report_id, article_number, first(reason order by kill_pos) as reason, first(over_tolerance_mm order by kill_pos) as over_tolerance_mm,
  first(tolerance_mm order by kill_pos) as tolerance_mm from fx_kill group by 1, 2) kl on kl.report_id = r.report_id and kl.article_number = r.label
where coalesce(r.label, '') <> '')"""


@query("A29_prefilter_funnel", "select label, " + ", ".join(f"count_if(cat = '{c}') as {c}" for c in A.FUNNEL) + f" from {_FUN} t group by 1")
def a29(v, spark, sf):
    return A.prefilter_funnel(v("fx_heads"))


@query("A30_prefilter_kill_view", """select report_id, kill_pos, article_number, reason, coalesce(label = article_number, false) as true_article from fx_kill""")
def a30(v, spark, sf):
    k = A.kill_view(v("fx_heads"))
    return k.withColumn("true_article", F.coalesce("true_article", F.lit(False)))


@query("A30_kill_totals", """select cast(sum(n_kill) as bigint) as n_kills, count_if(n_kill > 0) as reports_with_kills, count(*) as n_reports from fx_rep""")
def a30b(v, spark, sf):
    return A.kill_totals(v("fx_heads"))


@query("A31_test_vs_enroll", """select label, sigma_enroll, round(test_std, 5) as test_std, n from (
  select r.label, arg_min(f.sigma_enroll, (r.stem, r.report_id)) filter (where f.sigma_enroll is not null) as sigma_enroll, stddev_samp(r.circle_diameter_mm) as test_std, count(*) as n
  from fx_rep r left join fx_feat f on f.report_id = r.report_id and f.article_number = r.label and f.feature = 'diameter_mm'
  where coalesce(r.label, '') <> '' group by 1) where n >= 2 and sigma_enroll is not null""")
def a31(v, spark, sf):
    return r4(A.test_vs_enroll(v("fx_reports")), "test_std", digits=5)


@query("A32_z_per_feature", "with z as (select f.feature, r.ok, abs(f.z) as value from fx_feat f join fx_judged r using (report_id) where f.cand_rank = 1 and r.ok is not null) "
       + hist_sql("z", "ok", 13, "0e0", "greatest(max(value), 3.5e0) * 1.05e0", "feature"))
def a32(v, spark, sf):
    return A.z_per_feature(v("fx_reports"))


CH_SQL = ", ".join("round(coalesce(sum(case when feature in (" + ", ".join(f"'{f}'" for f in fs) + f") then weighted end), 0e0), 4) as {ch}"
                   for ch, fs in C.CHANNELS.items())
_CHS = f"(select report_id, cand_rank, {CH_SQL} from fx_feat group by 1, 2)"
_NEAR = f"""(select r.report_id, llr_margin as margin, label, c2.article_number as rival, top_log_score as log_score_top1, c2.log_score as log_score_top2,
  round(a.geometry - b.geometry, 4) as diff_geometry, round(a.color - b.color, 4) as diff_color, round(a.shape - b.shape, 4) as diff_shape
from fx_judged r join fx_cand c2 on c2.report_id = r.report_id and c2.cand_rank = 2 join {_CHS} a on a.report_id = r.report_id and a.cand_rank = 1
join {_CHS} b on b.report_id = r.report_id and b.cand_rank = 2 where ok and llr_margin < 3e0)"""


@query("A33_near_misses", f"select * from {_NEAR} t")
def a33(v, spark, sf):
    return A.near_misses(v("fx_reports"), P)


@query("A33_near_miss_pairs", f"select label, rival, count(*) as n from {_NEAR} t group by 1, 2 order by n desc, label, rival limit 12")
def a33b(v, spark, sf):
    return A.near_miss_pairs(v("fx_reports"), P)


_ATT = f"""(select r.report_id, r.label, r.pred, w.geometry as geometry_wrong, t.geometry as geometry_right, round(w.geometry - t.geometry, 4) as geometry_diff,
  w.color as color_wrong, t.color as color_right, round(w.color - t.color, 4) as color_diff, w.shape as shape_wrong, t.shape as shape_right, round(w.shape - t.shape, 4) as shape_diff
from fx_judged r join fx_cand c on c.report_id = r.report_id and c.article_number = r.label and c.cand_rank > 1
join {_CHS} w on w.report_id = r.report_id and w.cand_rank = 1 join {_CHS} t on t.report_id = r.report_id and t.cand_rank = c.cand_rank
where r.ok = false and coalesce(r.label, '') not in ('', 'NO_MATCH'))"""


@query("A34_error_attribution", f"""select *, case when geometry_diff >= color_diff and geometry_diff >= shape_diff then 'geometry'
  when color_diff >= shape_diff then 'color' else 'shape' end as cause from {_ATT} t""")
def a34(v, spark, sf):
    return A.error_attribution(v("fx_reports"))


@query("A34_unattributed", """select r.report_id, case when r.n_cand = 0 then 'keine_kandidaten' when t.cand_rank is null then 'vorfilter_kill' else 'top1_korrekt' end as fall,
  r.label, c.article_number as top1, decision, cast(r.n_cand as bigint) as n_candidates, t.cand_rank as truth_rank, circle_diameter_mm as measured_mm,
  c.corrected_diameter_mm as top1_corrected_mm, c.nominal_size_mm as top1_nominal_mm
from fx_judged r left join fx_cand t on t.report_id = r.report_id and t.article_number = r.label left join fx_cand c on c.report_id = r.report_id and c.cand_rank = 1
where r.ok = false and coalesce(r.label, '') not in ('', 'NO_MATCH') and (t.cand_rank is null or t.cand_rank = 1)""")
def a34b(v, spark, sf):
    return A.unattributed(v("fx_reports"))


_PAIRS = """(select distinct a.article_number as a, b.article_number as b from fx_cand a join fx_cand b on a.report_id = b.report_id and a.article_number < b.article_number
  where a.has_references and b.has_references)"""


@query("J09_cooccurring_pairs", f"select * from {_PAIRS} t")
def j09(v, spark, sf):
    return A.cooccurring_pairs(v("fx_heads"))


_FLQ = "case feature " + " ".join(f"when '{f}' then {C.SIGMA_FLOORS[C.FLOOR_KEYS[f]]!r}e0" for f in C.ALL_FEATURES) + " end"


_FLQ2 = _FLQ.replace("case feature", "case s.feature")


@query("A35_discriminability", f"""with {stats_ctes('fx_shots')},
sep as (select p.a, p.b, s.feature, case when s.mean is not null then abs(s.mean - t.mean)
      when len(s.proto) = len(t.proto) then {dist_sql('s.feature', 's.proto', 't.proto')} end
    / sqrt((power(greatest(s.std, {_FLQ2}), 2) + power(greatest(t.std, {_FLQ2}), 2)) / 2e0) as sep
  from {_PAIRS} p join st s on s.article_number = p.a join st t on t.article_number = p.b and t.feature = s.feature)
select p.a, p.b, {', '.join(f"round(max(case when feature = '{f}' then sep end), 4) as {f}" for f in C.ALL_FEATURES)}, round(max(sep), 4) as max_sep
from {_PAIRS} p left join sep using (a, b) group by 1, 2""")
def a35(v, spark, sf):
    out = A.discriminability(A.cooccurring_pairs(v("fx_heads")), enroll.stats_wide(v("fx_shots")))
    return r4(out, *C.ALL_FEATURES, "max_sep")


_DRS = "(select label, coalesce(stddev_samp(circle_diameter_mm), 0e0) as std, count(*) as n from fx_rep where coalesce(label, '') <> '' group by 1)"
_DRC = f"""(select label, std, n from {_DRS} t where std > (select greatest(1e0, 2e0 * coalesce(median(std), 0e0)) from {_DRS} u where std > 0) order by std desc, label limit 4)"""


@query("A36_drift_conspicuous", f"select label, round(std, 6) as std, n from {_DRC} t")
def a36(v, spark, sf):
    return r4(A.drift_conspicuous(v("fx_heads")), "std", digits=6)


@query("A37_cross_section", f"""with m as (select 'margin' as panel, ok, llr_margin as value from fx_judged where ok is not null and llr_margin is not null),
h as ({hist_sql('m', 'ok', 19, '0e0', 'greatest(max(value), 2e0) * 1.05e0')})
select panel, cast(bin as string) as item, case when ok then 'right' else 'wrong' end as part, n from h
union all select 'funnel', label, case when tr = 1 then 'rank_1' when tr is not null then 'in_set' else 'not_in_set' end, count(*) from {_TR} t group by 2, 3
union all select 'rank', case when tr is null then 'nicht im Set' when tr <= 3 then cast(tr as string) else '>3' end, 'all', count(*) from {_TR} t group by 2
union all select 'decision', label, decision, count(*) from fx_rep where coalesce(label, '') <> '' group by 2, 3
union all select 'drift', label, 'conspicuous', n from {_DRC} d""")
def a37(v, spark, sf):
    return A.cross_section(v("fx_heads"), P)


@query("A56_batch_posterior_stats", """select round(avg(case when ok then p end), 6) as mean_correct, round(avg(case when not ok then p end), 6) as mean_wrong
from (select r.ok, coalesce(c.posterior, 0e0) as p from fx_judged r left join fx_cand c on c.report_id = r.report_id and c.cand_rank = 1) where ok is not null""")
def a56(v, spark, sf):
    return r4(A.posterior_stats(v("fx_heads")), "mean_correct", "mean_wrong", digits=6)


@query("A58_stock_status", "select (select count(*) from fx_articles) as n_articles, (select count(distinct article_number) from fx_shots) as n_with_references")
def a58(v, spark, sf):
    return A.stock_status(v("fx_articles"), v("fx_shots"))


@query("A61_weak_stats_markers", """with s as (select article_number, 'diameter_mm' as feature, floor(circle_diameter_mm / 25.0137e0) as x from fx_shots
    union all select article_number, 'circularity', floor(circularity * 40.0137e0) from fx_shots union all select article_number, 'solidity', floor(solidity * 50.0137e0) from fx_shots where floor(solidity * 50.0137e0) > 0),
z as (select article_number, string_agg(feature, ',' order by feature) as zs from (select article_number, feature from s group by 1, 2 having count(*) > 1 and coalesce(stddev_samp(x), 0e0) = 0) group by 1),
n as (select article_number, count(*) as n_shots from fx_shots group by 1)
select article_number, n_shots, n_shots < 25 as few_shots, coalesce(zs, '') as zero_sigma from n left join z using (article_number) where n_shots < 25 or zs is not null""")
def a61(v, spark, sf):
    s = v("fx_shots").withColumns({"circle_diameter_mm": F.floor(F.col("circle_diameter_mm") / 25.0137).cast("double"),
                                   "circularity": F.floor(F.col("circularity") * 40.0137).cast("double"),
                                   "solidity": F.floor(F.col("solidity") * 50.0137).cast("double")})
    return A.weak_stats(enroll.scalar_stats(s), s.groupBy("article_number").agg(
        F.count(F.lit(1)).alias("n_shots")), 25)


@query("J05_truth_candidate", """select r.report_id, r.label, t.cand_rank as truth_rank, t.log_score, t.nominal_size_mm as nominal_mm
from fx_rep r left join fx_cand t on t.report_id = r.report_id and t.article_number = r.label where coalesce(r.label, '') <> ''""")
def j05(v, spark, sf):
    return A.truth_candidate(v("fx_heads"))


@query("J08_article_listing", f"""select article_number, name, case when coalesce(diameter_mm, 0e0) <> 0 then printf('Ø %.1f mm', diameter_mm)
  when coalesce(width_mm, 0e0) <> 0 and coalesce(depth_mm, 0e0) <> 0 then printf('%.1f × %.1f mm', width_mm, depth_mm) else '—' end as size_text,
  {NOM} as nominal_mm, coalesce(n, 0) as n_references from (select * replace (depth_mm + 0.013e0 as depth_mm) from fx_articles)
left join (select article_number, count(*) as n from fx_emb group by 1) using (article_number)""")
def j08(v, spark, sf):
    a = v("fx_articles").withColumn("depth_mm", F.col("depth_mm") + 0.013)
    return A.article_listing(a, v("fx_emb"))


@query("J11_top1_vs_top2", """select report_id, max(case when cand_rank = 1 then article_number end) as top1, max(case when cand_rank = 2 then article_number end) as top2,
  max(case when cand_rank = 1 then log_score end) as score1, max(case when cand_rank = 2 then log_score end) as score2,
  round(max(case when cand_rank = 1 then log_score end) - max(case when cand_rank = 2 then log_score end), 4) as margin from fx_cand group by 1 having count(*) >= 2""")
def j11(v, spark, sf):
    return A.top1_vs_top2(v("fx_heads"))


@query("J12_position_error_join", """select report_id, cx as x_px, cy as y_px, label, diameter_mm as soll_mm, round(m * f, 2) as gemessen_mm, round(m * f - diameter_mm, 2) as fehler_mm
from (select r.report_id, r.cx, r.cy, r.label, a.diameter_mm, r.circle_diameter_mm + 0.0003e0 as m, (300e0 - coalesce(a.height_mm, 0e0)) / 300e0 as f
  from fx_rep r join fx_articles a on a.article_number = r.label where r.cx is not null and a.diameter_mm <> 0)""")
def j12(v, spark, sf):
    r = v("fx_heads").withColumn("measured", F.struct(
        (F.col("measured.circle_diameter_mm") + 0.0003).alias("circle_diameter_mm")))
    return A.position_errors(r, v("fx_articles"))


@query("T01_newest_n", "select report_id, stem from fx_rep order by stem desc, report_id desc limit 50")
def t01(v, spark, sf):
    r = v("fx_heads").withColumn("_o", F.struct("stem", "report_id"))
    return reports.newest(r, 50, "_o").select("report_id", "stem")


@query("T02_top_k_suggestions", """select report_id, cand_rank as "rank", article_number, posterior from fx_cand join (select report_id from fx_rep where decision = 'ambiguous') using (report_id) where cand_rank <= 3""")
def t02(v, spark, sf):
    from ..operators import scoring
    return scoring.top_k_suggestions(v("fx_heads"), 3)


@query("T04_worst_first", f"""select label, k, n, {_PA['p']} as p from (select label, count_if(ok) as k, count(*) as n from fx_judged where coalesce(label, '') <> '' and ok is not null group by 1)
order by 4, label""")
def t04(v, spark, sf):
    return A.worst_first(A.per_article_quota(v("fx_heads"))).select("label", "k", "n", "p")


@query("T05_top_confusions", """select coalesce(nullif(label, ''), '?') as truth, pred as predicted, count(*) as n from fx_judged where ok = false group by 1, 2 order by n desc, truth, predicted limit 8""")
def t05(v, spark, sf):
    return A.top_confusions(v("fx_heads"), 8)


@query("T05_all_confusions", """select coalesce(nullif(label, ''), '?') as truth, pred as predicted, count(*) as n from fx_judged where ok = false group by 1, 2""")
def t05_all(v, spark, sf):
    return A.confusion_pairs(v("fx_heads")).select("truth", "predicted", "n")


@query("W15_capture_order", """select report_id, session, row_number() over (partition by session order by stem, report_id) - 1 as capture_order from fx_rep""")
def w15(v, spark, sf):
    return A.capture_order(v("fx_heads")).select("report_id", "session", "capture_order")


@query("A_drift_rows", """select report_id, label, circle_diameter_mm as diameter_mm, row_number() over (order by stem, report_id) - 1 as ord from fx_rep where coalesce(label, '') <> ''""")
def a_drift(v, spark, sf):
    from ..operators.ranks import global_position
    r = v("fx_heads").where("coalesce(label, '') <> ''").select(
        "report_id", "stem", "label", F.col("measured.circle_diameter_mm").alias("diameter_mm"))
    return global_position(r, [], [F.col("stem"), F.col("report_id")], "ord").select(
        "report_id", "label", "diameter_mm", "ord")
