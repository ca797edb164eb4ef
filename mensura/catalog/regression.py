"""Regression, gate and set queries (J06, J07, J10, J13-J17, J20, J21, Q, X, A38-A43, A53-A55, T03, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import compare as cmp
from ..operators import enroll, gates, regression as X
from .base import query
from .functions import CHANGE, TRUTH_ORIGIN, band_sql, wilson_sql
from .identify import bhatta_sql, stats_ctes
from .analysis import _T3, quota_union, TIER2

NAN = lambda c: F.nanvl(c, F.lit(None).cast("double"))

ACC_SQL = """(select sha8, case when image_id % 2 = 0 then 'gewollt' else 'plattform' end as kategorie,
  concat('d', cast(image_id % 3 as string), '.json') as source, concat('abcdef0123', cast(image_id as string)) as fix_commit,
  decision as e_decision, articles as e_articles, gate_passed as e_gate, llr_margin as e_margin, max_z_winner as e_z from fx_replay where image_id % 26 = 0)"""


def accepted(v):
    a = v(f"select * from {ACC_SQL} t")
    return a.select("sha8", "kategorie", "source", "fix_commit", F.struct(
        F.col("e_decision").alias("decision"), F.col("e_articles").alias("articles"),
        F.col("e_gate").alias("gate_passed"), F.col("e_margin").alias("llr_margin"),
        F.col("e_z").alias("max_z_winner")).alias("expected"))


_LAB = "case when coalesce(g.label, '') <> '' then g.label else coalesce(r.label, '') end"
REVIEW = f"""(select g.sha8, g.image_id, {CHANGE} as aenderung, {_LAB} as label, g.decision as decision_alt, r.decision as decision_neu, g.top1 as top1_alt, r.top1 as top1_neu,
  case when {_LAB} <> '' and g.top1 = {_LAB} then 'ja' else 'nein' end as top1_korrekt_alt, case when {_LAB} <> '' and r.top1 = {_LAB} then 'ja' else 'nein' end as top1_korrekt_neu,
  g.llr_margin as llr_margin_alt, r.llr_margin as llr_margin_neu, round(r.llr_margin - g.llr_margin, 4) as llr_margin_delta,
  g.max_z_winner as max_z_alt, r.max_z_winner as max_z_neu, round(r.max_z_winner - g.max_z_winner, 4) as max_z_delta,
  g.driving_feature as treiber_alt, g.driving_z as treiber_z_alt, r.driving_feature as treiber_neu, r.driving_z as treiber_z_neu,
  array_to_string(list_slice(r.articles, 1, 3), ' ') as top3_neu,
  case when {_LAB} <> '' and list_contains(list_slice(r.articles, 1, 3), {_LAB}) then 'ja' else 'nein' end as label_in_top3_neu
from fx_golden g join fx_replay r using (sha8))"""
REVIEW_COLS = ["sha8", "aenderung", "label", "decision_alt", "decision_neu", "top1_alt", "top1_neu", "top1_korrekt_alt", "top1_korrekt_neu",
               "llr_margin_alt", "llr_margin_neu", "llr_margin_delta", "max_z_alt", "max_z_neu", "max_z_delta", "treiber_alt", "treiber_z_alt",
               "treiber_neu", "treiber_z_neu", "top3_neu", "label_in_top3_neu", "delta_status", "delta_kategorie", "delta_quelle", "delta_fix_commit"]
_ACCCOLS = """case when a.sha8 is not null then 'akzeptiert' else '-' end as delta_status, coalesce(kategorie, '') as delta_kategorie,
  coalesce(source, '') as delta_quelle, coalesce(substr(fix_commit, 1, 8), '') as delta_fix_commit"""


def review(v):
    return X.golden_vs_run(v("fx_golden"), v("fx_replay"))


@query("J06_golden_vs_run", f"select r.* exclude (image_id), {_ACCCOLS} from {REVIEW} r left join {ACC_SQL} a using (sha8)")
def j06(v, spark, sf):
    return X.golden_vs_run(v("fx_golden"), v("fx_replay"), accepted(v)).select(*REVIEW_COLS)


# --- tier 2 ---------------------------------------------------------------

def t2_union(src: str, e: str = "") -> str:
    """Long diff rows (sha8, field, delta, band) of a joined source with g_ and b_ columns."""
    def num(c):
        return (f"select sha8, '{c}' as field, b_{c} - g_{c} as delta, case when g_{c} is null or b_{c} is null then 'fail' else {band_sql(c, f'g_{c}', f'b_{c}')} end as band "
                f"from {src} where not (g_{c} is null and b_{c} is null)")
    exact = [("decision", "decision"), ("top_k", "articles"), ("gate_passed", "gate_passed")]
    return " union all ".join([f"select sha8, '{n}' as field, null::double as delta, 'fail' as band from {src} where g_{c} is distinct from b_{c}" for n, c in exact]
                              + [num("llr_margin"), num("max_z_winner")])


_T2C = ("decision", "articles", "gate_passed", "llr_margin", "max_z_winner")
_T2J = "(select g.sha8, " + ", ".join(f"g.{c} as g_{c}, r.{c} as b_{c}" for c in _T2C) + " from fx_golden g join fx_replay r using (sha8))"
_WORST = "case max(case band when 'fail' then 2 when 'drift' then 1 else 0 end) when 2 then 'fail' when 1 then 'drift' else 'pass' end"


@query("Q04_compare_tier2", f"""with j as {_T2J}, d as ({t2_union('j')})
select j.sha8, count(d.field) as n_diffs, count(case when d.band <> 'pass' then 1 end) as n_bad, coalesce({_WORST}, 'pass') as band from j left join d using (sha8) group by 1""")
def q04(v, spark, sf):
    out = X.compare_tier2(v("fx_golden"), v("fx_replay"))
    return out.select("sha8", F.size("diffs").cast("long").alias("n_diffs"),
                      F.size(F.filter("diffs", lambda d: d["band"] != "pass")).cast("long").alias("n_bad"), "band")


_E2C = ", ".join(f"a.{e} as g_{c}, r.{c} as b_{c}" for c, e in zip(_T2C, ("e_decision", "e_articles", "e_gate", "e_margin", "e_z")))


@query("J07_accepted_delta_overlay", f"""with j as {_T2J}, e as (select a.sha8, {_E2C} from {ACC_SQL} a join fx_replay r using (sha8)), d as ({t2_union('j')}), de as ({t2_union('e')}),
s as (select j.sha8, count(d.field) > 0 and exists(select 1 from e where e.sha8 = j.sha8) as over_ from j left join d using (sha8) group by 1),
u as (select d.* from d join s using (sha8) where not over_ union all select de.* from de join s using (sha8) where over_)
select s.sha8, count(u.field) as n_diffs, coalesce({_WORST}, 'pass') as band from s left join u using (sha8) group by 1""")
def j07(v, spark, sf):
    out = X.compare_tier2(v("fx_golden"), v("fx_replay"), accepted(v))
    return out.select("sha8", F.size("diffs").cast("long").alias("n_diffs"), "band")


# --- tier 1 ---------------------------------------------------------------

def _t1_union() -> str:
    parts = []
    for c in C.TIER1_SCALARS + X.EXTRA_SCALARS:
        parts.append(f"select sha8, '{c}' as field, f.{c} - g.{c} as delta, case when g.{c} is null or f.{c} is null then 'fail' else {band_sql(c, f'g.{c}', f'f.{c}')} end as band "
                     f"from fx_t1_golden g join fx_t1_fresh f using (sha8) where not (g.{c} is null and f.{c} is null)")
    for c in C.TIER1_VECTORS:
        parts.append(f"""select sha8, '{c}', case when same then fa[ix] - ga[ix] end, case when not same then 'fail' else {band_sql(c, 'ga[ix]', 'fa[ix]')} end
  from (select *, list_position(list_transform(list_zip(ga, fa), lambda t: abs(t[2] - t[1])), list_max(list_transform(list_zip(ga, fa), lambda t: abs(t[2] - t[1])))) as ix
    from (select g.sha8, g.{c} as ga, f.{c} as fa, len(g.{c}) = len(f.{c}) as same from fx_t1_golden g join fx_t1_fresh f using (sha8)))""")
    return " union all ".join(parts)


T1 = f"t1d as ({_t1_union()}), t1r as (select sha8, {_WORST} as band from t1d group by 1)"


def tier1(v):
    return X.compare_tier1(v("fx_t1_golden"), v("fx_t1_fresh"))


@query("Q03_compare_tier1", f"""with {T1} select sha8, band, n_diffs, n_bad from t1r join (select sha8, count(*) as n_diffs, count_if(band <> 'pass') as n_bad from t1d group by 1) using (sha8)""")
def q03(v, spark, sf):
    return tier1(v).select("sha8", "band", F.size("diffs").cast("long").alias("n_diffs"),
                           F.size(F.filter("diffs", lambda d: d["band"] != "pass")).cast("long").alias("n_bad"))


@query("A38_tier1_drift_by_field", f"""with {T1}, d as (select t1d.*, abs(delta) as a from t1d join (select sha8 from t1r where band <> 'pass') using (sha8)),
n as (select field as feld, count(distinct sha8) as bilder, count_if(band = 'drift') as drift, count_if(band = 'fail') as fail from d group by 1),
q as (select field as feld, round(max(case when rn = n // 2 then a end), 6) as delta_median, round(max(a), 6) as delta_max
  from (select field, a, row_number() over (partition by field order by a) - 1 as rn, count(*) over (partition by field) as n from d where a is not null) group by 1)
select * from n left join q using (feld)""")
def a38(v, spark, sf):
    return X.drift_by_field(tier1(v))


@query("A39_classify_drift", f"""with {T1}, p as (select sha8, max(abs(delta)) as d from t1d join (select sha8 from t1r where band = 'drift') using (sha8) where band = 'drift' group by 1),
a as (select (select count(*) from t1r where band = 'drift') as n, avg(d) as m, stddev_pop(d) as s, median(d) as md, (select count(*) from t1r) as tot from p)
select case when n = 0 then 'keine' when n / tot >= 0.5e0 and s / m <= 0.25e0 then 'uniform' else 'ausreisser' end as muster, n as betroffen, round(n / tot, 3) as anteil,
  round(md, 6) as delta_median, round(s / m, 3) as streuung from a""")
def a39(v, spark, sf):
    return X.classify_drift(tier1(v))


@query("A40_decision_matrix", f"select decision_alt, decision_neu, count(*) as n from {REVIEW} t group by 1, 2")
def a40(v, spark, sf):
    return X.decision_matrix(review(v))


def _dir(c):
    return f"case when {c} = 'ja' then 'richtig' else 'falsch' end"


@query("A41_top1_changes", f"""select richtung, count(t.sha8) as anzahl from (values ('falsch->richtig'), ('falsch->falsch'), ('richtig->richtig'), ('richtig->falsch')) w(richtung)
left join (select sha8, concat({_dir('top1_korrekt_alt')}, '->', {_dir('top1_korrekt_neu')}) as richtung from {REVIEW} u where top1_alt <> top1_neu and label <> '') t using (richtung) group by 1""")
def a41(v, spark, sf):
    return X.top1_changes(review(v))


@query("A42_new_false_accepts", f"""select sha8, label, top1_neu from {REVIEW} t where decision_neu = 'accept' and label <> '' and top1_korrekt_neu = 'nein'
  and not (decision_alt = 'accept' and top1_korrekt_alt = 'nein')""")
def a42(v, spark, sf):
    return X.new_false_accepts(review(v)).select("sha8", "label", "top1_neu")


SIDEQ = [("accuracy_top1", "count_if(lab and top1 = label)", "count_if(lab)"), ("accuracy_top3", "count_if(lab and list_contains(list_slice(articles, 1, 3), label))", "count_if(lab)"),
         ("auto_accept_rate", "count_if(decision = 'accept')", "count(*)"), ("false_accept_rate", "count_if(decision = 'accept' and lab and top1 <> label)", "count_if(decision = 'accept')")]


def side_q(view):
    return quota_union(SIDEQ, f"(select *, coalesce(label, '') <> '' as lab from {view})", True)


@query("A43_quota_consistency", f"""with s as ({side_q('fx_golden')}), r as ({side_q('fx_replay')})
select s.metric, s.k, s.n, r.k as k_again, r.n as n_again from s join r using (metric) where s.k is distinct from r.k or s.n is distinct from r.n
union all select 'roh_top1_gleich_label', count_if(top1 = lab), count(*), null, null from (select r.top1, coalesce(nullif(g.label, ''), r.label) as lab from fx_replay r left join fx_golden g using (sha8)) where coalesce(lab, '') <> ''""")
def a43(v, spark, sf):
    stored = X.side_quotas(v("fx_golden"))
    return X.quota_consistency(stored, v("fx_replay"), v("fx_golden"))


# --- fidelity and content -------------------------------------------------

_FID = """(select g.sha8, list_filter([case when g.decision is distinct from r.decision then 'decision' end, case when g.top1 is distinct from r.top1 then 'top1' end,
  case when (g.llr_margin is null) <> (r.llr_margin is null) or coalesce(abs(r.llr_margin - g.llr_margin) >= 1e-3, false) then 'llr' end], lambda x: x is not null) as reasons,
  abs(r.llr_margin - g.llr_margin) as delta from fx_golden g join fx_replay r using (sha8))"""


@query("J14_fidelity_check", f"select sha8, array_to_string(reasons, ',') as reasons, len(reasons) = 0 as exact, round(delta, 6) as delta from {_FID} t")
def j14(v, spark, sf):
    out = X.fidelity(v("fx_golden"), v("fx_replay"))
    return out.select("sha8", F.array_join("reasons", ",").alias("reasons"), "exact", F.round("delta", 6).alias("delta"))


@query("J14_fidelity_summary", f"""with f as {_FID}, o as (select delta, row_number() over (order by delta) - 1 as rn, count(*) over () as n from f where delta is not null)
select (select count(*) from f) as checked, (select count_if(len(reasons) = 0) from f) as exact, max(n) as comparable, round(max(case when rn = cast(floor(0.5e0 * (n - 1)) as bigint) then delta end), 6) as median,
  round(max(case when rn = cast(floor(0.9e0 * (n - 1)) as bigint) then delta end), 6) as p90, round(max(delta), 6) as "max" from o""")
def j14b(v, spark, sf):
    out = X.fidelity_summary(X.fidelity(v("fx_golden"), v("fx_replay")))
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p90", "max")})


_SNAP = "(select article_number, min(n_shots) + min(aid) % 7 % 2 as n_shots, 60e0 + 1.9e0 * min(aid) + 0.125e0 as m_diameter_mm from (select article_number, n_shots, cast(substr(article_number, 5) as bigint) as aid from fx_cand where has_references) t group by 1)"


@query("J13_db_match_ratio", f"""select r.session, round(avg(case when s.n_shots = c.n_shots and abs(s.m_diameter_mm - f.reference) < 1e-9 then 1e0 else 0e0 end), 6) as ratio, count(*) as n
from fx_feat f join fx_cand c on c.report_id = f.report_id and c.cand_rank = f.cand_rank join fx_rep r on r.report_id = f.report_id left join {_SNAP} s on s.article_number = f.article_number
where f.feature = 'diameter_mm' and f.reference is not null group by 1""")
def j13(v, spark, sf):
    out = X.db_match_ratio(v("fx_refs"), v(f"select * from {_SNAP} t"), "session")
    return out.withColumn("ratio", F.round("ratio", 6))


_BATCH = "(select event_id, concat('h', cast(user_id * 7 + event_id % 5 as string)) as sha, event_type as truth from events)"
_MAN = "(select concat('h', cast(user_id * 7 as string)) as sha, max(event_type) as truth from events where user_id % 3 = 0 group by 1)"


@query("J15_dedup_by_content", f"select sha, min(event_id) as event_id from {_BATCH} b where sha not in (select sha from {_MAN} m) group by 1")
def j15(v, spark, sf):
    return X.new_by_content(v(f"select * from {_BATCH} t"), v(f"select * from {_MAN} t"), "sha", "event_id").select("sha", "event_id")


@query("J16_conflicting_labels", f"select event_id, case when b.truth = m.truth then 'dublette' else 'widerspruch_label' end as status from {_BATCH} b join {_MAN} m using (sha)")
def j16(v, spark, sf):
    b = v(f"select * from {_BATCH} t")
    return X.label_conflicts(b, v(f"select * from {_MAN} t")).select("event_id", "status")


@query("J17_label_exists", """select report_id, label from fx_rep where label is not null and label <> 'NO_MATCH' and label not in (select article_number from fx_articles where article_id % 13 <> 0)""")
def j17(v, spark, sf):
    r = v("fx_heads").where("label is not null").select("report_id", "label")
    return X.unknown_labels(r, v("fx_articles").where("article_id % 13 <> 0"), "label").select("report_id", "label")


@query("J20_changed_only", """select sha8, case when image_id % 3 = 0 then 'cached' else 'fresh' end as origin from fx_golden""")
def j20(v, spark, sf):
    g = v("fx_golden").withColumn("cache_key", X.cache_key(
        F.col("sha8"), F.col("tier").cast("string"), F.lit("code"), F.lit("cfg"), F.col("session"), F.lit("b")))
    cache = g.where("image_id % 3 = 0").select("cache_key", "sha8", F.lit("cached").alias("origin"))
    res, _ = X.changed_only(g, cache, "cache_key", lambda d: d.select("cache_key", "sha8", F.lit("fresh").alias("origin")))
    return res.select("sha8", "origin")


# --- gates ----------------------------------------------------------------

@query("Q01_check_against_baseline", f"""with {T1}, b as ({side_q('fx_golden')}), q as ({side_q('fx_replay')}),
x as (select q.metric, q.p, case when q.metric = 'accuracy_top3' then null else b.wilson_lo end as lo, b.wilson_hi - 0.01e0 as hi from q join b using (metric))
select 'FAIL' as finding, cast(count(*) as string) as subject, 1 as code from t1r where band = 'fail' having count(*) > 0
union all select 'DRIFT', cast(count(*) as string), 1 from t1r where band = 'drift' having count(*) > 0
union all select case when metric = 'false_accept_rate' then case when p > hi then 'error rate above baseline' end when lo is null then 'bound missing' when p < lo then 'below baseline' end, metric, 1
  from x where (metric = 'false_accept_rate' and p > hi) or (metric <> 'false_accept_rate' and (lo is null or p < lo))
union all select 'semantics differ', 'verdict-era', 0""")
def q01(v, spark, sf):
    base = X.side_quotas(v("fx_golden")).withColumns({
        "wilson_lo": F.when(F.col("metric") != "accuracy_top3", F.col("wilson_lo")),
        "wilson_hi": F.col("wilson_hi") - 0.01})
    return gates.check_against_baseline(tier1(v), X.side_quotas(v("fx_replay")), base,
                                        accept_drift=False, semantics="verdict-era")


@query("Q02_completeness_gate", """select session as run_id, case when flt then 'filtered run is no release' when n < bn then 'fewer images than the baseline' else '' end
  || case when nr < n then case when flt or n < bn then ',' else '' end || 'rates do not cover the run' else '' end as findings, case when flt or n < bn or nr < n then 1 else 0 end as code
from (select session, session < 'S05' as flt, count(*) as n, max(image_id) % 3 + 374 as bn, count_if(image_id % 400 <> 7) as nr from fx_golden group by 1)""")
def q02(v, spark, sf):
    runs = v("select session as run_id, session < 'S05' as filtered, count(*) as n, max(image_id) % 3 + 374 as baseline_n, count_if(image_id % 400 <> 7) as n_replays from fx_golden group by 1, 2")
    return gates.completeness_gate(runs).select("run_id", F.array_join("findings", ",").alias("findings"), "code")


_STATE = """(select session, sha256(cast(count(*) as string)) as calibration_sha256, sha256(cast(min(k) as string)) as background_sha256, sha256(cast(max(k) as string)) as db_zustand_sha256,
  sha256('features') as features_cfg_sha256, sha256(cast(max(k) % 3 as string)) as matching_cfg_sha256, max(k) as mk from fx_rep group by 1)"""
_STATE_SP = _STATE.replace("sha256(", "sha2(").replace(" as string)) as", " as string), 256) as").replace("'features') as", "'features', 256) as")


def _states(v):
    a = v(f"select * from {_STATE_SP} t")
    parts = {"db_zustand_sha256": F.when(F.col("mk") % 4 == 0, F.lit("x")).otherwise(F.col("db_zustand_sha256")),
             "matching_cfg_sha256": F.when(F.col("mk") % 6 == 1, F.lit(None).cast("string")).otherwise(F.col("matching_cfg_sha256"))}
    return a, a.withColumns(parts)


@query("Q05_bundle_consistency", """select session from (select session, max(k) % 2 = 0 as has_db from fx_rep group by 1) where has_db and session not in (select session from fx_rep group by 1 having max(k) % 3 = 0)""")
def q05(v, spark, sf):
    s = v("select session, max(k) % 2 = 0 as has_db from fx_rep group by 1")
    return gates.bundle_consistency(s, v("select session from fx_rep group by 1 having max(k) % 3 = 0"))


@query("Q06_snapshot_integrity", f"""select session, case when mk % 6 = 1 then 'matching_cfg_sha256 missing' else
  case when mk % 5 = 0 then 'fingerprint does not match its parts' else '' end || case when mk % 4 = 0 then case when mk % 5 = 0 then ',' else '' end || 'db_zustand_sha256 deviates' else '' end end as findings
from (select session, max(k) as mk from fx_rep group by 1)""")
def q06(v, spark, sf):
    a, b = _states(v)
    fp = gates.combined_fingerprint(*[F.col(p) for p in gates.STATE_PARTS])
    stored = a.withColumn("fingerprint", F.when(F.col("mk") % 5 == 0, F.lit("old")).otherwise(fp))
    return gates.snapshot_integrity(stored, b, "session").select("session", F.array_join("findings", ",").alias("findings"))


@query("Q07_state_drift_components", """select session, case when mk % 4 = 0 then 'db_zustand_sha256' else '' end || case when mk % 6 = 1 then 'matching_cfg_sha256' else '' end as parts
from (select session, max(k) as mk from fx_rep group by 1)""")
def q07(v, spark, sf):
    a, b = _states(v)
    return gates.state_drift(a, b, "session").select("session", F.array_join("parts", ",").alias("parts"))


_ELIG = f"""(select report_id, nullif(label, '') as truth, case when nullif(label, '') is null then {TRUTH_ORIGIN} when k % 17 = 0 then 'ohne_zustand' when k % 19 = 0 then 'ohne_bild'
  when k % 23 = 0 then 'bild_fehlt' when k % 27 = 0 then 'kein_png' when k % 29 = 0 then 'zustand_nicht_mehr_vorhanden' when k % 31 = 0 then 'snapshot_defekt'
  when k % 37 = 0 then 'dublette' when k % 41 = 0 then 'widerspruch_label' when label <> 'NO_MATCH' and a.article_number is null then 'label_unbekannt_in_db' when k % 43 = 0 then 'fidelity_abweichung' end as reason
from fx_rep left join (select article_number from fx_articles where article_id % 13 <> 0) a on a.article_number = label)"""


def _eligible(v):
    k = F.col("k")
    known = v("fx_articles").where("article_id % 13 <> 0").select(
        F.col("article_number").alias("label"), F.lit(True).alias("label_known"))
    r = v("fx_reports").join(known, "label", "left").withColumns({
        "has_state": k % 17 != 0, "image_path": F.when(k % 19 == 0, "").when(k % 27 == 0, "a.JPG").otherwise(F.col("image_path")),
        "image_exists": k % 23 != 0, "state_alive": k % 29 != 0, "snapshot_ok": k % 31 != 0,
        "known_truth": F.when(k % 37 == 0, F.col("label")).when(k % 41 == 0, "ANDERS"),
        "label_known": F.coalesce("label_known", F.lit(False)), "reproducible": k % 43 != 0})
    return gates.eligibility(r)


@query("Q08_eligibility_ladder", f"select * from {_ELIG} t")
def q08(v, spark, sf):
    return _eligible(v)


@query("A53_skip_reason_counts", f"select reason, count(*) as n from {_ELIG} t where reason is not null group by 1")
def a53(v, spark, sf):
    return gates.skip_counts(_eligible(v))


_CAP = "(select * from fx_golden where image_id % 47 <> 0)"
_RB = """(select g.sha8, coalesce(g.label, 'NO_MATCH') as artikel, case when r.sha8 is null then 'fehler' when g.decision <> r.decision or g.top1 <> r.top1
    or (g.llr_margin is null) <> (r.llr_margin is null) or coalesce(abs(r.llr_margin - g.llr_margin) >= 1e-3, false) or g.max_z_winner <> r.max_z_winner then 'abweichung' else 'pass' end as band,
  r.decision, r.top1, g.session from fx_golden g left join (select * from fx_replay where image_id % 47 <> 0) r using (sha8))"""


def _replayed(v):
    g = v("fx_golden").withColumn("label", F.coalesce("label", F.lit("NO_MATCH")))
    return g, gates.replay_band(g, v("fx_replay").where("image_id % 47 <> 0"), ["max_z_winner"])


@query("Q12_replay_band", f"select sha8, artikel, band, decision, top1 from {_RB} t")
def q12(v, spark, sf):
    return _replayed(v)[1].select("sha8", "artikel", "band", "decision", "top1")


@query("A54_replay_metrics", f"""select session, count(*) as n, count_if(band <> 'fehler') as gewertet, count_if(band <> 'fehler' and case when artikel = 'NO_MATCH' then decision <> 'accept' or top1 = 'NO_MATCH' else top1 = artikel end) as treffer,
  count_if(decision = 'accept') as accept, count_if(decision = 'ambiguous') as ambiguous, count_if(decision = 'reject') as reject, count_if(decision = 'accept' and top1 <> artikel) as false_accept,
  count_if(band = 'abweichung') as abweichungen, count_if(band = 'fehler') as fehler,
  round(count_if(band <> 'fehler' and case when artikel = 'NO_MATCH' then decision <> 'accept' or top1 = 'NO_MATCH' else top1 = artikel end) / nullif(count_if(band <> 'fehler'), 0), 4) as trefferquote from {_RB} t group by 1""")
def a54(v, spark, sf):
    g, rows = _replayed(v)
    return gates.replay_metrics(rows.join(g.select("sha8", "session"), "sha8"), "session")


@query("Q11_environment_comparable", """select session as snapshot, case when m % 3 = 0 then 'opencv' else '' end as differs, m % 3 <> 0 as comparable from (select session, max(k) as m from fx_rep group by 1)""")
def q11(v, spark, sf):
    s = v("select session as snapshot, 'Linux' as system, case when max(k) % 3 = 0 then '4.8' else '4.10' end as opencv, '2.0' as numpy from fx_rep group by 1")
    out = gates.environment_comparable(s, {"system": "Linux", "opencv": "4.10", "numpy": "2.0"})
    return out.select("snapshot", F.array_join("differs", ",").alias("differs"), "comparable")


@query("Q13_histogram_drift", f"""select sha8, round(abs(fa[ix] - ga[ix]), 8) as maxdelta, round(fa[ix] - ga[ix], 8) as signed, cast(ix - 1 as bigint) as argmax, round(b, 4) as bhatta, ga = fa as equal
from (select *, list_position(list_transform(list_zip(ga, fa), lambda t: abs(t[2] - t[1])), list_max(list_transform(list_zip(ga, fa), lambda t: abs(t[2] - t[1])))) as ix
  from (select g.sha8, g.hs_hist_center as ga, f.hs_hist_center as fa, {bhatta_sql('f.hs_hist_center', 'g.hs_hist_center')} as b from fx_t1_golden g join fx_t1_fresh f using (sha8)))""")
def q13(v, spark, sf):
    out = gates.histogram_drift(v("fx_t1_golden"), v("fx_t1_fresh"), "hs_hist_center")
    return out.withColumns({"maxdelta": F.round("maxdelta", 8), "signed": F.round("signed", 8), "bhatta": F.round("bhatta", 4)})


_RJ = """concat('{"article_number":"', article_number, '","name":"', name, '","n":', cast(article_id as string), '}')"""


@query("A55_table_fingerprint", f"""with h as (select sha256({_RJ}) as h from fx_articles),
b as (select cast(concat('0x', substr(h, 1, 2)) as bigint) as b, count(*) as n, {', '.join(f"sum(cast(concat('0x', substr(h, {3 + 12 * i}, 12)) as bigint)) as s{i}" for i in range(4))} from h group by 1),
t as (select concat_ws(':', cast(b as string), cast(n as string), {', '.join(f'cast(s{i} as string)' for i in range(4))}) as t, n from b)
select sha256(string_agg(t, ',' order by t)) as fingerprint, cast(sum(n) as bigint) as n_rows from t""")
def a55(v, spark, sf):
    return gates.table_fingerprint(v("fx_articles").withColumn("n", F.col("article_id")), ["article_number", "name", "n"])


# --- sets -----------------------------------------------------------------

_BA, _BB = "(select sha8 from fx_golden where image_id % 7 = 0)", "(select sha8 from fx_golden where image_id % 11 = 0)"


@query("X01_run_set_diff", f"""select sha8, case when a.sha8 is null then 'neu_kaputt' when b.sha8 is null then 'repariert' else 'weiterhin_kaputt' end as status from {_BA} a full join {_BB} b using (sha8)""")
def x01(v, spark, sf):
    g = v("fx_golden")
    return X.run_set_diff(g.where("image_id % 7 = 0"), g.where("image_id % 11 = 0"))


@query("X01_metric_deltas", f"with a as ({side_q('fx_golden')}), b as ({side_q('fx_replay')}) select metric, a.p as a, b.p as b, round(b.p - a.p, 4) as delta from a join b using (metric)")
def x01b(v, spark, sf):
    return X.metric_deltas(X.side_quotas(v("fx_golden")), X.side_quotas(v("fx_replay")))


@query("X02_common_images", "select count_if(image_id % 5 = 0 and image_id % 3 = 0) as n_common, count_if(image_id % 5 = 0) as n_old, count_if(image_id % 3 = 0) as n_new from fx_golden")
def x02(v, spark, sf):
    g = v("fx_golden")
    return X.common_images(g.where("image_id % 5 = 0"), g.where("image_id % 3 = 0"))


@query("X04_merged_sessions", "select session, case when session < 'S15' then 'new' else 'old' end as origin from (select distinct session from fx_golden)")
def x04(v, spark, sf):
    s = v("select distinct session from fx_golden")
    return X.merged_sessions(s.withColumn("origin", F.lit("old")), s.where("session < 'S15'").withColumn("origin", F.lit("new")))


@query("X05_incomplete_run", "select sha8 from fx_golden where image_id % 47 = 0")
def x05(v, spark, sf):
    return X.missing_replays(v("fx_golden"), v("fx_replay").where("image_id % 47 <> 0"))


@query("T03_deterministic_subset", "select session, sha8 from fx_golden where tier >= 2 and session in (select session from fx_golden where session between 'S03' and 'S30') order by session, sha8 limit 500")
def t03(v, spark, sf):
    g = v("fx_golden")
    want = g.where("session between 'S03' and 'S30'").select("session").distinct()
    return X.deterministic_subset(g, sessions=want, tier=2, n=500).select("session", "sha8")
