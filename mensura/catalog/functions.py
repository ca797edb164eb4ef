"""Projection, predicate and scalar-function queries (P, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import compare as cmp
from ..functions import distances as dist
from ..functions import judge, sizes, text
from ..operators import enroll, reports, scoring
from ..params import Params
from .base import query
from .identify import (CAT, FLOOR_SQL, NOM, bhatta_sql, euclid_sql, l1_sql, rows_ctes, stats_ctes)

P = Params()
CORR = "circle_diameter_mm * (300e0 - least(coalesce(h, 0e0), 240e0)) / 300e0"


def _nominal():
    return sizes.nominal_size_mm(F.col("diameter_mm"), F.col("width_mm"), F.col("depth_mm"))


@query("P01_nominal_size", f"select article_number, {NOM} as nominal_mm from fx_articles")
def p01(v, spark, sf):
    return v("fx_articles").select("article_number", _nominal().alias("nominal_mm"))


_MA = """(select m.report_id, m.circle_diameter_mm, m.area_mm2, a.diameter_mm, a.width_mm, a.depth_mm, a.height_mm as h
  from fx_measured m join fx_articles a on a.article_number = m.label)"""


@query("P02_height_corrected", f"select report_id, round({CORR}, 6) as corrected_mm from {_MA} t")
def p02(v, spark, sf):
    return v(f"select * from {_MA} t").select(
        "report_id", F.round(sizes.height_corrected(F.col("circle_diameter_mm"), F.col("h"), 300.0),
                             6).alias("corrected_mm"))


@query("P03_area_relative_error", f"""select report_id, round(abs(area_mm2 * f * f - pi() * power(n / 2e0, 2))
  / (pi() * power(n / 2e0, 2)), 6) as area_rel
from (select *, (300e0 - least(coalesce(h, 0e0), 240e0)) / 300e0 as f, {NOM} as n from {_MA} t)""")
def p03(v, spark, sf):
    return v(f"select * from {_MA} t").select("report_id", F.round(sizes.area_relative_error(
        F.col("area_mm2"), F.col("h"), _nominal(), 300.0), 6).alias("area_rel"))


@query("P04_sigma_floor", f"select report_id, cand_rank, feature, {FLOOR_SQL.format(f='feature')} as sigma_floor from fx_feat")
def p04(v, spark, sf):
    f = reports.features(v("fx_reports"))
    return f.select("report_id", "cand_rank", "feature",
                    sizes.sigma_floor(F.col("feature")).alias("sigma_floor"))


@query("P05_feature_score", f"""select report_id, cand_rank, feature, round(s, 4) as sigma_eff, round(dd / s, 4) as z,
  round(-0.5e0 * (dd / s) * (dd / s), 4) as log_contrib
from (select *, distance + 0.0000311e0 as dd, sqrt(sigma_enroll * sigma_enroll + fl * fl) as s from
  (select *, {FLOOR_SQL.format(f='feature')} as fl from fx_feat))""")
def p05(v, spark, sf):
    f = reports.features(v("fx_reports"))
    sc = sizes.feature_score(F.col("distance") + 0.0000311, F.col("sigma_enroll"), sizes.sigma_floor(F.col("feature")))
    return f.select("report_id", "cand_rank", "feature", sc.alias("s")).select(
        "report_id", "cand_rank", "feature", "s.*")


_PAIRED = """(select m.report_id, m.lab_center as a1, r.lab_center as b1, m.hs_hist_center as a2, r.hs_hist_center as b2,
  m.hu_moments as a3, r.hu_moments as b3, m.circularity as ca, r.circularity as cb
  from fx_measured m join fx_shots r on r.article_number = m.label)"""


def _paired(name, sql, cols):
    @query(name, f"select report_id, count(*) as n, round(sum({sql}), 4) as total from {_PAIRED} t group by 1")
    def fn(v, spark, sf):
        return v(f"select * from {_PAIRED} t").select("report_id", cols().alias("d")).groupBy(
            "report_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("total"))


_paired("P06_delta_e", euclid_sql("a1", "b1"), lambda: dist.delta_e_cie76(F.col("a1"), F.col("b1")))
_paired("P07_bhattacharyya", bhatta_sql("a2", "b2"),
        lambda: dist.bhattacharyya_distance(F.col("a2"), F.col("b2")))
_paired("P08_hu_log_distance", l1_sql("a3", "b3"), lambda: dist.hu_log_distance(F.col("a3"), F.col("b3")))

_HUE = """(select a.report_id, a.hue_hist as ha, b.hue_hist as hb, a.mean_hsv as va, b.mean_hsv as vb, a.hu_moments as ma,
  b.hu_moments as mb, a.circularity as ca, b.circularity as cb from fx_rep a join fx_rep b on b.report_id = a.report_id + 1)"""


@query("P09_color_distance", f"""select report_id, round(least(greatest(0.6e0 * {bhatta_sql('ha', 'hb')}
  + 0.2e0 * abs(va[3] - vb[3]) / 255e0 + 0.2e0 * abs(va[2] - vb[2]) / 255e0, 0e0), 1e0), 5) as d from {_HUE} t""")
def p09(v, spark, sf):
    c = F.col
    return v(f"select * from {_HUE} t").select("report_id", F.round(dist.color_distance(
        c("ha"), c("hb"), c("va"), c("vb")), 5).alias("d"))


@query("P10_shape_distance", f"""select report_id, round(least(greatest(0.7e0 * ({l1_sql('ma', 'mb')}) / 5e0
  + 0.3e0 * abs(ca - cb), 0e0), 1e0), 5) as d from {_HUE} t""")
def p10(v, spark, sf):
    c = F.col
    return v(f"select * from {_HUE} t").select("report_id", F.round(dist.shape_distance(
        c("ma"), c("mb"), c("ca"), c("cb")), 5).alias("d"))


@query("P11_scalar_value", """select report_id, circle_diameter_mm as diameter_mm, circularity,
  case when solidity > 0 then solidity end as solidity from fx_rep""")
def p11(v, spark, sf):
    m = v("fx_heads").select("report_id", "measured.*")
    return m.select("report_id", *[dist.scalar_value(f).alias(f) for f in C.SCALAR_FEATURES])


@query("P12_proto_distance", f"""select g.image_id, round(case when len(g.lab_rim) = len(f.lab_rim) and len(g.lab_rim) > 0
  then {euclid_sql('g.lab_rim', 'f.lab_rim')} end, 5) as d
from fx_t1_golden g join fx_t1_fresh f using (image_id)""")
def p12(v, spark, sf):
    g, f = v("fx_t1_golden"), v("fx_t1_fresh").select("image_id", F.col("lab_rim").alias("fresh"))
    return g.join(f, "image_id").select("image_id", F.round(dist.proto_distance(
        "delta_e_rim", F.col("fresh"), F.col("lab_rim")), 5).alias("d"))


@query("P13_describe_color", """select report_id, case when s < 40 then case when v < 60 then 'schwarz' when v < 170 then 'grau' else 'weiß' end
  when h <= 10 then 'rot' when h <= 25 then 'orange' when h <= 35 then 'gelb' when h <= 85 then 'grün'
  when h <= 100 then 'türkis' when h <= 130 then 'blau' when h <= 150 then 'violett' when h <= 170 then 'pink' else 'rot' end as color
from (select report_id, mean_hsv[1] as h, mean_hsv[2] as s, mean_hsv[3] as v from fx_rep)""")
def p13(v, spark, sf):
    hsv = F.col("measured.mean_hsv")
    return v("fx_heads").select("report_id", sizes.describe_color(
        F.get(hsv, 0), F.get(hsv, 1), F.get(hsv, 2)).alias("color"))


_SLUG = """upper(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(trim(name),
  'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'), '[^A-Za-z0-9]+', '-', 'g'),
  '^-+|-+$', '', 'g'))"""
SLUG_SQL = f"case when {_SLUG} = '' then 'ARTIKEL' else {_SLUG} end"


@query("P14_slug", f"select id, {SLUG_SQL} as slug from fx_names")
def p14(v, spark, sf):
    return v("fx_names").select("id", text.slug(F.col("name")).alias("slug"))


@query("P15_unique_article_number", f"""with req as (select id, {SLUG_SQL} as base from fx_names),
taken as (select distinct base as nr from req where id % 7 = 0 union select distinct concat(base, '-3') from req where id % 11 = 0),
want as (select *, row_number() over (partition by base order by id) as nth from req),
cnt as (select base, count(*) as n from want group by 1),
tk as (select base, count(*) as t from cnt join taken on nr = base or starts_with(nr, concat(base, '-')) group by 1),
cand as (select base, unnest(range(1, n + coalesce(t, 0) + 2)) as i from cnt left join tk using (base)),
free as (select base, case when i = 1 then base else concat(base, '-', cast(i as string)) end as nr, i from cand),
ok as (select *, row_number() over (partition by base order by i) as nth from free where nr not in (select nr from taken))
select id, nr as article_number from want join ok using (base, nth)""")
def p15(v, spark, sf):
    from ..sources import master
    req = v("fx_names").withColumn("base", text.slug(F.col("name")))
    taken = req.where("id % 7 = 0").select(F.col("base").alias("article_number")).union(
        req.where("id % 11 = 0").select(F.concat("base", F.lit("-3")))).distinct()
    return master.unique_article_numbers(req.select("id", "name"), taken, "id").select(
        "id", "article_number")


@query("P16_natural_sort_key", """select name, row_number() over (order by pre, num, suf, name) as pos from (
  select distinct name, lower(regexp_extract(name, '^([^0-9]*)', 1)) as pre,
    cast(regexp_extract(name, '([0-9]+)', 1) as bigint) as num, lower(name) as suf
  from (select concat('Teil-', cast(p_partkey * 7 % 1009 as string)) as name from part
        union select concat('teil-', cast(p_size as string)) from part))""")
def p16(v, spark, sf):
    names = v("select concat('Teil-', cast(p_partkey * 7 % 1009 as string)) as name from part "
              "union select concat('teil-', cast(p_size as string)) from part")
    return reports.natural_positions(names, "name", "pos")


_CH = {ch: ", ".join(f"'{f}'" for f in fs) for ch, fs in C.CHANNELS.items()}


@query("P17_channel_percentages", "select report_id, cand_rank, " + ", ".join(
    f"case when count_if(feature in ({fs})) > 0 then round(exp(sum(case when feature in ({fs}) then weighted end)), 6) end as {ch}"
    for ch, fs in _CH.items()) + " from fx_feat group by 1, 2")
def p17(v, spark, sf):
    c = reports.candidates(v("fx_reports"))
    return c.select("report_id", "cand_rank", *[F.round(x, 6).alias(ch) for ch, x in
                                                reports.channel_percentages(F.col("features")).items()])


@query("P18_format_helpers", """select report_id, cand_rank,
  case when height_mm <> 0 then concat('Ø ', replace(printf('%.1f', corrected_diameter_mm), '.', ','), ' mm (höhenkorrigiert, h = ', printf('%.0f', height_mm), ' mm)')
    else concat('Ø ', replace(printf('%.1f', corrected_diameter_mm), '.', ','), ' mm (Bodenebene)') end as diameter_text,
  concat(cast(cand_rank as string), '. ', name, ' · ', printf('%.0f', posterior * 100), ' %') as rank_line,
  case decision when 'accept' then concat('✓ Automatisch übernommen: ', name) when 'ambiguous' then 'Bitte bestätigen' else 'Kein Treffer' end as headline,
  case decision when 'accept' then 'accept' when 'ambiguous' then 'confirm' else 'reject' end as tone
from (select report_id, cand_rank, name, height_mm, corrected_diameter_mm + 0.0137e0 as corrected_diameter_mm,
    posterior + 0.000013e0 as posterior from fx_cand) join (select report_id, decision from fx_rep) using (report_id)""")
def p18(v, spark, sf):
    c = F.col
    return reports.candidates(v("fx_heads"), "decision").select(
        "report_id", "cand_rank",
        text.format_diameter(c("corrected_diameter_mm") + 0.0137, c("height_mm")).alias("diameter_text"),
        text.format_rank_line(c("cand_rank"), c("name"), c("posterior") + 0.000013).alias("rank_line"),
        text.headline(c("decision"), c("name")).alias("headline"),
        text.headline_class(c("decision")).alias("tone"))


@query("P19_derive_article", """select report_id, case when rnd then round(circle_diameter_mm * f, 2) end as diameter_mm,
  case when not rnd then round(equiv_diameter_mm * f, 2) end as width_mm,
  case when not rnd then round(equiv_diameter_mm * aspect_ratio * f, 2) end as depth_mm,
  case when h <> 0 then h end as height_mm, 'Automatisch per Kamera angelegt.' as notes
from (select *, circularity >= 0.8e0 and aspect_ratio >= 0.8e0 as rnd, (300e0 - h) / 300e0 as f
  from (select *, (k % 4) * 10e0 + 0.07e0 * (k % 3) as h from fx_rep))""")
def p19(v, spark, sf):
    r = v("select *, (k % 4) * 10e0 + 0.07e0 * (k % 3) as h from fx_rep")
    shape = {"circle_diameter_mm": F.col("circle_diameter_mm"), "circularity": F.col("circularity"),
             "aspect_ratio": F.col("aspect_ratio"), "long_mm": F.col("equiv_diameter_mm"),
             "short_mm": F.col("equiv_diameter_mm") * F.col("aspect_ratio"),
             "height_mm": F.col("h"), "h": F.get("mean_hsv", 0), "s": F.get("mean_hsv", 1),
             "v": F.get("mean_hsv", 2), "notes": F.lit(None).cast("string")}
    out = sizes.derive_article(shape, P)
    return r.select("report_id", *[out[c].alias(c) for c in
                                   ("diameter_mm", "width_mm", "depth_mm", "height_mm", "notes")])


@query("P20_ring_zone", """select grp, count_if(radius < 0.6e0) as center, count_if(radius > 0.75e0) as rim,
  count_if(not (radius < 0.6e0) and not (radius > 0.75e0)) as neither from fx_pixels group by 1""")
def p20(v, spark, sf):
    z = v("fx_pixels").select("grp", sizes.ring_zone(F.col("radius")).alias("z"))
    return z.groupBy("grp").agg(F.count_if(F.col("z") == "center").alias("center"),
                                F.count_if(F.col("z") == "rim").alias("rim"),
                                F.count_if(F.col("z").isNull()).alias("neither"))


@query("P21_decide", "select report_id, decision from fx_rep")
def p21(v, spark, sf):
    r, best = v("fx_heads"), F.get("candidates", 0)
    return r.select("report_id", judge.decide(
        F.size("candidates"), F.col("max_z_winner"), F.col("llr_margin"), best["has_references"],
        3.5, 2.0).alias("decision"))


@query("P22_predicted_article", "select report_id, pred as predicted from fx_rep")
def p22(v, spark, sf):
    return v("fx_heads").select("report_id", judge.predicted_article(F.col("candidates")).alias("predicted"))


@query("P23_judgement", "select report_id, ok as judged from fx_judged")
def p23(v, spark, sf):
    return reports.judged(v("fx_heads")).select("report_id", F.col("ok").alias("judged"))


@query("P24_band", "select image_id, field, case when abs(a - g) <= q then 'pass' when abs(a - g) <= s then 'drift' else 'fail' end as band from ("
       + " union all ".join(f"select g.image_id, '{f}' as field, g.{f} as g, f.{f} as a, {C.QUANTUM[f]!r}::double as q, {C.SOFT[f]!r}::double as s "
                            "from fx_t1_golden g join fx_t1_fresh f using (image_id)" for f in C.TIER1_SCALARS if f != "perimeter_mm") + ")")
def p24(v, spark, sf):
    from ..operators import regression
    long = regression.scalar_pairs(v("fx_t1_golden"), v("fx_t1_fresh"), "image_id",
                                   [f for f in C.TIER1_SCALARS if f != "perimeter_mm"])
    return long.select("image_id", "field", cmp.band_by_name(
        F.col("field"), F.col("golden"), F.col("actual")).alias("band"))


def band_sql(field: str, g: str, a: str) -> str:
    q, s = C.QUANTUM.get(field, 5e-5), C.SOFT.get(field, 0.01)
    return f"case when abs({a} - {g}) <= {q!r}::double then 'pass' when abs({a} - {g}) <= {s!r}::double then 'drift' else 'fail' end"


@query("P25_scalar_diff", f"""select g.image_id, round(f.perimeter_mm - g.perimeter_mm, 6) as delta,
  case when g.perimeter_mm is null or f.perimeter_mm is null then 'fail' else {band_sql('perimeter_mm', 'g.perimeter_mm', 'f.perimeter_mm')} end as band
from fx_t1_golden g join fx_t1_fresh f using (image_id) where not (g.perimeter_mm is null and f.perimeter_mm is null)""")
def p25(v, spark, sf):
    g, f = v("fx_t1_golden"), v("fx_t1_fresh").select("image_id", F.col("perimeter_mm").alias("fresh"))
    d = cmp.scalar_diff("perimeter_mm", F.col("perimeter_mm"), F.col("fresh"))
    return g.join(f, "image_id").withColumn("d", d).where("d is not null").select(
        "image_id", F.round(F.nanvl("d.delta", F.lit(None).cast("double")), 6).alias("delta"), "d.band")


@query("P26_vector_diff", f"""select image_id, round(case when same then av - gv end, 6) as delta,
  case when not same then 'fail' else {band_sql('lab_rim', 'gv', 'av')} end as band
from (select *, ga[ix] as gv, fa[ix] as av from (
  select g.image_id, g.lab_rim as ga, f.lab_rim as fa, len(g.lab_rim) = len(f.lab_rim) as same,
    list_position(list_transform(list_zip(g.lab_rim, f.lab_rim), lambda t: abs(t[2] - t[1])),
      list_max(list_transform(list_zip(g.lab_rim, f.lab_rim), lambda t: abs(t[2] - t[1])))) as ix
  from fx_t1_golden g join fx_t1_fresh f using (image_id)))""")
def p26(v, spark, sf):
    g, f = v("fx_t1_golden"), v("fx_t1_fresh").select("image_id", F.col("lab_rim").alias("fresh"))
    d = cmp.vector_diff("lab_rim", F.col("lab_rim"), F.col("fresh"))
    return g.join(f, "image_id").withColumn("d", d).select(
        "image_id", F.round(F.nanvl("d.delta", F.lit(None).cast("double")), 6).alias("delta"), "d.band")


TONE = ("case when touches_border then 'border' when decision in ('accept', 'ambiguous') then decision else 'reject' end")


@query("P27_tone", f"select report_id, {TONE} as tone from fx_rep")
def p27(v, spark, sf):
    return v("fx_heads").select("report_id", judge.tone(F.col("touches_border"), F.col("decision")).alias("tone"))


@query("P28_filter_reports", f"""select report_id, stem from fx_judged where {TONE} = 'accept' and ok
  and case when pred = 'NO_MATCH' then '— kein Kandidat' else pred end like '%ART-0000001%'
  and stem >= '19960101' and stem <= '20001231￿'""")
def p28(v, spark, sf):
    return reports.filter_reports(v("fx_heads"), tone="accept", judged=True, article="ART-0000001",
                                  since="19960101", until="20001231").select("report_id", "stem")


@query("P29_filter_series", """select report_id, ts_iso from fx_rep where label = 'ART-000000017'
  and coalesce(ts_iso, '') >= '1996-01-01' and coalesce(ts_iso, '') <= '2001-06-01' order by stem desc limit 8""")
def p29(v, spark, sf):
    return reports.filter_series(v("fx_heads"), label="ART-000000017", since="1996-01-01",
                                 until="2001-06-01", limit=8).select(
        "report_id", F.col("timestamp").alias("ts_iso"))


@query("P30_stem_timestamp", """select report_id, case when report_id % 13 = 0 then concat('fremd-', stem)
  else strftime(strptime(substr(stem, 1, 15), '%Y%m%d-%H%M%S'), '%d.%m.%Y %H:%M:%S') end as shown from fx_rep""")
def p30(v, spark, sf):
    stem = F.when(F.col("report_id") % 13 == 0, F.concat(F.lit("fremd-"), F.col("stem"))).otherwise(F.col("stem"))
    return v("fx_heads").select("report_id", text.stem_text(stem).alias("shown"))


@query("P31_drift_width", """select report_id, round(case when lat_p98_mm > 0 then lat_p98_mm else circle_diameter_mm * aspect_ratio end, 8) as width_mm,
  case when lat_p98_mm > 0 then 'lat_p98' else 'proxy' end as source from fx_rep""")
def p31(v, spark, sf):
    w, s = sizes.drift_width(F.col("lat_p98_mm"), F.col("circle_diameter_mm"), F.col("aspect_ratio"))
    return v("fx_heads").select("report_id", "measured.*").select(
        "report_id", F.round(w, 8).alias("width_mm"), s.alias("source"))


def wilson_sql(k: str, n: str, corpus: bool = False) -> dict:
    """p, lo, hi as SQL; n = 0 gives (0, 0, 1), in the corpus form (0, 0, 0)."""
    d = f"(1e0 + 3.8416e0 / {n})"
    p = f"({k} * 1e0 / {n})"
    mid = f"(({p} + 3.8416e0 / (2e0 * {n})) / {d})"
    half = f"(1.96e0 * sqrt({p} * (1e0 - {p}) / {n} + 3.8416e0 / (4e0 * {n} * {n})) / {d})"
    return {"p": f"round(case when {n} > 0 then {p} else 0e0 end, 4)",
            "lo": f"round(case when {n} > 0 then greatest(0e0, {mid} - {half}) else 0e0 end, 4)",
            "hi": f"round(case when {n} > 0 then least(1e0, {mid} + {half}) else {'0e0' if corpus else '1e0'} end, 4)"}


_W, _WC = wilson_sql("k", "n"), wilson_sql("k", "n", True)
_KN = "(select label, count_if(ok) as k, count_if(ok is not null) as n from fx_judged where label is not null group by 1)"


@query("P32_wilson_interval", f"select label, {_W['p']} as p, {_W['lo']} as lo, {_W['hi']} as hi, {_WC['lo']} as corpus_lo, {_WC['hi']} as corpus_hi from {_KN} t")
def p32(v, spark, sf):
    t = reports.judged(v("fx_heads")).where("label is not null").groupBy("label").agg(
        F.count_if("ok").alias("k"), F.count("ok").alias("n"))
    a, b = cmp.wilson(F.col("k"), F.col("n")), cmp.wilson(F.col("k"), F.col("n"), corpus=True)
    return t.select("label", F.round(a["p"], 4).alias("p"), F.round(a["lo"], 4).alias("lo"),
                    F.round(a["hi"], 4).alias("hi"), b["lo"].alias("corpus_lo"), b["hi"].alias("corpus_hi"))


@query("P33_rule_of_three", f"select label, round(case when n > 0 and n - k = 0 then 3e0 / n end, 6) as bound from {_KN} t")
def p33(v, spark, sf):
    t = reports.judged(v("fx_heads")).where("label is not null").groupBy("label").agg(
        F.count_if("ok").alias("k"), F.count("ok").alias("n"))
    return t.select("label", F.round(cmp.rule_of_three(F.col("n") - F.col("k"), F.col("n")), 6).alias("bound"))


TRUTH_ORIGIN = """case when verdict = 'correct' then case when coalesce(label, '') <> '' then 'verdict-richtig' else 'bewertet_ohne_label' end
  when verdict = 'wrong' then case when coalesce(label, '') <> '' then 'verdict-falsch+artikel' else 'falsch_ohne_artikel' end
  when coalesce(label, '') <> '' then 'evaluate-label' else 'unbewertet' end"""


@query("P34_truth_of", f"select report_id, nullif(label, '') as truth, {TRUTH_ORIGIN} as origin from fx_rep")
def p34(v, spark, sf):
    return v("fx_heads").select("report_id", judge.truth_of(F.col("verdict"), F.col("label")).alias("t")).select(
        "report_id", "t.*")


@query("P35_config_fingerprint", """select session, sha256(concat('{"features":{"center_max":', cast(n as string), ',"rim_min":75}}')) as tier1,
  sha256(concat('{"features":{"center_max":', cast(n as string), ',"rim_min":75},"matching":{"top_k":', cast(m as string), '}}')) as tier2
from (select session, count(*) as n, max(k) as m from fx_rep group by 1)""")
def p35(v, spark, sf):
    from ..operators import gates
    t = v("select session, count(*) as n, max(k) as m from fx_rep group by 1")
    blocks = {"features": {"rim_min": F.lit(75), "center_max": F.col("n")}, "matching": {"top_k": F.col("m")}}
    return t.select("session", gates.config_fingerprint(blocks, ("features",)).alias("tier1"),
                    gates.config_fingerprint(blocks, ("features", "matching")).alias("tier2"))


CHANGE = """case when g.decision is distinct from r.decision then 'entscheidung' when g.top1 is distinct from r.top1 then 'top1'
  when g.articles is distinct from r.articles then 'kandidatenset'
  when g.llr_margin is distinct from r.llr_margin or g.max_z_winner is distinct from r.max_z_winner then 'score' else 'identisch' end"""


@query("P36_change_kind", f"select g.image_id, {CHANGE} as change from fx_golden g join fx_replay r using (image_id)")
def p36(v, spark, sf):
    from ..operators import regression
    return regression.golden_vs_run(v("fx_golden"), v("fx_replay")).select(
        "image_id", F.col("aenderung").alias("change"))


@query("P37_triage_category", """with d as (select g.image_id, g.label, g.articles, g.gate_passed, g.posterior,
  list_filter([case when g.decision is distinct from r.decision then 'decision' end, case when g.articles is distinct from r.articles then 'top_k' end,
    case when g.image_id % 21 = 0 then 'seg_area_px' end, case when g.image_id % 23 = 0 then 'gate_passed' end,
    case when g.image_id % 10 = 4 then 'llr_margin' end], lambda x: x is not null) as fields
  from (select *, case when image_id % 14 = 0 then list_slice(articles, 3, 3) else articles end as arts from fx_golden) g join fx_replay r using (image_id)),
e as (select *, case when image_id % 14 = 0 then list_slice(articles, 3, 3) else articles end as cand from d)
select image_id, case when coalesce(label, '') <> '' and not list_contains(cand, label)
    and (list_has_any(fields, ['top_k', 'decision']) or len(fields) = 0)
    then case when gate_passed and posterior >= 0.95e0 then 'label_verdacht' else 'vorfilter_kill' end
  when list_has_any(fields, ['seg_area_px', 'centroid_x', 'centroid_y']) then 'segmentierungs_aenderung'
  when list_contains(fields, 'gate_passed') then 'gate_kipp' when len(fields) > 0 then 'messwert_drift' else 'unklar' end as category
from e""")
def p37(v, spark, sf):
    g, r = v("fx_golden"), v("fx_replay").select(
        "image_id", F.col("decision").alias("d2"), F.col("articles").alias("a2"))
    j = g.join(r, "image_id")
    i = F.col("image_id")
    fields = F.array_compact(F.array(
        F.when(~F.col("decision").eqNullSafe(F.col("d2")), "decision"),
        F.when(~F.col("articles").eqNullSafe(F.col("a2")), "top_k"), F.when(i % 21 == 0, "seg_area_px"),
        F.when(i % 23 == 0, "gate_passed"), F.when(i % 10 == 4, "llr_margin")))
    cand = F.when(i % 14 == 0, F.slice("articles", 3, 1)).otherwise(F.col("articles"))
    return j.select("image_id", judge.triage_category(fields, {
        "label": F.col("label"), "articles": cand, "gate_passed": F.col("gate_passed"),
        "posterior": F.col("posterior")}).alias("category"))


@query("P38_kill_text", """select report_id, kill_pos, case when reason = 'area' and area_error_pct is not null
    then concat('Fläche ', replace(printf('%+.1f', area_error_pct), '.', ','), ' % (Ø-Gate bestanden)')
  else concat('Ø ', replace(printf('%+.2f', over_tolerance_mm), '.', ','), ' mm über Toleranz (', replace(printf('%.1f', tolerance_mm), '.', ','), ' mm)') end as txt
from fx_kill""")
def p38(v, spark, sf):
    k = reports.kills(v("fx_heads"))
    return k.select("report_id", "kill_pos", sizes.kill_text(
        F.col("reason"), F.col("area_error_pct"), F.col("over_tolerance_mm"),
        F.col("tolerance_mm")).alias("txt"))


@query("P39_attribution_case", """select r.report_id, case when r.n_cand = 0 then 'keine_kandidaten' when t.cand_rank is null then 'vorfilter_kill'
  when t.cand_rank = 1 then 'top1_korrekt' when coalesce(nf1, 0) = 0 or coalesce(nft, 0) = 0 then 'keine_merkmalsscores' else 'attribuierbar' end as fall
from fx_judged r left join fx_cand t on t.report_id = r.report_id and t.article_number = r.label
left join (select report_id, count(*) as nf1 from fx_feat where cand_rank = 1 group by 1) a on a.report_id = r.report_id
left join (select report_id, article_number, count(*) as nft from fx_feat group by 1, 2) b on b.report_id = r.report_id and b.article_number = r.label
where r.ok = false and coalesce(r.label, '') not in ('', 'NO_MATCH')""")
def p39(v, spark, sf):
    from ..operators import analysis
    return analysis.wrong_reports(v("fx_reports")).select("report_id", "fall")


@query("P40_thin_points", """select shape_id, pos, round(x, 4) as x, round(y, 4) as y from (select *, count(*) over (partition by shape_id) as n from fx_contour)
  where (pos - 1) % greatest(1, n // 25) = 0""")
def p40(v, spark, sf):
    from ..operators import geometry
    return geometry.thin_points(v("fx_contour"), 25).select(
        "shape_id", "pos", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("P41_nominal_band", f"""select article_number, nominal_mm, round(nominal_mm - 6e0, 6) as lo, round(nominal_mm + 6e0, 6) as hi
from (select article_number, {NOM} as nominal_mm from fx_articles)""")
def p41(v, spark, sf):
    lo, hi = sizes.nominal_band(F.col("nominal_mm"), 6.0)
    return v("fx_articles").select("article_number", _nominal().alias("nominal_mm")).select(
        "article_number", "nominal_mm", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("P42_geometry_age_text", """select article_number, case when coalesce(diameter_mm, 0e0) <> 0 then printf('Ø %.1f mm', diameter_mm)
  when coalesce(width_mm, 0e0) <> 0 and coalesce(depth_mm, 0e0) <> 0 then printf('%.1f × %.1f mm', width_mm, depth_mm) else '—' end as size_text,
  case when s < 90 then concat('vor ', cast(floor(s) as bigint), ' s') when s < 5400 then concat('vor ', cast(floor(s / 60) as bigint), ' min')
    when s < 172800 then concat('vor ', cast(floor(s / 3600) as bigint), ' h') else concat('vor ', cast(floor(s / 86400) as bigint), ' Tagen') end as age
from (select article_number, diameter_mm, width_mm + 0.01e0 as width_mm, depth_mm + 0.013e0 as depth_mm, article_id * article_id * 0.5e0 as s from fx_articles)""")
def p42(v, spark, sf):
    a = v("select article_number, diameter_mm, width_mm + 0.01e0 as width_mm, depth_mm + 0.013e0 as depth_mm, "
          "article_id * article_id * 0.5e0 as s from fx_articles")
    return a.select("article_number", sizes.geometry_text(
        F.col("diameter_mm"), F.col("width_mm"), F.col("depth_mm")).alias("size_text"),
        sizes.age_text(F.col("s")).alias("age"))


@query("P43_report_detail", """select r.report_id, upper(decision) as badge,
  case when max_z_winner is null then '–' else concat(replace(printf('%.2f', max_z_winner + 0.0003e0), '.', ','), ' (Gate ≤ 3,50)') end as gate_max_z,
  case when llr_margin is null then case when n_cand = 1 then '∞ (1 Kandidat)' else '–' end
    else concat(replace(printf('%.2f', llr_margin + 0.0003e0), '.', ','), ' (≥ 2,00)') end as gate_margin,
  concat(case when ok then 'Richtig' when not ok then 'Falsch' else 'unbewertet' end, case when coalesce(label, '') <> '' then concat(' · Artikel: ', label) else '' end) as verdict,
  n_cand as n_candidates, coalesce(nf, 0) as n_winner_features, n_kill as n_kills
from fx_judged r left join (select report_id, count(*) as nf from fx_feat where cand_rank = 1 group by 1) f using (report_id)""")
def p43(v, spark, sf):
    r = v("fx_reports").withColumns({"max_z_winner": F.col("max_z_winner") + 0.0003,
                                     "llr_margin": F.col("llr_margin") + 0.0003})
    return reports.detail(r, P)


@query("U01_distance_registry", f"""select image_id, round({euclid_sql('g.lab_center', 'f.lab_center')}, 5) as delta_e,
  round({l1_sql('g.hu_moments', 'f.hu_moments')}, 5) as hu, round({bhatta_sql('g.hs_hist_rim', 'f.hs_hist_rim')}, 5) as hist
from fx_t1_golden g join fx_t1_fresh f using (image_id)""")
def u01(v, spark, sf):
    dist.register_sql(spark)
    f = v("fx_t1_fresh").select("image_id", *[F.col(c).alias(f"f_{c}") for c in
                                              ("lab_center", "hu_moments", "hs_hist_rim")])
    return v("fx_t1_golden").join(f, "image_id").selectExpr(
        "image_id", "round(delta_e_cie76(lab_center, f_lab_center), 5) as delta_e",
        "round(hu_log_distance(hu_moments, f_hu_moments), 5) as hu",
        "round(bhattacharyya_distance(hs_hist_rim, f_hs_hist_rim), 5) as hist")


@query("U02_vector_mean_rms", """with e as (select article_number, pos, avg(hu_moments[pos]) as m, sqrt(avg(power(hu_moments[pos], 2))) as r
  from (select article_number, hu_moments, unnest(range(1, 8)) as pos from fx_shots) group by 1, 2)
select article_number, list(round(m, 9) order by pos) as mean, list(round(r, 9) order by pos) as rms from e group by 1""")
def u02(v, spark, sf):
    hu, rounded = F.col("hu_moments"), lambda c: F.transform(c, lambda x: F.round(F.round(x, 13), 9))  # noqa: E731  (first the noise of sums, then ties)
    n = enroll.vector_lengths(v("fx_shots"), ["hu_moments"])["hu_moments"]
    g = v("fx_shots").groupBy("article_number").agg(enroll.mean_of(hu, n).alias("mean"), enroll.rms_of(hu, n).alias("rms"))
    return g.select("article_number", rounded(F.col("mean")).alias("mean"), rounded(F.col("rms")).alias("rms"))


@query("U03_feature_rows", f"""with {CAT}, {stats_ctes('fx_emb')}, {rows_ctes('fx_emb')}
select report_id, cand as article_number, feature, round(d, 5) as distance, round(se, 5) as sigma_enroll from rows_""")
def u03(v, spark, sf):
    e = v("fx_emb").drop("article_number", "article_id")
    rows = scoring.candidate_rows(e, v("fx_articles"), enroll.stats_wide(v("fx_emb")), P)
    return scoring.feature_rows(rows).select("report_id", "article_number", "feature",
                                             F.round("distance", 5).alias("distance"),
                                             F.round("sigma_enroll", 5).alias("sigma_enroll"))
