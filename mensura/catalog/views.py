"""Input views derived from the given tables, in two SQL dialects.

Every view reads whole tables, so the work of each query grows with them. The
text is shared; only array syntax, unnesting and date formatting differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..session import scratch_path

PARTS = "__parts_of_{}__"           # stands for the number of parts of a table, known when a view is read
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class SparkDialect:
    name = "spark"

    @staticmethod
    def arr(n: int, expr: str, var: str = "i") -> str:
        # Written out, which compiles to plain arithmetic; a lambda is interpreted element by element.
        items = [re.sub(rf"\b{var}\b", str(k), expr) for k in range(n)]
        return f"array({', '.join(f'cast({x} as double)' for x in items)})"

    @staticmethod
    def lst(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def el(items: list[str], idx: str) -> str:
        return f"element_at(array({', '.join(items)}), cast({idx} as int))"

    @staticmethod
    def at(vec: str, idx: int) -> str:
        return f"cast({vec}[{idx}] as double)"

    @staticmethod
    def sub(vec: str, start: int, n: int, expr: str) -> str:
        return f"transform(slice({vec}, {start + 1}, {n}), x -> {expr.format(x='cast(x as double)')})"

    ymd = staticmethod(lambda ts: f"date_format({ts}, 'yyyyMMdd')")
    iso = staticmethod(lambda ts: f"date_format({ts}, 'yyyy-MM-dd')")
    rows = staticmethod(lambda hi, alias: f"lateral view explode(slice(sequence(1, 16), 1, cast({hi} as int))) as {alias}")
    nul = staticmethod(lambda: "cast(null as array<double>)")
    # Spark's round goes through decimals, some microseconds a number. What is rounded here never lies halfway between
    # two results, where this is the same double; the zero keeps a negative one from becoming -0.0.
    rnd = staticmethod(lambda expr, n: f"(rint(({expr}) * 1e{n}) / 1e{n} + 0e0)")
    # The catalogue grows with the data; it does not pass through the driver, however small its files look.
    merge = staticmethod(lambda alias: f"/*+ merge({alias}) */ ")


class DuckDialect:
    name = "duck"

    @staticmethod
    def arr(n: int, expr: str, var: str = "i") -> str:
        return f"list_transform(range(0, {n}), lambda {var}: cast({expr} as double))"

    @staticmethod
    def lst(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def el(items: list[str], idx: str) -> str:
        return f"([{', '.join(items)}])[{idx}]"

    @staticmethod
    def at(vec: str, idx: int) -> str:
        return f"cast({vec}[{idx + 1}] as double)"

    @staticmethod
    def sub(vec: str, start: int, n: int, expr: str) -> str:
        return (f"list_transform(list_slice({vec}, {start + 1}, {start + n}), "
                f"lambda x: {expr.format(x='cast(x as double)')})")

    ymd = staticmethod(lambda ts: f"strftime({ts}, '%Y%m%d')")
    iso = staticmethod(lambda ts: f"strftime({ts}, '%Y-%m-%d')")
    rows = staticmethod(lambda hi, alias: f", unnest(range(1, {hi} + 1)) as _u({alias})")
    nul = staticmethod(lambda: "cast(null as double[])")
    rnd = staticmethod(lambda expr, n: f"round({expr}, {n})")
    merge = staticmethod(lambda alias: "")


def art(expr: str) -> str:
    return f"concat('ART-', lpad(cast({expr} as string), 9, '0'))"


# --- shared expressions of the synthetic reports (k order, c customer, j rank) ---
AID = ("(c + case when k % 6 = 0 then (case when j = 1 then 1 when j = 2 then 0 else j - 1 end)"
       " when k % 12 = 1 then j else j - 1 end)")


def log_score(d, j: str) -> str:
    return d.rnd(f"-(((k * 31) % 400) / 100e0 + ({j} - 1) * (0.05e0 + ((k * 7919) % 5000) / 1000e0))", 4)


def cand_exprs(d, a: str = AID, j: str = "j") -> dict:
    """Columns of candidate ``j``, whose article is number ``a``, up to its features."""
    nominal = d.rnd(f"60e0 + 1.9e0 * {a}", 2)
    return {
        "article_number": art(a),
        "name": f"concat('item ', cast({a} as string))",
        "nominal_size_mm": nominal,
        "height_mm": f"cast(({a} % 5) * 10 as double)",
        "corrected_diameter_mm": d.rnd(f"{nominal} + ((k * 7919 + {j} * 31) % 1199) / 100e0 - 6e0", 2),
        "geometry_error_mm": d.rnd(f"abs(((k * 7919 + {j} * 31) % 1199) / 100e0 - 6e0)", 2),
        "has_references": f"({a} % 9 <> 4)",
        "n_shots": f"cast(case when {a} % 9 <> 4 then 5 + {a} % 9 else 0 end as bigint)",
    }


def cand_tail(d, j: str = "j") -> dict:
    return {
        "log_score": log_score(d, j),
        "posterior": d.rnd(f"(((k * 13) % 500 + 500) / 1000e0) / ({j} * {j} + 0.37e0)", 4),
        "max_abs_z": f"((k * 104729 + {j} * 977) % 4500) / 1000e0",
        "margin_to_next": f"case when {j} < n_cand then {d.rnd(f'{log_score(d, j)} - {log_score(d, f"({j} + 1)")}', 4)} end",
    }


def n_feat(a: str = AID) -> str:
    return f"(case when {a} % 9 <> 4 then 8 else 1 end)"


_FL = [f"{C.SIGMA_FLOORS[C.FLOOR_KEYS[f]]!r}e0" for f in C.ALL_FEATURES]
_WT = [f"{C.FEATURE_WEIGHTS[f]!r}e0" for f in C.ALL_FEATURES]


def feat_enroll(a: str = AID) -> str:
    return f"(((({a}) * 13 + f * 7) % 50) / 100e0 + 0.011e0)"


def feat_z(j: str = "j") -> str:
    return f"(((k * (101 + 37 * f) + 53 * f * {j}) % 4200) / 1000e0)"


def feature_exprs(d, a: str = AID, j: str = "j", f: str = "f", enroll: str = feat_enroll(), z: str = feat_z()) -> dict:
    floor, wt = d.el(_FL, f), d.el(_WT, f)
    eff = d.rnd(f"sqrt({enroll} * {enroll} + {floor} * {floor})", 4)
    return {
        "feature": d.el([f"'{name}'" for name in C.ALL_FEATURES], f),
        "measured": f"case when {f} <= 3 then ((k * 17 + {f}) % 1000) / 10e0 end",
        "reference": f"case when {f} <= 3 then 60e0 + 1.9e0 * ({a}) + {f} / 8e0 end",
        "distance": d.rnd(f"{z} * {eff} + 0.00001234567e0", 4),
        "sigma_enroll": enroll,
        "sigma_eff": eff,
        "z": z,
        "log_contrib": d.rnd(f"-0.5e0 * {z} * {z} + 0.00001234567e0", 4),
        "w_eff": wt,
        "weighted": f"-((k * (7 + {f}) + {j} * (11 + {f} * 3)) % 900) / 1000e0",
    }


_OVER = ("(case when (k + m) % 3 = 0 then -((k * 43 + m) % 599) / 100e0"
         " else ((k * 41 + m * 7) % 1500) / 100e0 + 0.01e0 end)")


def kill_exprs(d) -> dict:
    return {
        "article_number": art("(case when k % 12 = 1 and m = 1 then c else c + 10 + m end)"),
        "name": "concat('kill ', cast(m as string))",
        "reason": "case when (k + m) % 3 = 0 then 'area' else 'diameter' end",
        "geometry_error_mm": d.rnd(f"6e0 + {_OVER}", 2),
        "tolerance_mm": "6e0",
        "over_tolerance_mm": _OVER,
        "area_error_pct": "case when (k + m) % 3 = 0 then ((k * 11) % 900) / 10e0 + 24.1e0 end",
    }


SCALARS = {
    "equiv_diameter_mm": "60e0 + 1.9e0 * c + ((k * 53) % 4000) / 1000e0",
    "circle_diameter_mm": "60e0 + 1.9e0 * c + ((k * 7919) % 6000) / 1000e0 - 3e0",
    "area_mm2": "1000e0 + ((k * 37) % 90000) / 10e0",
    "perimeter_mm": "100e0 + ((k * 41) % 50000) / 100e0",
    "circularity": "((k * 17) % 4000 + 6000) / 10000e0",
    "aspect_ratio": "((k * 19) % 5000 + 5000) / 10000e0",
    "lat_p98_mm": "case when k % 3 = 0 then 0e0 else ((k * 29) % 8000) / 100e0 + 0.01e0 end",
    "mean_saturation": "((k * 61) % 25500) / 100e0",
    "solidity": "case when k % 20 = 0 then 0e0 else ((k * 23) % 1000 + 9000) / 10000e0 end",
}
VECTORS = {
    "mean_hsv": (3, "((k * (67 + i)) % 18000) / 100e0"),
    "hue_hist": (8, "(1 + (k * (71 + i)) % 9) / 64e0"),
    "hu_moments": (7, "((k * (73 + i)) % 9000) / 1000e0 - 4e0"),
    "lab_center": (3, "((k * (79 + i)) % 10000) / 100e0"),
    "lab_rim": (3, "((k * (83 + i)) % 10000) / 100e0"),
    "hs_hist_center": (8, "(1 + (k * (89 + i)) % 7) / 64e0"),
    "hs_hist_rim": (8, "(1 + (k * (97 + i)) % 5) / 64e0"),
}
_ORD = "(select o_orderkey as k, o_custkey as c, o_orderdate as od from orders) o"


def _stem(d) -> str:
    two = "lpad(cast(({}) as string), 2, '0')"
    return (f"concat({d.ymd('od')}, '-', {two.format('k % 24')}, {two.format('(k * 7) % 60')}, "
            f"{two.format('(k * 13) % 60')}, '-', lpad(cast(k % 1000 as string), 3, '0'))")


def _iso(d) -> str:
    two = "lpad(cast(({}) as string), 2, '0')"
    return (f"concat({d.iso('od')}, 'T', {two.format('k % 24')}, ':', {two.format('(k * 7) % 60')}"
            f", ':', {two.format('(k * 13) % 60')}, '.', lpad(cast(k % 1000 as string), 3, '0'), '000')")


def _cols(exprs: dict) -> str:
    return ", ".join(f"{v} as {k}" for k, v in exprs.items())


def _shot_cols(d, a: str, r: str, noise: str) -> str:
    """Measurement columns of a shot of article ``a`` with pseudo random key ``r``."""
    return f"""
  0.85e0 + ({a} % 13) / 100e0 + (({r} * 101) % 1000) / 100000e0 as circularity,
  case when {r} % 50 = 0 then 0e0 else 0.95e0 + ({a} % 7) / 200e0 + (({r} * 211) % 1000) / 200000e0 end as solidity,
  {d.arr(3, f"40 + ({a} * (17 + i)) % 50 + (({r} * (307 + 2 * i)) % 1000) / {noise}")} as lab_center,
  case when {a} % 11 = 0 then {d.nul()} else
    {d.arr(3, f"30 + ({a} * (23 + i)) % 60 + (({r} * (311 + 2 * i)) % 1000) / {noise}")} end as lab_rim,
  {d.arr(8, f"1 + ({a} * (3 + i)) % 9 + ({r} * (401 + 2 * i)) % 3")} as hs_hist_center,
  {d.arr(8, f"1 + ({a} * (5 + i)) % 8 + ({r} * (409 + 2 * i)) % 4")} as hs_hist_rim,
  {d.arr(7, f"(({a} * (5 + i)) % 40) / 10e0 + (({r} * (503 + 2 * i)) % 1000) / 2000e0")} as hu_moments"""


def _fx_articles(d) -> str:
    size = "(60e0 + p_partkey * 1.9e0)"
    return f"""select p_partkey as article_id, {art('p_partkey')} as article_number, p_name as name,
  p_type as category, case when p_partkey % 3 <> 0 then {size} end as diameter_mm,
  case when p_partkey % 3 = 0 then {size} end as width_mm,
  case when p_partkey % 3 = 0 then round({size} * 0.2e0, 2) end as depth_mm,
  case when p_partkey % 5 <> 0 then (p_partkey % 5) * 10e0 end as height_mm,
  p_brand as color_desc, cast(null as string) as notes from part"""


_RAW = "coalesce(diameter_mm, width_mm) * 300e0 / (300e0 - coalesce(height_mm, 0e0))"


def _fx_shots(d) -> str:
    key, r = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string))", "l_orderkey * 31 + l_linenumber * 7 + l_suppkey"
    cols = f"""article_id, shot_key as shot_id, r,
  {_RAW} + ((r * 7919) % 1000) / 500e0 - 1e0 as circle_diameter_mm,
  {_shot_cols(d, 'article_id', 'r', '250e0')}"""
    if d.name == "duck":
        return f"""select article_number, {cols}
from (select l_partkey, {r} as r,
  {key} as shot_key
  from lineitem) l join fx_articles a on a.article_id = l.l_partkey"""
    # Shots lie by article, dealt out while they are narrow, so that statistics of articles and joins on the article
    # exchange no vectors. The number is all that is exchanged by; equal ids are checked beside it.
    return f"""select {d.merge('a')}a.article_number, {cols}
from (select /*+ repartition({PARTS.format('lineitem')}, article_number) */ {art('l_partkey')} as article_number, l_partkey, {r} as r,
  {key} as shot_key
  from lineitem) l join fx_articles a on a.article_number = l.article_number and a.article_id - l.l_partkey = 0"""


def _fx_measured(d) -> str:
    dia = (f"(floor((coalesce(diameter_mm, width_mm) + ((r * 7919) % 1000) / 1000e0 * 6e0 - 3e0)"
           f" * 300e0 / (300e0 - coalesce(height_mm, 0e0)) * 1000e0) / 1000e0 + 0.0003e0)")
    fill = ("(case when diameter_mm is null then 0.26e0 when r % 23 = 0 then 0.7e0"
            " else 0.99e0 end)")
    return f"""select {d.merge('a')}r as report_id, article_number as label, ts_day, {dia} as circle_diameter_mm,
  floor(pi() * {dia} * {dia} / 4e0 * {fill} * 10e0) / 10e0 as area_mm2,
  {_shot_cols(d, '(article_id + case when r % 6 = 0 then 1 else 0 end)', 'r', '125e0')}
from (select o_orderkey as r, o_custkey, o_orderdate as ts_day from orders) o
join fx_articles a on a.article_id = o.o_custkey"""


def _fx_emb(d) -> str:
    dia = f"({_RAW} + 2e0 * {d.at('embedding', 0)})"
    fill = "(case when diameter_mm is null then 0.26e0 else 0.99e0 end)"
    return f"""select vec_id as report_id, vec_id as shot_id, article_id, article_number,
  {dia} as circle_diameter_mm, pi() * {dia} * {dia} / 4e0 * {fill} as area_mm2,
  0.9e0 + 0.05e0 * {d.at('embedding', 46)} as circularity,
  0.95e0 + 0.02e0 * {d.at('embedding', 47)} as solidity,
  0.7e0 + 0.1e0 * {d.at('embedding', 48)} as aspect_ratio,
  {d.sub('embedding', 1, 3, '20e0 * {x}')} as lab_center,
  {d.sub('embedding', 4, 3, '20e0 * {x}')} as lab_rim,
  {d.sub('embedding', 7, 16, 'abs({x})')} as hs_hist_center,
  {d.sub('embedding', 23, 16, 'abs({x})')} as hs_hist_rim,
  {d.sub('embedding', 39, 7, '2e0 * {x}')} as hu_moments,
  {d.sub('embedding', 0, 64, '{x}')} as profile
from embeddings e join fx_articles a on a.article_id = e.label"""


def _fx_stock(d) -> str:
    return ("select * from fx_articles where article_id in "
            "(select distinct label from embeddings)")


def _fx_rep(d) -> str:
    margin = d.rnd(f"{log_score(d, '1')} - {log_score(d, '2')}", 4)
    return f"""select *,
  case when n_cand > 0 then {log_score(d, '1')} end as top_log_score,
  case when n_cand > 1 then {margin} end as llr_margin,
  case when n_cand > 0 then ((k * 104729 + 977) % 4500) / 1000e0 end as max_z_winner,
  n_cand > 0 and ((k * 104729 + 977) % 4500) / 1000e0 <= 3.5e0 as gate_passed,
  case when n_cand > 0 then {art(AID.replace('j', '1'))} else 'NO_MATCH' end as pred,
  case when n_cand = 0 or ((k * 104729 + 977) % 4500) / 1000e0 > 3.5e0 then 'reject'
       when (n_cand = 1 or {margin} >= 2e0)
            and {AID.replace('j', '1')} % 9 <> 4 then 'accept' else 'ambiguous' end as decision
from (select k, c, k as report_id, od, concat('S', lpad(cast(k % 40 as string), 2, '0')) as session,
  {_stem(d)} as stem, {_iso(d)} as ts_iso,
  case when k % 10 = 3 then null when k % 50 = 7 then 'NO_MATCH' else {art('c')} end as label,
  case when k % 8 = 0 then 'correct' when k % 16 = 1 then 'wrong' end as verdict,
  (k * 7 + c) % 5 as n_cand,
  case when k % 7 <> 5 then ((k * 29) % 3840) + 0.5e0 end as cx,
  case when k % 7 <> 5 then ((k * 31) % 2160) + 0.5e0 end as cy,
  k % 29 = 4 as touches_border,
  case when k % 4 = 1 then 2 when k % 4 = 2 then 1 else 0 end as n_kill,
  {_cols(SCALARS)}, {', '.join(f'{d.arr(n, e)} as {v}' for v, (n, e) in VECTORS.items())}
  from {_ORD}) t"""


def _fx_cand(d) -> str:
    return f"""select report_id, k, c, n_cand, cast(j as bigint) as cand_rank, {_cols(cand_exprs(d))},
  {_cols(cand_tail(d))} from fx_rep {d.rows('n_cand', 'j')}"""


def _fx_feat(d) -> str:
    inner = f"""select report_id, k, c, j, has_references, article_number, f from
      (select report_id, k, c, j, {cand_exprs(d)['has_references']} as has_references,
        {cand_exprs(d)['article_number']} as article_number, {n_feat()} as n_feat
       from fx_rep {d.rows('n_cand', 'j')}) q {d.rows('n_feat', 'f')}"""
    return f"""select report_id, cast(j as bigint) as cand_rank, article_number, cast(f as bigint) as fpos,
  {_cols(feature_exprs(d))} from ({inner}) w"""


def _fx_kill(d) -> str:
    return f"""select report_id, k, c, label, cast(m as bigint) as kill_pos, {_cols(kill_exprs(d))}
  from fx_rep {d.rows('n_kill', 'm')}"""


def _fx_judged(d) -> str:
    """Report-level rows with the judgement, for the analysis queries."""
    return """select *, case when verdict = 'correct' then true when verdict = 'wrong' then false
  when coalesce(label, '') <> '' then pred = label end as ok from fx_rep"""


def _fx_reports(d, features: bool = True, fields: tuple = ()) -> str:
    """Nested form of the reports (Spark only); ``fields``: only these of each feature."""
    def struct(exprs: dict) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in exprs.items()) + ")"

    # What several columns of a candidate or a feature are made of is made once: its article, deviation and z.
    j = "(i + 1)"
    feats = (f"transform(transform(slice(sequence(1, 8), 1, {n_feat('a')}), f -> named_struct('f', f, 'e', {feat_enroll('a')}, 'z', {feat_z(j)})), "
             f"w -> {struct(feature_exprs(d, 'a', j, 'w.f', 'w.e', 'w.z'))})")
    if fields:
        few = {n: e for n, e in feature_exprs(d, "a", j).items() if n in fields}
        feats = f"transform(slice(sequence(1, 8), 1, {n_feat('a')}), f -> {struct(few)})"
    cand = struct({**cand_exprs(d, "a", j), **({"features": feats} if features else {}), **cand_tail(d, j)})
    measured = struct({**{k: k for k in SCALARS}, **{k: k for k in VECTORS}})
    return f"""select report_id, stem, ts_iso as timestamp, session, label, verdict, decision,
  llr_margin, max_z_winner, gate_passed, touches_border,
  transform(transform(slice(sequence(1, 4), 1, cast(n_cand as int)), j -> {AID}), (a, i) -> {cand}) as candidates,
  {measured} as measured,
  case when cx is not null then named_struct('x', cx, 'y', cy) end as centroid_px,
  named_struct('w', 3840e0, 'h', 2160e0) as image_size,
  transform(slice(sequence(1, 2), 1, n_kill), m -> {struct(kill_exprs(d))}) as prefiltered,
  concat('captures/', stem, '.png') as image_path, k, c
from fx_rep"""


def _side(d, replay: bool) -> str:
    top_next = "k % 7 = 0" if not replay else "(k % 7 = 0) <> (k % 17 = 0)"
    margin = "(k * 7919 % 5000) / 1000e0"
    if replay:
        margin += (" + case when k % 11 = 0 then 0.03e0 else 0e0 end"
                   " + case when k % 13 = 0 then 0.2e0 else 0e0 end")
    t1 = f"(c + case when {top_next} then 1 else 0 end)"
    t2 = f"(c + case when {top_next} then 0 else 1 end)"
    third = "case when k % 19 = 0 then 3 else 2 end" if replay else "2"
    mz = "(k * 104729 % 4500) / 1000e0"
    gate = "3.5e0"
    return f"""select k as image_id, lpad(cast(k as string), 12, '0') as sha8,
  concat('S', lpad(cast(k % 40 as string), 2, '0')) as session,
  case when k % 101 = 3 then null else {art('c')} end as label, {art(t1)} as top1,
  {d.lst(art(t1), art(t2), art(f'(c + {third})'))} as articles, true as has_refs,
  case when k % 9 = 4 then null else {margin} end as llr_margin, {mz} as max_z_winner,
  {mz} <= {gate} as gate_passed,
  case when {mz} > {gate} then 'reject' when k % 9 = 4 or {margin} >= 2e0 then 'accept'
       else 'ambiguous' end as decision,
  {d.el([f"'{f}'" for f in C.ALL_FEATURES], f'1 + (k * {5 if replay else 3}) % 8')} as driving_feature,
  {mz} as driving_z,
  case when k % 12 = 0 then 'correct' when k % 24 = 1 then 'wrong' end as verdict,
  ((k * 13) % 1000) / 1000e0 as posterior,
  case when k % 5 = 0 then 1 else 2 end as tier
from {_ORD}"""


def _tier1(d, fresh: bool) -> str:
    def sc(name: str, expr: str) -> str:
        if not fresh:
            return f"{expr} as {name}"
        step = C.SOFT[name] if name in C.SOFT else 0.01
        bump = (f"case when k % 30 = 1 then {step * 0.6!r}e0 when k % 90 = 2 then {step * 1.7!r}e0"
                f" when k % 5 = 0 then {C.QUANTUM.get(name, 5e-5) * 0.4!r}e0 else 0e0 end")
        bump = re.sub(r"(\d(?:\.\d+)?)e(-?\d+)e0", r"\1e\2", bump)
        none = "when k % 97 = 5 then null" if name == "perimeter_mm" else ""
        body = f"{expr} + {bump}"
        return f"case {none} else {body} end as {name}" if none else f"{body} as {name}"

    def vec(name: str, n: int, expr: str) -> str:
        if fresh:
            step = C.SOFT[name]
            b = re.sub(r"e(-?\d+)e0", r"e\1", f"{step * 0.7!r}e0")
            expr = f"{expr} + case when k % 40 = 3 and i = k % 3 then {b} else 0e0 end"
        out = d.arr(n, expr)
        if fresh and name == "lab_rim":
            out = f"case when k % 89 = 7 then {d.arr(2, expr)} else {out} end"
        return f"{out} as {name}"

    scal = ", ".join(sc(n, e) for n, e in SCALARS.items() if n != "lat_p98_mm")
    vecs = ", ".join(vec(v, n, e) for v, (n, e) in VECTORS.items())
    shift = " + case when k % 25 = 6 then 0.9e0 else 0e0 end" if fresh else ""
    return f"""select k as image_id, lpad(cast(k as string), 12, '0') as sha8,
  concat('S', lpad(cast(k % 40 as string), 2, '0')) as session, {scal}, {vecs},
  ((k * 37) % 90000) * 1e0{shift} as seg_area_px, ((k * 29) % 3840) + 0.5e0{shift} as centroid_x,
  ((k * 31) % 2160) + 0.5e0 as centroid_y from {_ORD}"""


def _fx_contour(d) -> str:
    """Closed polygons: every supplier is one outline of 60 points, blunt at one end."""
    ang = "(2e0 * pi() * (j - 1) / 60e0)"
    rad = f"(1e0 + 0.22e0 * cos({ang}) + 0.03e0 * cos(3e0 * {ang}))"
    lx = f"((55.137e0 + s % 17) * {rad} * cos({ang}))"
    ly = f"((11.071e0 + (s * 7) % 5) * {rad} * sin({ang}))"
    rot = "(((s * 37) % 180) * pi() / 180e0)"
    return f"""select s as shape_id, cast(j as bigint) as pos,
  200e0 + {lx} * cos({rot}) - {ly} * sin({rot}) as x,
  150e0 + {lx} * sin({rot}) + {ly} * cos({rot}) as y
from (select s_suppkey as s, 60 as n_pts from supplier) t {d.rows60('n_pts', 'j')}"""


def _fx_pixels(d) -> str:
    return """select l_partkey as grp, cast((l_orderkey * 37 + l_linenumber * 11) % 180 as bigint) as hue,
  cast((l_suppkey * 53 + l_linenumber * 29 + l_orderkey) % 256 as bigint) as sat,
  cast((l_orderkey * 7 + l_suppkey) % 256 as bigint) as val,
  ((l_orderkey * 13 + l_linenumber * 101) % 1000) / 1000e0 as radius,
  ((l_orderkey * 17) % 1000) / 10e0 as lab_l, ((l_orderkey * 19) % 2000) / 10e0 - 100e0 as lab_a,
  ((l_suppkey * 23 + l_linenumber) % 2000) / 10e0 - 100e0 as lab_b,
  l_extendedprice as ev from lineitem"""


def _fx_journal(d) -> str:
    return f"""select user_id as session, event_id as line_no,
  event_id % 12 as slot, ts, value as d_mm, event_id % 97 = 0 as broken,
  {art('user_id % 40')} as article_number from events"""


def _fx_names(d) -> str:
    return ("select p_partkey as id, case when p_partkey % 9 = 0 then concat(' Löffel groß ', p_name)"
            " when p_partkey % 9 = 1 then concat('Tee-Kännchen (', p_brand, ')')"
            " when p_partkey % 9 = 2 then ' !! ' else p_name end as name from part")


SparkDialect.rows60 = staticmethod(
    lambda hi, alias: f"lateral view explode(sequence(1, {hi})) as {alias}")
DuckDialect.rows60 = staticmethod(lambda hi, alias: f", unnest(range(1, {hi} + 1)) as _u({alias})")

VIEWS = {
    "fx_articles": _fx_articles, "fx_shots": _fx_shots, "fx_measured": _fx_measured,
    "fx_emb": _fx_emb, "fx_stock": _fx_stock, "fx_rep": _fx_rep, "fx_cand": _fx_cand,
    "fx_feat": _fx_feat, "fx_kill": _fx_kill, "fx_judged": _fx_judged,
    "fx_reports": _fx_reports,
    # The same reports for queries that never look into the features of a candidate, which are most of a report.
    "fx_heads": lambda d: _fx_reports(d, features=False),
    # And for those that read of all features only which they are and their stored mean.
    "fx_refs": lambda d: _fx_reports(d, fields=("feature", "reference")),
    # The whole reports, not stored, for a query that reads them once.
    "fx_docs": _fx_reports,
    "fx_golden": lambda d: _side(d, False), "fx_replay": lambda d: _side(d, True),
    "fx_t1_golden": lambda d: _tier1(d, False), "fx_t1_fresh": lambda d: _tier1(d, True),
    "fx_contour": _fx_contour, "fx_pixels": _fx_pixels, "fx_journal": _fx_journal,
    "fx_names": _fx_names,
}
_NAME = re.compile(r"\bfx_\w+\b")


def _closure(text: str, dialect, seen: dict) -> None:
    for name in _NAME.findall(text):
        if name in VIEWS and name not in seen:
            body = VIEWS[name](dialect)
            _closure(body, dialect, seen)
            seen[name] = body


def _count_if(sql: str) -> str:
    """count_if(x) as count(*) filter (where x): 0, not NULL, on all-NULL input."""
    out, at = [], 0
    for m in re.finditer(r"count_if\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:m.start()], "count(*) filter (where ", _count_if(sql[m.end():end - 1]), ")"]
        at = end
    return "".join(out) + sql[at:]


def duck(body: str) -> str:
    """Oracle text: the views it names become leading CTEs."""
    body = _count_if(body.strip().rstrip(";"))
    ctes: dict[str, str] = {}
    _closure(body, DuckDialect, ctes)
    head = ",\n".join(f"{n} as ({b})" for n, b in ctes.items())
    if not head:
        return body
    if body[:5].lower() == "with ":
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


_SPREAD: dict[tuple, str | int] = {}

# Rows a task takes of a table, where more than a plain row is made of each: a nested report of some
# kilobytes of an order.
_TASK_ROWS = {"orders": 50_000}


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many parts a table is dealt: by its rows, however few files or cores there are."""
    key = (spark.sparkContext.applicationId, sf_dir, name, "parts")
    if key not in _SPREAD:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()         # from the footers
        _SPREAD[key] = max(spark.sparkContext.defaultParallelism, -(-rows // _TASK_ROWS.get(name, 250_000)))
    return _SPREAD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that comes as fewer splits than there are cores (a single small file), or as splits of
    too many rows for what is made of them, is spread once, so that row work is not stuck in a few tasks; a
    table of many splits is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _TASK_ROWS and df.rdd.getNumPartitions() < parts(spark, sf_dir, name):
        # Written, not only exchanged: filters on what is made of the rows would be moved before the exchange.
        path = scratch_path(spark, name)
        df.repartition(parts(spark, sf_dir, name)).write.parquet(path)
        return spark.read.parquet(path)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _table_view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> str:
    """``dealt``: whole rows are made of the table and written, so it can be exchanged in the same job, part by part."""
    dealt = dealt and name in _TASK_ROWS
    key = (spark.sparkContext.applicationId, sf_dir, name, dealt)
    if key not in _SPREAD:
        _SPREAD[key] = f"given_{name}_{len(_SPREAD)}"
        df = (spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts(spark, sf_dir, name)) if dealt
              else table(spark, sf_dir, name))
        df.createOrReplaceTempView(_SPREAD[key])
    return _SPREAD[key]


# Views that stand for stored tables (reports). They are derived once per session and kept as Parquet in
# the shared folder, as such tables would be. Shots and measurements are derived where they are read: their vectors
# are cheap to make and far wider than what they are made of.
STORED = ("fx_emb", "fx_reports", "fx_t1_golden", "fx_t1_fresh")
# Read once with all they hold: their table is exchanged in the same job, part by part, as for a stored view.
ONCE = {"fx_docs"}


def _stored_view(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SPREAD:
        path = scratch_path(spark, name)
        _run(spark, sf_dir, f"select * from {name}", keep={name}).write.parquet(path)
        _SPREAD[key] = f"stored_{name}_{len(_SPREAD)}"
        spark.read.parquet(path).createOrReplaceTempView(_SPREAD[key])
    return _SPREAD[key]


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view by name, or a query over views, as a Spark DataFrame."""
    return _run(spark, sf_dir, text if " " in text else f"select * from {text}", {text} & ONCE)


def _run(spark: SparkSession, sf_dir: str, body: str, keep: set) -> DataFrame:
    ctes: dict[str, str] = {}
    for name in STORED:
        if name not in keep and re.search(rf"\b{name}\b", body):
            ctes[name] = f"select * from {_stored_view(spark, sf_dir, name)}"
    _closure(body, SparkDialect, ctes)
    used = " ".join([body, *ctes.values()])
    base = {t: f"select * from {_table_view(spark, sf_dir, t, bool(keep))}"
            for t in TABLES if re.search(rf"\b{t}\b", used)}
    for t in base:
        if PARTS.format(t) in used:
            ctes = {n: b.replace(PARTS.format(t), str(parts(spark, sf_dir, t))) for n, b in ctes.items()}
    head = ", ".join(f"{n} as ({b})" for n, b in {**base, **ctes}.items())
    return spark.sql(f"with {head} {body}")


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table (statistics, leave-one-out rows) written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SPREAD:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _SPREAD[key] = path
    return spark.read.parquet(_SPREAD[key])
