"""Closed-form cases, boundaries, errors and brute-force comparisons."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura import Params, constants as C
from mensura.functions import compare, distances, judge, sizes, text
from mensura.operators import analysis, enroll, gates, geometry, joins, loo, order_stats as O, pairs, ranks, regression, scoring, stats, whatif
from mensura.sources import master, reports as SR, runs
from mensura.streaming import streams


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("r")).first()["r"]


def arr(v):
    return F.array(*[F.lit(float(x)) for x in v])


# --- functions --------------------------------------------------------------

@pytest.mark.parametrize("d,w,p,want", [(240.0, 1.0, 2.0, 240.0), (0.0, 20.0, 190.0, 190.0), (None, 30.0, None, 30.0), (0.0, 0.0, 5.0, None)])
def test_nominal(spark, d, w, p, want):
    cols = [F.lit(x).cast("double") for x in (d, w, p)]
    assert one(spark, sizes.nominal_size_mm(*cols)) == want


def test_height_correction_is_clamped(spark):
    assert one(spark, sizes.height_corrected(F.lit(300.0), F.lit(30.0), 300.0)) == pytest.approx(270.0)
    assert one(spark, sizes.height_corrected(F.lit(300.0), F.lit(299.0), 300.0)) == pytest.approx(60.0)


def test_zero_sigma_is_an_error(spark):
    with pytest.raises(Exception, match="sigma_eff is 0"):
        one(spark, sizes.feature_score(F.lit(1.0), F.lit(0.0), F.lit(0.0)))


def test_bhattacharyya(spark):
    a, b = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    assert one(spark, distances.bhattacharyya_distance(arr(a), arr(b))) == pytest.approx(math.sqrt(0.5), abs=1e-6)
    assert one(spark, distances.bhattacharyya_distance(arr([0, 0]), arr([0, 0]))) == 1.0


def test_proto_distance_needs_equal_lengths(spark):
    assert one(spark, distances.proto_distance("hu_log", arr([1, 2]), arr([1, 2, 3]))) is None
    assert one(spark, distances.proto_distance("hu_log", arr([1, 2]), arr([2, 4]))) == 1.5


@pytest.mark.parametrize("name,want", [("Löffel groß!", "LOEFFEL-GROSS"), ("  --  ", "ARTIKEL"), ("Tee 1/2", "TEE-1-2")])
def test_slug(spark, name, want):
    assert one(spark, text.slug(F.lit(name))) == want


def test_natural_order(spark):
    names = ["LOEFFEL-11", "LOEFFEL-2", "TELLER", "2-A", "loeffel-2", "LOEFFEL-02"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.natural_sort_key(F.col("n")), "n").collect()]
    assert got == ["2-A", "LOEFFEL-02", "LOEFFEL-2", "loeffel-2", "LOEFFEL-11", "TELLER"]


def test_natural_order_of_long_numbers(spark):
    names = ["a" + "9" * 45, "a1" + "0" * 45, "a" + "0" * 60 + "7", "a8", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.natural_sort_key(F.col("n")), "n").collect()]
    assert got == ["a", "a" + "0" * 60 + "7", "a8", "a" + "9" * 45, "a1" + "0" * 45]


@pytest.mark.parametrize("n,z,m,refs,want", [
    (0, None, None, None, "reject"), (2, 3.5, 2.0, True, "accept"), (2, 3.5001, 9.0, True, "reject"),
    (2, 1.0, 1.9999, True, "ambiguous"), (1, 1.0, None, True, "accept"), (1, 1.0, None, False, "ambiguous")])
def test_decision_limits_are_inclusive(spark, n, z, m, refs, want):
    got = judge.decide(F.lit(n), F.lit(z).cast("double"), F.lit(m).cast("double"), F.lit(refs).cast("boolean"), 3.5, 2.0)
    assert one(spark, got) == want


def test_judgement_prefers_the_verdict(spark):
    j = lambda v, l: one(spark, judge.judgement(F.lit(v).cast("string"), F.lit(l).cast("string"), F.lit("A")))
    assert (j("correct", "B"), j("wrong", "A"), j(None, "A"), j(None, "B"), j(None, ""), j(None, None)) == (
        True, False, True, False, None, None)


def test_diffs(spark):
    null = F.lit(None).cast("double")
    assert one(spark, compare.scalar_diff("area_mm2", null, null)) is None
    d = one(spark, compare.scalar_diff("area_mm2", F.lit(1.0), null))
    assert d["band"] == "fail" and math.isnan(d["delta"])
    v = one(spark, compare.vector_diff("lab_rim", arr([1, 2, 3]), arr([1.2, 1.8, 3])))
    assert v["golden"] == 1.0 and v["delta"] == pytest.approx(0.2)         # first on ties
    assert one(spark, compare.vector_diff("lab_rim", arr([1]), arr([1, 2])))["band"] == "fail"


def test_wilson_conventions(spark):
    w = one(spark, compare.wilson(F.lit(95), F.lit(104), corpus=True))
    assert (w["p"], w["lo"], w["hi"]) == (0.9135, 0.8437, 0.9538)
    w = one(spark, compare.wilson(F.lit(0), F.lit(44), corpus=True))
    assert (w["lo"], w["hi"]) == (0.0, 0.0803)
    a, b = one(spark, compare.wilson(F.lit(0), F.lit(0))), one(spark, compare.wilson(F.lit(0), F.lit(0), corpus=True))
    assert (a["hi"], b["hi"]) == (1.0, 0.0)


def test_color_ladder(spark):
    c = lambda *hsv: one(spark, sizes.describe_color(*[F.lit(float(x)) for x in hsv]))
    assert [c(0, 10, 30), c(0, 10, 100), c(0, 10, 200), c(10, 99, 99), c(85, 99, 99), c(175, 99, 99)] == [
        "schwarz", "grau", "weiß", "rot", "grün", "rot"]


# --- exact order statistics -------------------------------------------------

def test_quantiles_with_a_hot_group_and_ties(spark):
    rnd = random.Random(3)
    rows = [("hot", round(rnd.gauss(0, 1), 2)) for _ in range(3000)] + [("b", float(i)) for i in range(7)] + [("c", 5.0)]
    rows += [(None, float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in O.quantiles(df, ["k"], "x", {"med": O.MEDIAN, "q9": O.linear(0.9), "lo": O.lower(0.25), "um": O.UPPER_MEDIAN}, count="n").collect()}
    for k in ("hot", "b", "c", None):
        v = sorted(x for kk, x in rows if kk == k)
        assert got[k].n == len(v)
        assert got[k].med == pytest.approx(np.median(v)) and got[k].q9 == pytest.approx(np.percentile(v, 90))
        assert got[k].lo == v[int(0.25 * (len(v) - 1))] and got[k].um == v[len(v) // 2]


def test_loo_median_and_z_match_brute_force(spark):
    rnd = random.Random(5)
    groups = {"odd": [rnd.gauss(0, 1) for _ in range(11)], "even": [rnd.choice([1.0, 2.0, 3.0]) for _ in range(10)],
              "flat": [2.0] * 6, "two": [1.0, 4.0], "three": [1.0, 2.0, 9.0]}
    rows = [(g, i, x) for g, v in groups.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    out = enroll.loo_robust_z(enroll.loo_classic_z(O.loo_median(df, ["g"], "x", "m"), ["g"], "x", "zc"), ["g"], "x", "zr")
    for r in out.collect():
        o = np.delete(np.array(groups[r.g]), r.i)
        assert r.m == pytest.approx(np.median(o))
        sd = o.std(ddof=1) if len(o) > 1 else 0
        mad = np.median(np.abs(o - np.median(o)))
        assert r.zc == (pytest.approx((r.x - o.mean()) / sd) if sd > 0 else None)
        assert r.zr == (pytest.approx((r.x - np.median(o)) / (1.4826 * mad)) if mad > 0 else None)


def test_global_position(spark):
    rows = [("a" if i % 3 else "b", (i * 7919) % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x int")
    got = ranks.global_position(df, ["k"], [F.col("x")], "p").collect()
    for k in "ab":
        assert [r.x for r in sorted((r for r in got if r.k == k), key=lambda r: r.p)] == sorted(x for kk, x in rows if kk == k)


def test_k_safe(spark):
    rows = [(1, None, True, "accept"), (2, 5.0, True, "accept"), (3, 4.0, False, "ambiguous"), (4, 3.0, True, "accept"), (5, 9.0, False, "reject")]
    df = spark.createDataFrame(rows, "i int, m double, ok boolean, d string").withColumn("v", F.lit("x"))
    args = dict(margin="m", correct="ok", decision="d", order="i")
    assert ranks.k_safe(df, ["v"], **args).first()["k_safe"] == 2
    assert ranks.k_safe(df, ["v"], include_rejects=True, **args).first()["k_safe"] == 1


def test_sigma_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([(0.1,)] * 29, "x double").repartition(7)
    assert df.agg(enroll.sample_std("x").alias("s")).first()["s"] == 0.0


# --- leave-one-out ----------------------------------------------------------

def test_hu_spread_matches_brute_force(spark):
    rnd = np.random.default_rng(1)
    data = {"a": rnd.normal(size=(15, 7)), "b": np.round(rnd.normal(size=(6, 7))), "c": np.tile([[1.0] * 7], (4, 1))}
    rows = [(a, f"{a}{i}", [float(x) for x in v]) for a, m in data.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "article_number string, sid string, hu_moments array<double>")
    got = {r.sid: r.loo_s_hu_log for r in loo.hu_spread(df, "sid").collect()}
    for a, m in data.items():
        for i in range(len(m)):
            o = np.delete(m, i, 0)
            d = np.abs(o - o.mean(0)).mean(1)
            assert got[f"{a}{i}"] == pytest.approx(math.sqrt((d ** 2).mean()), abs=1e-9)


def kept(df):
    """A written table, as statistics are kept."""
    from mensura.session import scratch_path
    path = scratch_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _measure(spark):
    arts = spark.createDataFrame([("A", "a", 100.0), ("B", "b", 103.0), ("C", "c", None)], "article_number string, name string, diameter_mm double").withColumns(
        {c: F.lit(None).cast("double") for c in ("width_mm", "depth_mm", "height_mm")})
    vec = {"lab_center": 3, "lab_rim": 3, "hs_hist_center": 4, "hs_hist_rim": 4, "hu_moments": 7}
    cols = {c: F.array(*[F.lit(0.25)] * n) for c, n in vec.items()}
    shots = spark.createDataFrame([("A", 100.0), ("A", 100.5), ("A", 99.5)], "article_number string, circle_diameter_mm double").withColumns(
        {"circularity": F.lit(0.9), "solidity": F.lit(0.98), **cols})
    m = spark.createDataFrame([(1, 100.0), (2, 106.0), (3, 106.01), (4, 500.0)], "report_id int, circle_diameter_mm double").withColumns(
        {"area_mm2": F.pow(F.col("circle_diameter_mm"), 2.0) * math.pi / 4, "circularity": F.lit(0.9), "solidity": F.lit(0.98), **cols})
    return arts, shots, m


def test_identify_boundaries(spark):
    arts, shots, m = _measure(spark)
    out = {r.report_id: r for r in scoring.identify(m, arts, kept(enroll.stats_wide(shots)), Params(), kills=True).collect()}
    assert [c.article_number for c in out[1].candidates] == ["A", "B"] and out[1].decision == "ambiguous"
    assert [c.article_number for c in out[2].candidates] and len(out[2].candidates) == 2     # 6.0 mm off is still in
    assert [c.article_number for c in out[3].candidates] == ["B"]
    assert out[3].decision == "ambiguous" and not out[3].candidates[0].has_references
    assert len(out[3].candidates[0].features) == 1
    assert out[4].decision == "reject" and out[4].candidates is None and "Niemals" in out[4].message
    assert [k.article_number for k in out[3].prefiltered] == ["A"]


def test_mahalanobis_identity_is_the_baseline(spark):
    arts, shots, m = _measure(spark)
    rows = scoring.candidate_rows(m, arts, kept(enroll.stats_wide(shots)), Params())
    eye = {a: {b: float(a == b) for b in C.ALL_FEATURES} for a in C.ALL_FEATURES}
    full = rows.where("has_references")
    a = {r.report_id: r.log_score for r in scoring.score(full, Params()).collect()}
    b = {r.report_id: r.log_score for r in scoring.score(full, Params(mode="maha"), inverse=eye).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 for k in a)


def test_kills_of_all_distances(spark):
    arts, _, m = _measure(spark)
    every = joins.all_kills(m, arts, 6.0, 12.0).select("report_id", "article_number")
    assert sorted(map(tuple, every.collect())) == [(3, "A"), (4, "A"), (4, "B")]
    listed = joins.prefilter_kills(m, arts, 6.0, 12.0).select("report_id", "article_number")
    assert sorted(map(tuple, listed.collect())) == [(3, "A")]
    named = m.withColumn("label", F.when(F.col("report_id") == 4, "B").otherwise("A"))
    own = joins.prefilter_kills(named, arts, 6.0, 12.0, label="label").select("report_id", "article_number", "over_tolerance_mm")
    assert sorted(map(tuple, own.collect())) == [(3, "A", 0.01), (4, "B", 391.0)]
    odd = named.unionByName(named.limit(1).withColumn("report_id", F.lit(9)).withColumn("circle_diameter_mm", F.lit(None).cast("double")))
    sums = {r.report_id: r for r in joins.kill_summary(odd, arts, 6.0, 12.0, label="label").collect()}
    assert {k: (r.n_kills, r.n_kills_diameter, r.n_kills_area, r.n_kills_far, [x.article_number for x in r.prefiltered]) for k, r in sums.items()} == {
        1: (0, 0, 0, 0, []), 2: (0, 0, 0, 0, []), 3: (1, 1, 0, 0, ["A"]), 4: (2, 2, 0, 2, ["B"]), 9: (None, None, None, None, [])}
    assert joins.kill_summary(named.limit(0), arts, 6.0, 12.0).count() == 0
    bare = joins.kill_summary(named, arts.limit(0), 6.0, 12.0).collect()
    assert {r.n_kills for r in bare} == {0} and len(bare) == 4


def test_own_kills_reach_the_funnel(spark):
    """The own article lies 4 and 12 mm beyond the tolerance: near and far."""
    arts, shots, m = _measure(spark)
    base = m.where("report_id = 1").drop("report_id", "circle_diameter_mm", "area_mm2")
    seen = spark.createDataFrame([(1, 100.0), (2, 110.0), (3, 118.0)], "report_id int, circle_diameter_mm double").crossJoin(base).withColumns(
        {"label": F.lit("A"), "area_mm2": F.pow(F.col("circle_diameter_mm"), 2.0) * math.pi / 4})
    out = kept(scoring.identify(kept(seen), arts, kept(enroll.stats_wide(shots)), Params(), keep=["label"], kills=True))
    assert {r.report_id: [(k.article_number, k.over_tolerance_mm) for k in r.prefiltered] for r in out.collect()} == {
        1: [], 2: [("A", 4.0), ("B", 1.0)], 3: [("A", 12.0)]}
    funnel = analysis.prefilter_funnel(out).first()
    assert (funnel.rank_1, funnel.kill_near, funnel.kill_far) == (1, 1, 1)


def test_params_reject_zero_weights():
    with pytest.raises(ValueError):
        Params(weights={f: 0.0 for f in C.ALL_FEATURES}).global_weights()


# --- pairs ------------------------------------------------------------------

def test_close_pairs_are_exactly_the_close_ones(spark):
    rnd = np.random.default_rng(2)
    rows = [(f"A{a:02d}", [float(x) for x in rnd.normal(a % 5, 1, 12)]) for a in range(25) for _ in range(1 + a % 4)]
    df = spark.createDataFrame(rows, "article_number string, p array<double>")
    prof = pairs.article_profiles(df, "p")
    full = {(r.a, r.b) for r in pairs.all_pairs(prof).where("d_sigma < 1.6").collect()}
    assert full and full == {(r.a, r.b) for r in pairs.close_pairs(prof, 1.6).collect()}


def test_clusters_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)]
    got = {r.node: r.cluster for r in pairs.clusters(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(40)} == {0}


def test_knn_matches_brute_force(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(120, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in pairs.embedding_knn(df, df, 4).collect():
        got.setdefault(r.vec_id, {})[r.rank] = r.neighbour
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    for i, s in enumerate(u @ u.T):
        assert [got[i][k] for k in (1, 2, 3, 4)] == list(np.argsort(-s, kind="stable")[:4])


# --- geometry ---------------------------------------------------------------

def _ring(spark, shapes, n=120):
    rows = []
    for s, (a, b) in shapes.items():
        for i in range(n):
            t = 2 * math.pi * i / n
            r = 1 + 0.1 * math.cos(t)
            rows.append((s, i + 1, 300 + a * r * math.cos(t), 200 + b * r * math.sin(t)))
    return spark.createDataFrame(rows, "shape_id long, pos long, x double, y double")


def test_polygon_of_a_square(spark):
    sq = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 2.0, 0.0), (1, 3, 2.0, 2.0), (1, 4, 0.0, 2.0)], "shape_id long, pos long, x double, y double")
    r = geometry.polygon_measures(sq).first()
    assert (r.area, r.perimeter, r.centroid_x, r.centroid_y) == (4.0, 8.0, 1.0, 1.0)
    assert r.circularity == pytest.approx(math.pi / 4)
    assert geometry.point_set_diameter(sq).first()["diameter"] == pytest.approx(math.sqrt(8))
    hu = geometry.hu_moments_log(sq).first()["hu"]
    assert hu[0] == pytest.approx(-math.log10(1 / 6), abs=1e-9)


def test_polar_outlier_finds_the_odd_shape(spark):
    pts = _ring(spark, {1: (50.0, 20.0), 2: (50.2, 20.0), 3: (50.1, 20.1), 4: (60.0, 30.0)})
    sig = geometry.polar_signature(pts, k=36).withColumn("grp", F.lit(1))
    m = {r.shape_id: np.array(r.r) for r in sig.collect()}
    r = geometry.polar_outlier(sig).first()
    med = np.median(np.array(list(m.values())), axis=0)
    dist = {k: math.sqrt(((v - med) ** 2).mean()) for k, v in m.items()}
    assert r.farthest == 4 == max(dist, key=dist.get)
    assert r.residual == pytest.approx(np.median(list(dist.values())))


def test_profile_turns_the_wide_end_to_the_front(spark):
    pts = _ring(spark, {1: (50.3, 20.0)})
    p = geometry.oriented(geometry.width_bins(pts)).first()
    assert int(np.argmax(p.w)) + 0.5 <= p.length / 2 + 1        # one bin of slack
    assert len(geometry.normalised_profile(geometry.width_bins(pts)).first()["profile"]) == 101


# --- sources ----------------------------------------------------------------

def test_csv_import(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes("﻿article_number,name,diameter_mm\nX-1,Teller,\"240,5\"\nX-2,Tasse,\nX-1,Neu,12\n".encode("utf-8"))
    src = master.csv_master_import(spark, str(f))
    got = {r.article_number: r for r in master.last_per_key(src).collect()}
    assert got["X-1"].name == "Neu" and got["X-1"].diameter_mm == 12.0
    assert got["X-2"].diameter_mm is None and got["X-2"].height_mm is None
    (tmp_path / "b.csv").write_text("name\nx\n")
    with pytest.raises(ValueError, match="article_number"):
        master.csv_master_import(spark, str(tmp_path / "b.csv"))


def test_master_errors(spark):
    t = spark.createDataFrame([("A", 1.0)], "article_number string, diameter_mm double")
    with pytest.raises(Exception, match="already exists"):
        master.insert_new(t, t).collect()
    with pytest.raises(ValueError, match="cannot be updated"):
        master.update_columns(t, t.withColumnRenamed("diameter_mm", "name"))


def test_load_reports_skips_broken_and_foreign_files(spark, tmp_path):
    (tmp_path / "20260101-000000-001.json").write_text('{"decision":"accept","candidates":[],"measured":{"circle_diameter_mm":5.0},"report_path":"old"}')
    (tmp_path / "20260101-000000-002.json").write_text('{"decision":"reject",\n "label": "A"}')
    (tmp_path / "broken.json").write_text('{"decision": ')
    (tmp_path / "foreign.json").write_text('{"other": 1}')
    got = SR.load_reports(spark, str(tmp_path), sort_by="name", limit=1).collect()
    assert [r.stem for r in got] == ["20260101-000000-002"]
    both = {r.stem: r for r in SR.load_reports(spark, str(tmp_path)).collect()}
    old = both["20260101-000000-001"]
    assert old.measured.solidity == 0.0 and old.measured.lab_rim == [] and old.prefiltered == []
    assert old.report_path != "old"
    with pytest.raises(ValueError):
        SR.load_reports(spark, str(tmp_path), sort_by="size")


def test_no_match_never_takes_top1(spark):
    r = spark.createDataFrame([(1, [("A",)], None, None)], "report_id int, candidates array<struct<article_number:string>>, label string, verdict string")
    fb = spark.createDataFrame([(1, "no_match", None, 2), (1, "correct", None, 1)], "report_id int, kind string, true_article string, at int")
    out = SR.apply_verdict(r, fb).first()
    assert (out.label, out.verdict) == ("NO_MATCH", "correct")


def test_broken_journal_lines(spark):
    schema = "session int, line_no int, entry struct<slot:int,d:double>"
    ok = spark.createDataFrame([(1, 0, (0, 1.0)), (1, 1, (0, 2.0)), (1, 2, None)], schema)
    assert runs.latest_per_slot(ok).first()["entry"]["d"] == 2.0
    bad = spark.createDataFrame([(1, 0, None), (1, 1, (0, 2.0))], schema)
    with pytest.raises(Exception, match="unreadable journal line"):
        runs.latest_per_slot(bad).collect()


def test_incomplete_runs_and_empty_overlap_are_errors(spark):
    r = spark.createDataFrame([("r1", "a")], "run_id string, sha8 string")
    fails = r.withColumn("band", F.lit("fail")).limit(0)
    with pytest.raises(Exception, match="incomplete"):
        runs.run_side(r, fails, r.limit(0), "r1").collect()
    with pytest.raises(Exception, match="no image in common"):
        regression.common_images(r, r.withColumn("sha8", F.lit("b"))).collect()
    with pytest.raises(ValueError):
        runs.baseline_row(r, "r1", 1, 1)


def test_fingerprint_ignores_order_and_split(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("b"))
    a = gates.table_fingerprint(df, ["id", "b"]).first()
    b = gates.table_fingerprint(df.repartition(5).orderBy(F.desc("id")), ["id", "b"]).first()
    c = gates.table_fingerprint(df.where("id <> 5"), ["id", "b"]).first()
    assert a == b and a.fingerprint != c.fingerprint


# --- streaming --------------------------------------------------------------

def stream_files(spark, folder, rows, schema):
    """One file a row list, in the order given."""
    import glob
    import os
    import shutil
    folder.mkdir(parents=True)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"w{i}"))
        target = folder / f"{i}.parquet"
        shutil.copy(glob.glob(str(folder / f"w{i}" / "*.parquet"))[0], target)
        os.utime(target, (1000 + i, 1000 + i))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "[0-9]*.parquet").parquet(str(folder))


def at(text):
    from datetime import datetime
    return datetime.fromisoformat(text)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = [[(at("2026-01-01 10:00:00"), "accept")], [(at("2026-01-05 10:00:00"), "accept")], [(at("2026-01-06 10:00:00"), "accept")],
            [(at("2026-01-01 11:00:00"), "reject")], [(at("2026-01-09 10:00:00"), "accept")]]
    stream = stream_files(spark, tmp_path / "in", rows, "at timestamp, decision string")
    out, state = streams.run_counted(streams.decision_rates(stream, "at", "decision", "1 day", watermark="1 hour"), "late")
    got = sorted((str(r.start)[:10], r.decision, r.n) for r in out.collect())
    assert got == [("2026-01-01", "accept", 1), ("2026-01-05", "accept", 1), ("2026-01-06", "accept", 1)]
    assert state["late"] == 1 and state["state_rows"] == 1 and state["most_state_rows"] <= 3


def test_session_state_is_dropped(spark, tmp_path):
    rows = [[(i % 7, at(f"2026-01-{day:02d} 10:0{j}:00")) for i in range(7) for j in range(3)] for day in range(1, 15)]
    stream = stream_files(spark, tmp_path / "in", rows, "article long, at timestamp")
    out, state = streams.run_counted(streams.enroll_sessions(stream, "article", "at", target=3), "sessions")
    assert out.count() == 13 * 7 and out.where("complete and n_shots = 3").count() == 13 * 7
    assert state["most_state_rows"] <= 21


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    vec = lambda n: [rng.random() for _ in range(n)]
    rows = [(f"A{i % 3}", 50 + rng.random(), 0.9, 0.95, vec(3), vec(3), vec(5), vec(5), vec(7)) for i in range(60)]
    shots = spark.createDataFrame(rows, "article_number string, circle_diameter_mm double, circularity double, solidity double, lab_center array<double>, "
                                        "lab_rim array<double>, hs_hist_center array<double>, hs_hist_rim array<double>, hu_moments array<double>")
    path = str(tmp_path / "ledger")
    parts = shots.randomSplit([0.3, 0.3, 0.4], seed=1)
    for i in (0, 1, 2, 1):                          # the second batch comes again
        streams.enroll_batch(parts[i], i, path)
    got = {(r.article_number, r.feature): r for r in streams.enrolled(spark, path).collect()}
    want = {(r.article_number, r.feature): r for r in enroll.stats_long(shots).collect()}
    assert got.keys() == want.keys() and len(got) == 24
    for key, w in want.items():
        g = got[key]
        assert g.n == w.n == 20 and (g.mean is None) == (w.mean is None)
        assert np.allclose([g.mean or 0, g.std, *(g.proto or [])], [w.mean or 0, w.std, *(w.proto or [])], atol=1e-9), key
    m = spark.createDataFrame([(1, 50.0)], "report_id int, x double")
    for _ in range(2):
        streams.ledger(m, 0, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 1


# --- radix selection, hulls, pairs -------------------------------------------

def test_codes_keep_the_order_of_doubles(spark):
    rng = random.Random(6)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 2.0, 4.0, 0.5, 3.0]
    values += [math.nextafter(2.0 ** e, up) for e in range(-1030, 1024, 7) for up in (0.0, math.inf)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(4000)]
    got = {r.x: r.c for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", O.order_code(F.col("x")).alias("c")).collect()}
    for v, c in got.items():
        bits = int(np.array(v).view(np.int64))
        assert c == (0 if v == 0 else bits if bits >= 0 else -(bits & (1 << 63) - 1)), v
    nan = spark.range(1).select(O.order_code(F.lit(float("nan"))).alias("c")).first().c
    assert nan > max(got.values())


@pytest.mark.parametrize("n, spread", [(1_000_000, 1.0), (200_000, 0.0)])
def test_selection_in_one_large_group(spark, n, spread):
    """Distinct values, or two values, in one group; count tables never pass 65,536 rows a group and prefix."""
    value = (F.xxhash64("id") / 1e12 if spread else (F.col("id") % 2).cast("double"))
    df = spark.range(n).select(F.lit("g").alias("g"), value.alias("x"))
    want = np.sort(np.array(df.select("x").toArrow().column(0).to_numpy()))
    got = O.quantiles(df, ["g"], "x", {"a": O.MEDIAN, "b": O.linear(0.9), "c": O.lower(0.25), "d": O.UPPER_MEDIAN}, count="n").first()
    assert got.n == n and got.a == np.quantile(want, 0.5) and math.isclose(got.b, np.quantile(want, 0.9), rel_tol=1e-14)
    assert got.c == want[int(0.25 * (n - 1))] and got.d == want[n // 2]
    ranks_ = O.value_counts(df.where("id % 50 = 0") if "id" in df.columns else df.limit(20_000), ["g"], "x")
    rows = sorted((r._value, r._below, r._cnt, r._n) for r in ranks_.collect())
    below = 0
    for v, b, c, total in rows:
        assert b == below
        below += c
    assert below == rows[0][3]


def test_nth_largest_with_ties_nulls_and_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, 2.0, -3.5, 7.25])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double")
    nth = spark.createDataFrame([("a", 3), ("b", 0), ("c", 9999)], "g string, k int")
    got = {r.g: r.t for r in O.nth_largest(df, ["g"], "x", nth, "k", "t").collect()}
    assert got == {"a": sorted((x for g, x in rows if g == "a" and x is not None), reverse=True)[2], "b": None, "c": None}


def test_hull_and_diameter(spark):
    rng = random.Random(5)
    shapes = {i: [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(1, 40))] for i in range(40)}
    shapes[40], shapes[41], shapes[42] = [(1.0, 1.0)] * 5, [(float(i), 2.0 * i) for i in range(9)], [(0.0, 0.0), (3.0, 4.0)]
    shapes[43] = [(float(x), float(y)) for x in range(6) for y in range(6)]
    df = spark.createDataFrame([(s, i, *p) for s, ps in shapes.items() for i, p in enumerate(ps)], "shape_id int, pos int, x double, y double").repartition(5)
    got = {r.shape_id: r.diameter for r in geometry.point_set_diameter(df).collect()}
    for s, ps in shapes.items():
        assert math.isclose(got[s], max(math.dist(p, q) for p in ps for q in ps), rel_tol=1e-12, abs_tol=1e-12), s
    corners = {(r.x, r.y) for r in geometry.convex_hull(df.where("shape_id = 43")).collect()}
    assert corners == {(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (5.0, 5.0)}
    assert geometry.point_set_diameter(df.limit(0)).count() == 0


def test_diameter_of_a_circle_is_linear(spark):
    angle = 2 * math.pi * F.col("id") / 5000
    circle = spark.range(5000).select(F.lit(1).alias("shape_id"), F.col("id").alias("pos"), (F.cos(angle) * 30).alias("x"), (F.sin(angle) * 30).alias("y"))
    assert math.isclose(geometry.point_set_diameter(circle).first().diameter, 60.0, rel_tol=1e-9)


def test_profiles_of_equal_mean_do_not_all_meet(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        shape = [rng.gauss(0, 1) for _ in range(4)]
        shape = [x - sum(shape) / 4 for x in shape]
        rows.append((f"A{i:03d}", 5, [shape[j // 8] + 0.001 * rng.random() for j in range(32)], 0.01, False))
    rows[7] = ("A007", 5, [x + 0.001 for x in rows[6][2]], 0.01, False)
    prof = spark.createDataFrame(rows, "article_number string, n_profiles int, proto array<double>, sigma double, estimated boolean")
    full = {(r.a, r.b) for r in pairs.all_pairs(prof).where("d_sigma < 1.6").collect()}
    assert full == {("A006", "A007")} == {(r.a, r.b) for r in pairs.close_pairs(prof, 1.6).collect()}
    assert pairs.close_pairs(prof.limit(0), 1.6).count() == 0


def test_an_empty_selection_is_an_error(spark):
    images = spark.createDataFrame([("S1", "a", 2)], "session string, sha8 string, tier int")
    assert regression.deterministic_subset(images, tier=2, n=5).count() == 1
    with pytest.raises(Exception, match="hits no image"):
        regression.deterministic_subset(images, sessions=images.select("session").where("session = 'x'")).collect()


def test_delta_files_of_a_folder(spark, tmp_path):
    one = '{"version":1,"fix_commit":"%s","images":{"%s":{"label":"A","expected":{"decision":"%s"}}}}'
    (tmp_path / "a.json").write_text(one % ("f1", "s1", "accept"))
    (tmp_path / "b.json").write_text(one % ("f2", "s1", "reject"))
    (tmp_path / "c.txt").write_text("no delta")
    got = runs.load_accepted_deltas(spark, str(tmp_path)).collect()
    assert [(r.sha8, r.source, r.fix_commit, r.expected.decision) for r in got] == [("s1", "b.json", "f2", "reject")]


def test_order_code_in_steps(spark):
    """Step by step as in one expression; no step's logarithm or power is repeated in the plan."""
    values = [0.0, -0.0, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 1.0, -3.7]
    values += [math.nextafter(2.0 ** e, up) for e in range(-1030, 1024, 31) for up in (0.0, math.inf)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = O.with_order_code(df, "x", "c").withColumn("one", O.order_code(F.col("x")))
    assert got.where("c <> one or c is null").count() == 0
    plan = O._coded(df, [], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG2") == 1 and plan.upper().count("POWER(") <= 3


def test_infinite_margins_have_codes(spark):
    """Infinities and NaN beside numbers, also where the code is a column on its own (a null margin counts as infinite)."""
    df = kept(spark.createDataFrame([(x,) for x in (float("-inf"), -1.0, 0.0, None, 2.5, float("inf"), float("nan"))], "x double"))
    codes = [r.c for r in O.with_order_code(df.where("x is not null"), "x", "c").orderBy("x").collect()]
    assert codes == sorted(codes) and len(set(codes)) == 6
    rows = [("mean", 1, 3.0), ("mean", 2, None), ("mean", 3, 1.0), ("max", 1, 2.5), ("max", 2, 0.5), ("max", 3, None)]
    got = whatif.equivalent_threshold(spark.createDataFrame(rows, "variant string, report_id long, llr_margin double"), "mean", 2.0)
    assert {tuple(r) for r in got.collect()} == {("mean", 2, 3.0, 2), ("max", 2, 3.0, 1)}
    one = whatif.equivalent_threshold(spark.createDataFrame(rows[1:2], "variant string, report_id long, llr_margin double"), "mean", 2.0)
    assert [tuple(r) for r in one.collect()] == [("mean", 1, float("inf"), 1)]


def test_given_tables_are_dealt_by_rows(spark, sf, monkeypatch):
    """Parts grow with the rows, not with files or cores; shots lie by article while they are narrow."""
    from mensura.catalog import views as V
    monkeypatch.setattr(V, "_SPREAD", {})
    monkeypatch.setattr(V, "_TASK_ROWS", {"orders": 50, "supplier": 1, "lineitem": 400})
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem")}
    assert V.parts(spark, sf, "orders") == -(-rows["orders"] // 50) > spark.sparkContext.defaultParallelism
    shots = V.view(spark, sf, "fx_shots")
    assert shots.count() == rows["lineitem"]
    plan = shots.groupBy("article_number").agg(F.max("hu_moments"), F.max("circle_diameter_mm"))._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("hashpartitioning(article_number") <= 2 and f", {-(-rows['lineitem'] // 400)})" in plan      # of shots, and of articles unless broadcast


def test_light_reports_are_the_reports(spark, sf):
    from mensura.catalog import views as V
    heads, whole = V.view(spark, sf, "fx_heads"), V.view(spark, sf, "fx_reports")
    names = [c for c in whole.columns if c != "candidates"]
    assert heads.columns == whole.columns and "features" not in heads.schema["candidates"].dataType.elementType.names
    less = whole.withColumn("candidates", F.transform("candidates", lambda c: c.dropFields("features")))
    for a, b in ((heads, less), (less, heads)):
        assert a.select(*names, "candidates").exceptAll(b.select(*names, "candidates")).count() == 0


def test_reports_with_few_fields_of_features_are_the_reports(spark, sf):
    from mensura.catalog import views as V
    refs, whole, docs = (V.view(spark, sf, n) for n in ("fx_refs", "fx_reports", "fx_docs"))
    less = whole.withColumn("candidates", F.transform("candidates", lambda c: c.withField("features", F.transform(
        c["features"], lambda f: F.struct(f["feature"].alias("feature"), f["reference"].alias("reference"))))))
    for a, b in ((refs, less), (less, refs), (docs, whole), (whole, docs)):
        assert a.columns == b.columns and a.exceptAll(b.select(*a.columns)).count() == 0


def test_reports_are_rounded_as_round_does_and_without_decimals(spark, sf):
    from mensura.catalog import views as V
    for n, m in ((4, 0.00001234567), (2, 0.0)):
        x = spark.range(-3000, 3000).select(((F.col("id") * 7919 % 4200) / 1000.0 * 0.7391 + m).alias("x"))
        fast = x.select(F.expr(V.SparkDialect.rnd("x", n)).alias("a"), F.round("x", n).alias("b"))
        assert fast.where("a <> b or cast(a as string) <> cast(b as string)").count() == 0
    assert "round(" not in V.VIEWS["fx_reports"](V.SparkDialect)


def test_corpus_and_old_reports_store_no_features(spark, sf):
    from mensura.catalog import views as V
    from mensura.catalog import load
    V._SPREAD.pop((spark.sparkContext.applicationId, sf, "fx_reports"), None)
    for name in ("S23_build_corpus", "S09_schema_evolution_defaults", "S13_csv_sink", "S14_publish_run", "S15_archive_reports"):
        load()[0][name](spark, sf)
    assert (spark.sparkContext.applicationId, sf, "fx_reports") not in V._SPREAD


def test_trend_without_spread_is_null(spark):
    rows = [("a", i, 60.0 + i * i, 5.0, 1.0, 1.0) for i in range(4)] + [("b", i, 60.0, 5.0 + i, 1.0 * i, 2.0 * i) for i in range(4)]
    t = {r.k: r for r in stats.linear_trend(spark.createDataFrame(rows, "k string, shot long, length double, width double, x double, y double"), "k", 9).collect()}
    assert t["a"].r_y is None and t["a"].r_x is None and t["a"].r_radius is None and t["a"].slope_length is None and t["a"].r_time > 0.9
    assert t["b"].r_y is None and t["b"].r_time is None and t["b"].slope_length == 0


def test_report_folder_is_packed(spark, sf):
    import glob
    from mensura.catalog import stores, views as V
    path = stores._json_folder(lambda text: V.view(spark, sf, text), spark)
    files = glob.glob(f"{path}/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    assert SR.load_reports(spark, path, layout="lines").count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_nearest_vectors_in_bounded_steps(spark, monkeypatch):
    """Few copies and products at a time, several cells a block, equal vectors by id: as brute force has it."""
    for name, value in (("_BLOCK", 40), ("_COPIES", 50), ("_ROWS", 7)):
        monkeypatch.setattr(pairs, name, value)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(90, 6)), 3, axis=0)
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.rank): r.neighbour for r in pairs.embedding_knn(df, df, 4).collect()}
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    near = np.round(u @ u.T, 12)
    for q in range(len(x)):
        want = np.lexsort((np.arange(len(x)), -near[q]))[:4]
        assert [got[q, k + 1] for k in range(4)] == want.tolist()


def test_scoring_needs_no_exchange_after_the_band_join(spark, sf):
    from mensura.catalog import views as V
    articles, shots = V.view(spark, sf, "fx_articles"), V.view(spark, sf, "fx_shots")
    measured = V.view(spark, sf, "fx_measured")
    known = enroll.stats_wide(shots)
    plain = scoring.summarise(scoring.score(scoring.candidate_rows(measured, articles, known, Params()), Params()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = scoring.candidate_rows(measured, articles, known, Params(), bins=True)
        found = scoring.summarise(scoring.score(rows, Params()), [scoring.BIN, scoring.RID, "variant"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(_bin") == 2 and "hashpartitioning(report_id" not in plan
        assert found.drop(scoring.BIN).exceptAll(plain).count() == 0 and found.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _odd_measured(spark, sf):
    """Measurements, some without a diameter, without an area or far from all articles; none of them twice."""
    from mensura.catalog import views as V
    articles, m = V.view(spark, sf, "fx_articles"), V.view(spark, sf, "fx_measured").drop("ts_day")
    part, r = m.where("report_id % 7 = 0"), F.col("report_id")
    none = F.lit(None).cast("double")
    once = part.withColumn("circle_diameter_mm", F.when(r % 35 == 0, none).when(r % 35 == 7, F.lit(9000.0)).otherwise(F.col("circle_diameter_mm")))
    once = kept(once.withColumn("area_mm2", F.when(r % 35 == 14, none).otherwise(F.col("area_mm2"))))
    stats = kept(enroll.stats_wide(V.view(spark, sf, "fx_shots").where("article_number > 'ART-000000050'")))
    return once, articles, stats


def _lines(df):
    return sorted(str(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("nested", [False, True])
def test_reports_stay_in_their_bins(spark, sf, nested):
    """Reports that come once are made without any exchange by report, and are those made by joins on the key."""
    once, articles, stats = _odd_measured(spark, sf)
    want = scoring._identify_by_key(once, articles, stats, Params(), nested, False, ["label"], None)
    got = scoring.identify(once, articles, stats, Params(), nested=nested, keep=["label"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(report_id" not in plan and got.columns == want.columns
    assert _lines(got) == _lines(want)
    assert {r.decision for r in got.select("decision").distinct().collect()} == {"accept", "ambiguous", "reject"}


def test_repeated_keys_keep_their_meaning(spark, sf):
    """Keys that come twice (equal rows, other rows) or are null mean what the joins on the key make of them."""
    once, articles, stats = _odd_measured(spark, sf)
    twice = once.where("report_id % 77 = 0")
    moved = once.where("report_id % 119 = 0").withColumn("circle_diameter_mm", F.col("circle_diameter_mm") + 250.0)
    null = once.where("report_id % 91 = 0").limit(2).withColumn("report_id", F.lit(None).cast("long"))
    odd = kept(once.unionByName(twice).unionByName(moved).unionByName(null))
    assert 0 < len(scoring.repeated_parts(odd)) < 4096 and not scoring.repeated_parts(once)
    want = scoring._identify_by_key(odd, articles, stats, Params(), False, False, ["label"], None)
    assert _lines(scoring.identify(odd, articles, stats, Params(), nested=False, keep=["label"])) == _lines(want)


@pytest.mark.parametrize("keep", [["label"], ["area_mm2"]])
def test_kills_stay_in_their_bins(spark, sf, keep):
    """Nested reports and their kills are not exchanged; lists and counts are those of the joins on the key."""
    once, articles, stats = _odd_measured(spark, sf)
    once = kept(once.withColumn("label", F.when(F.col("report_id") % 3 == 0, "ART-000000007").when(F.col("report_id") % 3 == 1, F.col("label"))))
    want = scoring._identify_by_key(once, articles, stats, Params(), True, True, keep, None)
    got = scoring.identify(once, articles, stats, Params(), keep=keep, kills=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(report_id" not in plan and got.columns == want.columns
    assert _lines(got) == _lines(want)
    assert got.where("exists(prefiltered, k -> k.over_tolerance_mm > 6)").count() == (0 if keep == ["area_mm2"] else want.where("exists(prefiltered, k -> k.over_tolerance_mm > 6)").count())


def test_shifted_measurements_are_not_joined(spark, sf):
    """Keys that come once take their own shifted diameter without a join; repeated ones have those of all their rows."""
    from mensura.catalog import identify as I
    once, _, _ = _odd_measured(spark, sf)
    plan = I.off_whole(once)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    odd = kept(once.unionByName(once.where("report_id % 77 = 0").withColumn("circle_diameter_mm", F.lit(70.0))))
    want = odd.drop("circle_diameter_mm").join(I.off(odd).select("report_id", "circle_diameter_mm"), "report_id")
    assert _lines(I.off_whole(odd)) == _lines(want)


def test_rounding_is_that_of_spark(spark):
    """Halves, near halves, large numbers, negative zero: the same double as round, digit by digit."""
    rng = random.Random(3)
    xs = [0.0, -0.0, -0.00001, 0.00005, 1.00005, 2.5, 1e15 + 0.5, -1e300, 5e-324, float("inf"), float("nan"), None, 123456.78905, 0.285, 1.005]
    xs += [k / 20000 for k in range(-3000, 3000, 7)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 12) for _ in range(4000)]
    xs += [math.nextafter(k / 20000, math.inf) for k in range(1, 2001, 2)] + [math.nextafter(k / 20000, 0) for k in range(1, 2001, 2)]
    df = kept(spark.createDataFrame([(x,) for x in xs], "x double"))
    for n in (2, 4):
        both = df.select("x", sizes.rounded(F.col("x"), n).alias("a"), F.round("x", n).alias("b")).collect()
        assert [r for r in both if str(r.a) != str(r.b)] == []


def test_catalogue_does_not_pass_the_driver(spark, sf):
    """Bands and own articles grow with the catalogue; the only broadcast is the single row of its size."""
    from mensura.catalog import views as V
    measured, articles = V.view(spark, sf, "fx_measured"), V.view(spark, sf, "fx_articles")
    plan = joins.kill_summary(measured, articles, 6.0, 12.0, label="label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "BroadcastHashJoin" not in plan


def test_separation_does_not_hang_on_the_order_of_sums(spark):
    """5.78125 with and without the noise of a mean is the same number, so a rounding to 4 digits is too."""
    cols = [f"m_{f}" for f in C.SCALAR_FEATURES] + [f"s_{f}" for f in C.ALL_FEATURES]
    floor = C.SIGMA_FLOORS[C.FLOOR_KEYS["solidity"]]
    rows = [("a", 0.0), ("b", 5.78125 * floor), ("c", math.nextafter(5.78125 * floor, 0) - 2e-17)]
    table = spark.createDataFrame(rows, "article_number string, x double")
    table = table.select("article_number", *[F.col("x").alias(c) if c == "m_solidity" else F.lit(0.0).alias(c) for c in cols],
                         *[F.lit(None).cast("array<double>").alias(f"p_{f}") for f in C.PROTO_FEATURES])
    pairs_ = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {r.b: r.s for r in analysis.discriminability(pairs_, table).select("b", F.round("solidity", 4).alias("s")).collect()}
    assert got == {"b": 5.7813, "c": 5.7813}
