"""Source, sink, journal and streaming queries (S, W16, W17, J21, T06, Q09, Q10, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import analysis as A, enroll, regression as X
from ..params import Params
from ..session import scratch_path
from ..sources import master, reports as SR, runs
from ..streaming import streams as ST
from .base import query
from .identify import V01_BODY, DECIDE, shot_stats, stats_ctes
from .regression import TIER2, quota_union, _T3, _SNAP
from .views import art, table

P = Params()
_MASTER = "(select article_number, name, category, diameter_mm, width_mm, depth_mm, height_mm, color_desc, notes from fx_articles)"
_NEW = f"""(select {art('p_partkey + 700')} as article_number, concat('neu ', p_name) as name, cast(null as string) as category, case when p_partkey % 4 = 0 then null else p_partkey * 1e0 end as diameter_mm,
  p_size * 1e0 as width_mm, cast(null as double) as depth_mm, cast(null as double) as height_mm, p_brand as color_desc, cast(null as string) as notes, p_partkey as line from part)"""
_COLS = ["article_number", "name", "category", "diameter_mm", "width_mm", "depth_mm", "height_mm", "color_desc", "notes"]


@query("S01_csv_master_import", f"select article_number, nullif(name, '') as name, category, diameter_mm, width_mm, depth_mm, height_mm, color_desc, notes from {_MASTER} t")
def s01(v, spark, sf):
    """The master table goes out as CSV with decimal commas and comes back typed."""
    path = scratch_path(spark, "master-csv")
    out = v(f"select * from {_MASTER} t")
    text = {c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")) for c in ("diameter_mm", "width_mm", "depth_mm", "height_mm")}
    out.withColumns(text).write.option("header", True).csv(path)
    return master.csv_master_import(spark, path).drop("_line")


@query("S02_upsert", f"""select * from (select * from {_MASTER} t where article_number not in (select article_number from {_NEW} n)) union all select {', '.join(_COLS)} from {_NEW} n""")
def s02(v, spark, sf):
    src = v(f"select * from {_NEW} t").withColumnRenamed("line", "_line")
    older = src.withColumns({"_line": F.col("_line") - 1000000, "name": F.lit("veraltet")})
    return master.upsert(v(f"select * from {_MASTER} t"), src.unionByName(older))


@query("S03_insert_new", f"select * from {_MASTER} t union all select {', '.join(_COLS)} from {_NEW} n where article_number not in (select article_number from {_MASTER} m)")
def s03(v, spark, sf):
    t = v(f"select * from {_MASTER} t")
    return master.insert_new(t, v(f"select * from {_NEW} t").drop("line").join(t, "article_number", "left_anti"))


@query("S04_update_columns", f"""select t.article_number, coalesce(n.diameter_mm, t.diameter_mm) as diameter_mm, coalesce(n.width_mm, t.width_mm) as width_mm, t.height_mm, n.article_number is not null as hit
from {_MASTER} t left join {_NEW} n using (article_number)""")
def s04(v, spark, sf):
    out = master.update_columns(v(f"select * from {_MASTER} t"), v(f"select article_number, diameter_mm, width_mm from {_NEW} t"))
    return out.select("article_number", "diameter_mm", "width_mm", "height_mm", F.col("_hit").alias("hit"))


_GONE = f"(select article_number from {_NEW} n where line % 2 = 0)"


@query("S05_cascade_delete", f"""select 'articles' as tbl, count(*) as n from {_MASTER} t where article_number not in (select * from {_GONE} g) union all select 'references', count(*) from fx_shots where article_number not in (select * from {_GONE} g)
union all select 'stats', count(*) from (select distinct article_number from fx_shots) where article_number not in (select * from {_GONE} g) union all select 'existed', count(*) from {_GONE} g where article_number in (select article_number from fx_articles)""")
def s05(v, spark, sf):
    a, r, s, found = master.cascade_delete(v(f"select article_number from {_NEW} n where line % 2 = 0"), v(f"select * from {_MASTER} t"),
                                           v("fx_shots"), v("fx_shots").select("article_number").distinct())
    n = F.count(F.lit(1)).alias("n")
    out = a.agg(n).select(F.lit("articles").alias("tbl"), "n")
    for name, df in (("references", r), ("stats", s), ("existed", found.where("existed"))):
        out = out.unionByName(df.agg(n).select(F.lit(name).alias("tbl"), "n"))
    return out


@query("S06_drop_references", f"select g.article_number, count(s.article_number) as removed from {_GONE} g left join fx_shots s using (article_number) group by 1")
def s06(v, spark, sf):
    return master.drop_references(v(f"select article_number from {_NEW} n where line % 2 = 0"), v("fx_shots"), v("fx_shots").select("article_number").distinct())[2]


@query("S07_append_references", f"with {stats_ctes('fx_emb')} select article_number, feature, n, round(mean, 7) as mean, round(std, 5) as std from st")
def s07(v, spark, sf):
    """Half of the shots are stored, the other half of some articles is appended."""
    e = v("fx_emb")
    late = (F.col("shot_id") % 2 == 0) & (F.col("article_id") % 3 != 0)
    old = e.where(~late)
    _, stats = master.append_references(old, enroll.stats_long(old), e.where(late), v("fx_articles"))
    return stats.select("article_number", "feature", "n", F.round("mean", 7).alias("mean"), F.round("std", 5).alias("std"))


def _json_folder(v, spark):
    """Reports as JSON lines files, plus a foreign and a broken document in lines of their own."""
    path = scratch_path(spark, "reports-json")
    fields = ("decision", "candidates", "llr_margin", "max_z_winner", "gate_passed", "timestamp", "label", "verdict", "prefiltered", "image_path")
    reports = v("fx_reports").select(F.to_json(F.struct(*fields)).alias("value"))
    bad = spark.range(1).select(F.explode(F.array(F.lit('{"foreign": 1}'), F.lit('{"decision": '))).alias("value"))
    # A report is some kilobytes of text, mostly names: packed it is a tenth of that. A packed file is read by one
    # task, so no file gets many reports.
    reports.unionByName(bad).write.option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)
    return path


@query("S08_load_reports", "select decision, count(*) as n, count(label) as n_labels from fx_rep group by 1")
def s08(v, spark, sf):
    """Report folder in lines, with broken and foreign documents among them."""
    out = SR.load_reports(spark, _json_folder(v, spark), layout="lines")
    return out.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labels"))


@query("S08_newest_reports", "select stem, decision, label from (select stem, decision, label, row_number() over (order by stem desc) as n from fx_rep) where n <= 200")
def s08_newest(v, spark, sf):
    """The newest reports by name, limited after sorting."""
    return SR.load_reports(spark, _json_folder(v, spark), sort_by="name", limit=200, layout="lines").select("stem", "decision", "label")


@query("S09_schema_evolution_defaults", "select report_id, 0e0 as solidity, 0::bigint as n_zone, 0::bigint as n_kills from fx_rep")
def s09(v, spark, sf):
    """Reports of an older schema: no solidity, no zones, no kills."""
    old = v("fx_docs").select("report_id", F.to_json(F.struct("decision", "candidates", F.struct("measured.circle_diameter_mm").alias("measured"))).alias("j"))
    r = SR._defaults(old.select("report_id", F.from_json("j", schemas.REPORT).alias("r")).select("report_id", "r.*"))
    return r.select("report_id", "measured.solidity", F.size("measured.lab_rim").cast("long").alias("n_zone"), F.size("prefiltered").cast("long").alias("n_kills"))


@query("S10_write_reports", "select substr(stem, 1, 6) as date, count(*) as n from fx_rep group by 1")
def s10(v, spark, sf):
    path = scratch_path(spark, "reports")
    days = v("fx_heads").select("report_id", "stem", "decision")
    SR.write_reports(days, path, unit="month")
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


_FB = "(select k as report_id, case when k % 3 = 0 then 'correct' when k % 3 = 1 then 'wrong' else 'no_match' end as kind, case when k % 2 = 0 then concat('T-', cast(k as string)) end as true_article, 2 as at from fx_rep where k % 4 = 0 union all select k, 'wrong', 'alt', 1 from fx_rep where k % 8 = 0)"
_FBS = """(select r.report_id, case when f.kind is null then r.verdict when f.kind = 'wrong' then 'wrong' else 'correct' end as verdict,
  case when f.kind = 'correct' then r.pred when f.kind = 'no_match' then 'NO_MATCH' when f.kind = 'wrong' and coalesce(f.true_article, '') <> '' then f.true_article else r.label end as label, f.kind
  from fx_rep r left join (select k as report_id, case when k % 3 = 0 then 'correct' when k % 3 = 1 then 'wrong' else 'no_match' end as kind, case when k % 2 = 0 then concat('T-', cast(k as string)) end as true_article from fx_rep where k % 4 = 0) f using (report_id))"""


@query("S11_apply_verdict", f"select report_id, verdict, label from {_FBS} t")
def s11(v, spark, sf):
    return SR.apply_verdict(v("fx_heads"), v(f"select * from {_FB} t")).select("report_id", "verdict", "label")


@query("S12_apply_no_match_verdict", f"select report_id, verdict, label from {_FBS} t where kind = 'no_match'")
def s12(v, spark, sf):
    fb = v(f"select * from {_FB} t").where("kind = 'no_match'")
    out = SR.apply_verdict(v("fx_heads"), fb)
    return out.join(fb.select("report_id"), "report_id", "left_semi").select("report_id", "verdict", "label")


@query("S13_csv_sink", "select label, pred, count(*) as n from fx_judged where coalesce(label, '') <> '' group by 1, 2")
def s13(v, spark, sf):
    path = scratch_path(spark, "confusion-csv")
    SR.csv_sink(A.confusion(v("fx_heads")), path, ["label", "pred", "n"])
    return spark.read.schema("label string, pred string, n long").option("header", True).csv(path)


@query("S14_publish_run", "select label, count(*) as n from fx_rep where coalesce(label, '') <> '' group by 1")
def s14(v, spark, sf):
    root = scratch_path(spark, "archive")
    frame = v("fx_heads").where("coalesce(label, '') <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    SR.publish_run({"per_label": frame}, root, "r1")
    return spark.read.parquet(f"{root}/run_id=r1/per_label")


@query("S15_archive_reports", "select report_id from fx_rep where session >= 'S10'")
def s15(v, spark, sf):
    root, r = scratch_path(spark, "archived"), v("fx_heads").select("report_id", "session", "decision")
    SR.archive_reports(r.where("session < 'S10'"), root, "r1")
    return SR.current_reports(r, spark.read.parquet(root)).select("report_id")


@query("S16_content_hash_manifest", """select folder, sha256(string_agg(line, chr(10) order by doc_id) || chr(10)) as sha, cast(sum(strlen(line) + 1) as bigint) as length
from (select doc_id, doc_id // 500 as folder, doc_id || ' ' || sha256(text) as line from documents where text is not null) group by 1""")
def s16(v, spark, sf):
    """Files written from the documents table, one for 500 documents, hashed by content."""
    path = scratch_path(spark, "files")
    docs = table(spark, sf, "documents").where("text is not null")
    lines = docs.select("doc_id", F.floor(F.col("doc_id") / 500).alias("folder"), F.concat_ws(" ", "doc_id", F.sha2("text", 256)).alias("value"))
    lines.repartition("folder").sortWithinPartitions("folder", "doc_id").drop("doc_id").write.partitionBy("folder").text(path)
    out = runs.content_hash_manifest(spark, path, "*.txt")
    return out.select(F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long").alias("folder"), "sha", "length")


@query("S17_load_accepted_deltas", """select sha8, case when image_id % 6 = 0 then 'b.json' else 'a.json' end as source, case when image_id % 6 = 0 then 'fixb' else 'fixa' end as fix_commit, decision from fx_replay where image_id % 2 = 0""")
def s17(v, spark, sf):
    """Delta files per fix, as JSON text built from the replay side; b.json repeats some images."""
    r = v("fx_replay")
    entry = F.to_json(F.struct(F.struct(F.col("decision"), F.col("articles").alias("candidates"), "gate_passed", "llr_margin", "max_z_winner").alias("expected"), "label"))
    one = F.concat(F.lit('{"version":1,"fix_commit":"'), F.col("fix"), F.lit('","images":{"'), F.col("sha8"), F.lit('":'), entry, F.lit("}}"))
    a = r.where("image_id % 2 = 0").withColumns({"file_name": F.lit("a.json"), "fix": F.lit("fixa")})
    b = r.where("image_id % 6 = 0").withColumns({"file_name": F.lit("b.json"), "fix": F.lit("fixb")})
    path = scratch_path(spark, "deltas")
    a.unionByName(b).select(F.col("file_name").alias("source"), one.alias("value")).write.partitionBy("source").text(path)
    out = runs.load_accepted_deltas(spark, path, bundled=True)
    return out.select("sha8", "source", "fix_commit", "expected.decision")


@query("S18_load_run_side", "select sha8, case when image_id % 9 = 0 then case when image_id % 2 = 0 then 'drift' else 'fail' end else 'pass' end as band from fx_replay")
def s18(v, spark, sf):
    r = v("fx_replay").withColumn("run_id", F.lit("r1"))
    fails = r.where("image_id % 9 = 0").select("run_id", "sha8", F.when(F.col("image_id") % 2 == 0, "drift").alias("band"))
    metrics = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.run_side(r, fails, metrics, "r1").select("sha8", "band")


@query("S19_load_golden_side", "select sha8, decision from fx_golden where tier >= 2 and image_id % 3 <> 1")
def s19(v, spark, sf):
    g = v("fx_golden")
    return runs.golden_side(g.where("image_id % 3 <> 1").select("sha8", "tier"), g.drop("tier")).select("sha8", "decision")


_RUNS = "(select case when n % 7 = 0 then concat('_', s) else s end as run_id, case when n % 5 <> 0 then n end as metrics_time, case when n % 2 = 0 then 2 else 1 end as tier from (select session as s, max(k) as n from fx_rep group by 1))"


@query("S20_list_runs", f"select tier, arg_max(run_id, (metrics_time, run_id)) as run_id from {_RUNS} t where metrics_time is not null and run_id not like '\\_%' escape '\\' group by 1")
def s20(v, spark, sf):
    return runs.latest_run(v(f"select * from {_RUNS} t"), by_tier=True)


@query("S20_run_counts", f"select count_if(metrics_time is not null and run_id not like '\\_%' escape '\\') as valid, count_if(not (metrics_time is not null and run_id not like '\\_%' escape '\\')) as invalid from {_RUNS} t")
def s20b(v, spark, sf):
    return runs.run_counts(v(f"select * from {_RUNS} t"))


@query("S21_snapshot_baseline_write", f"with t3 as {_T3}, q as ({quota_union(TIER2, 't3', True)}) select metric, k, n, p from q")
def s21(v, spark, sf):
    path = scratch_path(spark, "baseline")
    base = runs.baseline_row(X.tier2_quotas(v("fx_heads")), "r1", 2, 1)
    runs.write_baseline(base, path, "v1")
    return spark.read.parquet(path).select(F.inline("quotas")).select("metric", "k", "n", "p")


@query("S22_baseline_history", f"with t3 as {_T3}, q as ({quota_union(TIER2, 't3', True, 'session')}) select session as version, metric, k, n, p, round(p - lag(p) over (partition by metric order by session), 4) as change from q where metric <> 'accuracy_top1_verdict'")
def s22(v, spark, sf):
    q = X.tier2_quotas(v("fx_heads"), "session")
    vers = q.groupBy(F.col("session").alias("version")).agg(F.collect_list(F.struct("metric", "k", "n", "p")).alias("quotas")).withColumn("date", F.col("version"))
    return runs.baseline_history(vers).select("version", "metric", "k", "n", "p", "change")


@query("S23_build_corpus", """with h as (select concat('captures/', stem, '.png') as image_path, min(sha256(cast(k % 9000 as string))) as sha from fx_rep where k % 13 <> 0 group by 1),
r as (select concat('captures/', stem, '.png') as image_path from fx_rep), j as (select sha from r join h using (image_path)), m as (select sha256(cast(k as string)) as sha from fx_rep where k < 900 and k % 2 = 0)
select count(distinct case when sha not in (select sha from m) then sha end) as new, count(*) - count(distinct case when sha not in (select sha from m) then sha end) as duplicate,
  (select count(*) from r where image_path not in (select image_path from h)) as without_image from j""")
def s23(v, spark, sf):
    r = v("fx_refs")
    hashes = r.where("k % 13 <> 0").groupBy("image_path").agg(F.min(F.sha2((F.col("k") % 9000).cast("string"), 256)).alias("sha"))
    known = r.where("k < 900 and k % 2 = 0").select(F.sha2(F.col("k").cast("string"), 256).alias("sha"))
    cols = ("session", "article", "label", "verdict")
    manifest = known.select("sha", *[F.lit("").alias(c) for c in cols], F.lit(1).alias("tier"), F.lit("").alias("image_rel"), F.lit("").alias("report_rel"))
    sessions = r.select("session").distinct().select("session", F.lit(0.0).alias("db_verified"), F.lit(0.1).alias("mm_per_px"), F.lit(1).alias("tier"))
    return runs.build_corpus(r, v(f"select * from {_SNAP} t"), hashes, manifest, sessions, F.lit(400.0))[2]


# --- journals ---------------------------------------------------------------

_JL = "(select session, slot, max(line_no) as line_no, arg_max(d_mm, line_no) as d_mm from fx_journal group by 1, 2)"


def journal(v):
    j = v("fx_journal")
    last = j.groupBy("session").agg(F.max("line_no").alias("line_no"))
    broken = last.select("session", (F.col("line_no") + 1).alias("line_no"), F.lit(None).cast("struct<slot:bigint,d_mm:double>").alias("entry"))
    return j.select("session", "line_no", F.struct("slot", "d_mm").alias("entry")).unionByName(broken)


@query("W16_latest_per_slot", f"select * from {_JL} t")
def w16(v, spark, sf):
    return runs.latest_per_slot(journal(v)).select("session", "slot", "line_no", "entry.d_mm")


@query("W17_gap_check", f"select session, count(distinct slot) as n, min(slot) = 0 and max(slot) = count(distinct slot) - 1 as complete from {_JL} t group by 1")
def w17(v, spark, sf):
    return runs.gap_check(runs.latest_per_slot(journal(v)))


_HEADS = "(select session, min(article_number) as article_number, min(line_no) as ts, 12 as target, max(ts) as last_ts from fx_journal group by 1)"


@query("T06_open_sessions", f"select h.session, h.article_number, h.ts, n_shots, round(date_diff('microsecond', last_ts, timestamp '2024-02-01') / 1e6, 2) as age_s from {_HEADS} h join (select session, count(distinct slot) as n_shots from {_JL} t group by 1) using (session)")
def t06(v, spark, sf):
    out = runs.open_sessions(runs.latest_per_slot(journal(v)), v(f"select * from {_HEADS} t"), F.lit("2024-02-01"))
    return out.select("session", "article_number", "ts", "n_shots", F.round("age_s", 2).alias("age_s"))


@query("T06_resumable_sessions", f"""select h.session, h.ts, n_shots, state, session % 3 = 0 and session % 5 <> 1 as fingerprint_ok from {_HEADS} h join (select session, count(distinct slot) as n_shots from {_JL} t group by 1) using (session) join (
  select session, case when sum(case when session % 4 >= 1 and (session % 4 > 1 or slot < 4) then 1 else 0 end) = 0 then 'offen'
  when sum(case when session % 4 < 2 then 1 else 0 end) = 0 and sum(case when session % 4 = 2 or slot < 3 then 1 else 0 end) = count(*) then 'gebucht_aufraeumen_offen' else 'umzug_unterbrochen' end as state
  from (select session, slot from fx_journal group by session, slot) t group by 1) using (session) where h.article_number = (select min(article_number) from {_HEADS} x)""")
def t06_full(v, spark, sf):
    """Open sessions of one article with their state and whether the present fingerprint is theirs."""
    heads = v(f"select * from {_HEADS} t")
    first = heads.agg(F.min("article_number")).first()[0]
    heads = heads.withColumns({"calibration_sha256": F.when(F.col("session") % 3 == 0, "cal").otherwise("old"),
                               "background_sha256": F.when(F.col("session") % 5 != 1, "bg"), "features_cfg_sha256": F.lit("cfg")})
    out = runs.open_sessions(runs.latest_per_slot(journal(v)), heads, F.lit("2024-02-01"), states=q09(v, spark, sf), article=first,
                             fingerprint={"calibration_sha256": "cal", "background_sha256": "bg", "features_cfg_sha256": "cfg"})
    return out.select("session", "ts", "n_shots", "state", "fingerprint_ok")


_REQ = f"(select user_id as request, {art('user_id % 55')} as article_number, case when user_id % 3 = 0 then user_id end as ts from events group by user_id)"


@query("J21_resolve_open_session", f"""select request, case when status = 'ok' then s end as session, status from (select r.request, max(case when r.ts is null or r.ts = h.ts then h.session end) as s,
  case when count(h.session) = 0 then 'keine offene Session' when count(case when r.ts is null or r.ts = h.ts then h.session end) = 0 then 'ts passt nicht' when count(case when r.ts is null or r.ts = h.ts then h.session end) > 1 then 'mehrdeutig' else 'ok' end as status
  from {_REQ} r left join {_HEADS} h using (article_number) group by 1)""")
def j21(v, spark, sf):
    return runs.resolve_session(v(f"select * from {_REQ} t"), v(f"select * from {_HEADS} t"))


_TG = "(select session, concat('s', cast(session as string), '/', cast(slot as string)) as source, concat('t', cast(session as string), '/', cast(slot as string)) as target, slot from fx_journal group by session, slot)"


@query("Q09_session_state", f"""select session, case when sum(case when session % 4 >= 1 and (session % 4 > 1 or slot < 4) then 1 else 0 end) = 0 then 'offen'
  when sum(case when session % 4 < 2 then 1 else 0 end) = 0 and sum(case when session % 4 = 2 or slot < 3 then 1 else 0 end) = count(*) then 'gebucht_aufraeumen_offen' else 'umzug_unterbrochen' end as state from {_TG} t group by 1""")
def q09(v, spark, sf):
    t = v(f"select * from {_TG} t")
    m = F.col("session") % 4
    files = t.where(m < 2).select(F.col("source").alias("path")).unionByName(
        t.where((m >= 1) & ((m > 1) | (F.col("slot") < 4))).select(F.col("target").alias("path")))
    booked = t.where((m == 2) | (F.col("slot") < 3)).select(F.col("target").alias("image_path"))
    return runs.session_state(t, files, booked)


@query("Q10_booking_state", f"""select session, count(*) as n, count_if(session % 3 = 0 or (session % 3 = 1 and slot < 5)) as k, case when count_if(session % 3 = 0 or (session % 3 = 1 and slot < 5)) = 0 then 'leer'
  when count_if(session % 3 = 0 or (session % 3 = 1 and slot < 5)) = count(*) then 'vollstaendig' else 'invariante_verletzt' end as state from {_TG} t group by 1""")
def q10(v, spark, sf):
    t = v(f"select * from {_TG} t")
    booked = t.where((F.col("session") % 3 == 0) | ((F.col("session") % 3 == 1) & (F.col("slot") < 5)))
    return runs.booking_state(t, booked.select(F.col("target").alias("image_path")))


# --- streams ----------------------------------------------------------------

def events(spark, sf):
    return ST.read_events(spark, f"{sf}/events.parquet")


@query("R01_stream_identify", f"""{V01_BODY} select m.report_id, {DECIDE.format(gate='3.5e0', mm='2e0')} as decision, top1, llr_margin
from fx_measured m left join (select rep.*, top1 in (select article_number from ns) as refs from rep) r using (report_id)""")
def r01(v, spark, sf):
    path, m = scratch_path(spark, "incoming"), v("fx_measured")
    m.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return ST.stream_identify(stream, v("fx_articles"), shot_stats(v, spark, sf), P).select("report_id", "decision", "top1", "llr_margin")


@query("R02_stream_enroll", f"with {stats_ctes('fx_emb')} select article_number, feature, n, round(mean, 7) as mean, round(std, 5) as std from st")
def r02(v, spark, sf):
    path, e = scratch_path(spark, "shots-in"), v("fx_emb")
    e.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.stream_enroll(stream, scratch_path(spark, "references"))
    return out.select("article_number", "feature", "n", F.round("mean", 7).alias("mean"), F.round("std", 5).alias("std"))


@query("R03_stream_journal_latest", f"select * from {_JL} t")
def r03(v, spark, sf):
    j = events(spark, sf).select(F.col("user_id").alias("session"), (F.col("event_id") % 12).alias("slot"),
                                 F.col("event_id").alias("line_no"), F.col("value").alias("d_mm"))
    return ST.stream_journal_latest(j)


@query("R04_stream_dedup", "select count(distinct concat(cast(user_id as string), '-', event_type)) as n, count(distinct concat(cast(user_id as string), '-', event_type)) as n_hashes from events")
def r04(v, spark, sf):
    e = events(spark, sf).withColumns({"sha": F.concat_ws("-", F.col("user_id").cast("string"), "event_type"), "at": F.col("ts").cast("timestamp")})
    t = ST.run_to_table(ST.dedup(e, "sha", "at", "60 days").select("event_id", "sha"), "dedup")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha").alias("n_hashes"))


@query("R05_stream_decision_rates", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as decision, count(*) as n from events group by 1, 2""")
def r05(v, spark, sf):
    e = events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    t = ST.run_to_table(ST.decision_rates(e, "at", "event_type"), "rates", mode="complete", each=ST.ledger)
    return ST.latest_snapshot(t).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "decision", "n")


@query("R06_stream_enroll_sessions", """with o as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as st from events window w as (partition by user_id order by ts, event_id)),
g as (select user_id, ts, sum(st) over (partition by user_id order by ts rows unbounded preceding) as sid from o)
select user_id, sid_start as start_s, n_shots, n_shots >= 8 as complete from (select user_id, sid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as sid_start, count(*) as n_shots from g group by 1, 2)""")
def r06(v, spark, sf):
    e = events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    t = ST.run_to_table(ST.enroll_sessions(e, "user_id", "at"), "sessions", mode="complete", each=ST.ledger)
    return ST.latest_snapshot(t).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_s"), "n_shots", "complete")


_MARK = "(select max(ts) - interval 1 hour as mark from events)"


@query("R05_closed_windows", f"""select strftime(day, '%Y-%m-%d') as day, event_type as decision, n from (select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2)
where day + interval 1 day <= (select mark from {_MARK})""")
def r05_closed(v, spark, sf):
    """Append mode: each day once, when the watermark has passed it; its state is dropped."""
    e = events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    t = ST.run_to_table(ST.decision_rates(e, "at", "event_type"), "closed-rates")
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "decision", "n")


@query("R06_closed_sessions", f"""with o as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as st from events window w as (partition by user_id order by ts, event_id)),
g as (select user_id, ts, sum(st) over (partition by user_id order by ts rows unbounded preceding) as sid from o)
select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start_s, n_shots, n_shots >= 8 as complete from (select user_id, sid, min(ts) as a, max(ts) as b, count(*) as n_shots from g group by 1, 2)
where b + interval 6 hour <= (select mark from {_MARK})""")
def r06_closed(v, spark, sf):
    """Append mode: each session once, when the watermark has passed its gap."""
    e = events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    t = ST.run_to_table(ST.enroll_sessions(e, "user_id", "at"), "closed-sessions")
    return t.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_s"), "n_shots", "complete")
