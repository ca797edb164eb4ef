"""URL filter: rules, and for the rest trust and distrust that flow along links between hosts.

Hosts whose pages a rule allows are trusted seeds, hosts whose pages a rule blocks are
blocked seeds; a host's seed weight is its number of such pages. Links of the pages make
host edges, weighted by their number; links within a host don't count. Trust is a
personalised PageRank from the trusted seeds along the edges; distrust one from the blocked
seeds against them: who links to a blocked host is suspect. Rank that reaches a host without
edges ends there. With x the seeds and P the row-stochastic edges, ``r = x + damping * P'r`` is solved by
steps until what is still to come, over all hosts, is below ``tolerance`` (a step keeps at most ``damping`` of
the rank in motion); a host that no link touches keeps its seed weight. The SQL form takes 10 steps. A
host is blocked when (distrust - trust) / pages is ``limit`` or more; a page without a
rule gets its host's verdict. Hosts nothing is known of are allowed.

Only DataFrame functions are used. Host and edge sums are pre-aggregated before they are shuffled, so
a host with a third of all pages is a few rows. Link extraction reads the whole html.

Null urls and urls without ``://`` have an empty host and path and are allowed, as no rule fits them.
Null html has no links. Repeated rows are judged alike and count again as seeds and
links. An empty table gives an empty result. Columns other than id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

Rule = tuple[str, str, str]          # verdict, host, path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute link in an attribute; group 1.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path up to query or fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    def fits(r: Rule) -> Column:
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest),
                  reversed(ordered), none)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of one host to another."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust; ``hosts`` has host, good and bad (the seed weights)."""
    seeds = hosts.select("host", F.col("good").cast("double").alias("good"), F.col("bad").cast("double").alias("bad"))
    ends = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    seeds = cut_lineage(seeds.unionByName(ends.select("host", F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))).groupBy(
        "host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = edges.join(out, "src").join(into, "dst")
    # one table for both directions: rank of ``at`` flows to ``to``
    flow = cut_lineage(shares.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("t"),
                                     F.lit(0.0).alias("d")).unionByName(
        shares.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("into")).alias("d"))))
    rank = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"), F.col("good").alias("mt"), F.col("bad").alias("md"))
    most = seeds.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 0.0
    while most * damping / (1 - damping) >= tolerance:           # ``most``: rank in motion at most, in all hosts
        for _ in range(4):
            moved = flow.join(rank.where("mt > 0 or md > 0").select("host", "mt", "md"), F.col("at") == F.col("host")).groupBy("to").agg(
                F.sum(damping * F.col("t") * F.col("mt")).alias("mt"), F.sum(damping * F.col("d") * F.col("md")).alias("md"))
            rank = rank.drop("mt", "md").join(moved, F.col("host") == F.col("to"), "left").select(
                "host", (F.col("trust") + F.coalesce("mt", F.lit(0.0))).alias("trust"),
                (F.col("distrust") + F.coalesce("md", F.lit(0.0))).alias("distrust"),
                F.coalesce("mt", F.lit(0.0)).alias("mt"), F.coalesce("md", F.lit(0.0)).alias("md"))
        rank = cut_lineage(rank)
        most = rank.agg(F.sum(F.col("mt") + F.col("md"))).first()[0]
    return rank.drop("mt", "md")


def judge(pages: DataFrame, rules: Sequence[Rule], *, damping: float = 0.85, tolerance: float = 1e-6, limit: float = 0.5,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the host's trust and distrust a page."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).select(
        "id", host.alias("host"), path.alias("path"), "html")
    found = best_rule(F.col("host"), F.col("path"), rules)
    seeds = rows.withColumn("v", found["verdict"]).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad"))
    folder = scratch_path(spark, "hosts")
    seeds.write.parquet(f"{folder}/seeds")
    host_edges(rows).write.parquet(f"{folder}/edges")
    seeds, edges = spark.read.parquet(f"{folder}/seeds"), spark.read.parquet(f"{folder}/edges")
    rank = propagate(seeds, edges, damping, tolerance)
    verdicts = seeds.join(rank, "host").select(
        "host", (F.col("trust") / F.col("pages")).alias("trust"), (F.col("distrust") / F.col("pages")).alias("distrust"))
    judged = rows.select("id", "host", "path").join(verdicts, "host", "left").withColumn("_f", found)
    by_host = F.when(F.col("distrust") - F.col("trust") >= limit, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("_f.rule").alias("rule"),
        F.coalesce(F.col("_f.verdict"), by_host).alias("verdict"), "trust", "distrust")


def oracle(rules: Sequence[Rule], damping: float = 0.85, rounds: int = 10, limit: float = 0.5) -> str:
    """The same in DuckDB's SQL over ``pages``, without the two rank columns."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    case = lambda value: "case " + " ".join(
        f"when (host = {text(r[1])} or ends_with(host, {text('.' + r[1])})) and starts_with(path, {text(r[2])}) then {text(value(r))}"
        for r in ordered) + " end"
    steps = []
    for k in range(rounds):
        steps.append(f"""r{k + 1} as materialized (select s.host, s.good + {damping} * coalesce(m.mt, 0) as trust, s.bad + {damping} * coalesce(m.md, 0) as distrust
  from seeds s left join (select f.dst as host, sum(f.t * r.trust) as mt, sum(f.d * r.distrust) as md from flow f join r{k} r on f.src = r.host group by f.dst) m on s.host = m.host)""")
    return f"""with cut as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select page_id, html, host, path, {case(lambda r: r[1] + r[2])} as rule, {case(lambda r: r[0])} as verdict from parts),
links as (select host as src, translate(unnest(regexp_extract_all(html, {text(LINK)}, 1)), '{UPPER}', '{LOWER}') as dst from ruled),
edges as materialized (select src, dst, count(*) as n from links where src <> dst and src <> '' and dst <> '' group by src, dst),
tally as materialized (select host, count(*) as pages, count(*) filter (where verdict = 'allow') as good, count(*) filter (where verdict = 'block') as bad from ruled group by host),
seeds as materialized (select host, sum(good)::double as good, sum(bad)::double as bad from (select host, good, bad from tally union all select src, 0, 0 from edges union all select dst, 0, 0 from edges) group by host),
flow as materialized (select e.src, e.dst, e.n::double / o.n as t, 0.0::double as d from edges e join (select src, sum(n) as n from edges group by src) o on e.src = o.src
  union all select e.dst, e.src, 0.0::double, e.n::double / i.n from edges e join (select dst, sum(n) as n from edges group by dst) i on e.dst = i.dst),
r0 as materialized (select host, good as trust, bad as distrust from seeds),
{",".join(steps)}
select p.page_id, p.host, p.path, p.rule, coalesce(p.verdict, case when (r.distrust - r.trust) / t.pages >= {limit} then 'block' else 'allow' end) as verdict
from ruled p join tally t on p.host = t.host join r{rounds} r on p.host = r.host"""
