"""A Merkle manifest of a table: digests of rows, groups and the whole, and a proof of every row.

Rows are leaves. The leaves of a group stand in the order of their ids and are labelled with
ranks. A node covers the leaf ranks ``lo <= rank < hi``; a run of FAN nodes that follow each
other in a level becomes one node of the next, until a group has one node, its subroot. The
subroots, in the order of their groups, are the leaves of one more tree, whose top is the root.

An ancestor of a node at a level is the one whose interval contains the node's. All intervals
of a level start at multiples of FAN ** level, so a level is joined by (group, start of the
covering interval), and the residual test is containment. What a parent's interval holds
besides the node's own are its siblings. Joins go from the top down: a level joins only the
level above it, so each join is a FAN-th of the one below, and the last one has a row for a
run of FAN leaves, not for a leaf. No key has more than FAN rows, however large a group is.

Ranks come from a range partition by (group, id): each task counts the rows of a group as they
pass, and only the first group of a task needs what earlier tasks held of it, which is one row a
task. That table is broadcast; its size is the number of shuffle partitions.

Defined cases: null fields are ``-``; a null group is a group of its own, the first; null ids come
first in their group; rows that share group and id are ordered by their digest, so equal rows
are equal leaves side by side. A null id is never chosen for tampering by the query (its crc32 is
null). An empty table gives an empty result. Of the input only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before: string, after: string>>"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"merkle-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the framed fields of a row: ``-`` for null, else byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _counted(rows: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``grp`` first) in order, each with its task and its count in the task's part of the group; and rows by group and task."""
    columns = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            grp = batch.column(0)
            same = np.zeros(n, bool)
            if n > 1:
                a, b = grp.slice(0, n - 1), grp.slice(1)
                equal = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                same[1:] = equal.to_numpy(zero_copy_only=False)
            head = grp[0].as_py()
            same[0] = last is not None and last[0] == head
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(same, -1, at))
            local = np.where(begin < 0, seen + at, at - begin)
            opening = (begin < 0) & first if last is not None else (begin == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(local.astype(np.int64)),
                                              pa.array(opening)], names=[*columns, "part", "local", "opening"])
            last, seen, first = (grp[n - 1].as_py(),), int(local[-1]) + 1, bool(opening[-1])

    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    counted = _written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        count, f"{kinds}, part long, local long, opening boolean"), name)
    held = counted.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.first("opening").alias("opening"))
    return counted, held


def _with_ranks(rows: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """(rows with ``rank``, rows of the largest group)."""
    counted, held = _counted(rows, order, name)
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = held.withColumn("carry", before).where("opening").select("part", "carry")       # one row a task
    most = held.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    ranked = counted.join(F.broadcast(carry), "part", "left").withColumn(
        "rank", F.col("local") + F.when(F.col("opening"), F.coalesce("carry", F.lit(0))).otherwise(F.lit(0)))
    return ranked.drop("part", "local", "opening", "carry"), most


def _runs(nodes: DataFrame, level: int, *extra: str) -> DataFrame:
    """Nodes (grp, lo, hi, digest) of ``level - 1`` as runs of FAN: grp, lo, hi, digest, children, alone.

    A run that starts at 0 and has one child is the group's only node (``alone``): it's taken over as
    it is, not hashed again.
    """
    child = F.struct("lo", "hi", "digest", *extra)
    out = nodes.groupBy("grp", _start("lo", level).alias("lo")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    alone = (F.col("lo") == 0) & (F.size("children") == 1)
    return out.select("grp", "lo", F.element_at("children", -1)["hi"].alias("hi"), "children", alone.alias("alone"),
                      F.when(alone, F.col("children")[0]["digest"])
                      .otherwise(F.sha2(F.array_join(F.col("children")["digest"], ""), 256)).alias("digest"))


def _start(lo: str, level: int) -> Column:
    """Where the interval of ``level`` that covers rank ``lo`` starts."""
    return F.col(lo) - F.col(lo) % F.lit(FAN ** level)


def _step(children: str, lo: Column, hi: Column) -> Column:
    """Digests of what a parent's interval holds before and after the interval [lo, hi)."""
    left = F.filter(children, lambda c: c["hi"] <= lo)
    right = F.filter(children, lambda c: c["lo"] >= hi)
    return F.struct(F.array_join(left["digest"], "").alias("before"), F.array_join(right["digest"], "").alias("after"))


def _levels(rows: DataFrame, order: Sequence[str], name: str, extra: Sequence[str]) -> list[DataFrame]:
    """Runs of every level, from the leaves up; in the last each group has one node."""
    ranked, most = _with_ranks(rows, order, name)
    leaves = ranked.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *extra)
    levels = [_written(_runs(leaves, 1, *extra), f"{name}-1")]
    width = FAN
    while width < most:
        below = levels[-1].select("grp", "lo", "hi", "digest")
        levels.append(_written(_runs(below, len(levels) + 1), f"{name}-{len(levels) + 1}"))
        width *= FAN
    return levels


def _attach(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest runs with the steps from each of them to the top, given the steps above the ``tops``.

    ``tops``: grp, top, steps. Levels are joined from the top down by containment.
    """
    above = levels[-1].join(tops, levels[-1]["grp"].eqNullSafe(tops["grp"]), "inner").drop(tops["grp"])
    for level in range(len(levels) - 1, 0, -1):
        up = above.select(F.col("grp").alias("up_grp"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("children").alias("up_children"),
                          F.col("alone").alias("up_alone"), "top", "steps")
        here = levels[level - 1]
        inside = (F.col("grp").eqNullSafe(F.col("up_grp")) & (_start("lo", level + 1) == F.col("up_lo"))
                  & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi")))
        own = F.array(_step("up_children", F.col("lo"), F.col("hi")))
        above = here.join(up, inside).select(
            *here.columns, "top", F.when(F.col("up_alone"), F.col("steps")).otherwise(F.concat(own, "steps")).alias("steps"))
    return above


def _folded(start: Column, steps: str) -> Column:
    return F.aggregate(steps, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def _joined(steps: str) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, *, id_col: str = "doc_id", group_col: str = "source",
             fields: Sequence[str] = FIELDS) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of all sibling digests from the leaf up to the root, left to right.
    ``altered`` maps fields to what a check finds in their place (null: unchanged). ``folded_root`` is the root that
    follows from the row as found and the siblings as recorded; ``verified`` tells whether it's the root.
    """
    spark = docs.sparkSession
    found = {k: F.coalesce(v, F.col(k)) for k, v in (altered or {}).items()}
    changed = F.lit(False)
    for v in (altered or {}).values():
        changed = changed | v.isNotNull()
    leaves = _written(docs.select(
        F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
        F.when(changed, leaf_digest([found.get(c, F.col(c)) for c in fields])).alias("found")), "leaves")
    levels = _levels(leaves, ["id", "digest"], "groups", ["id", "found"])
    subroots = levels[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "digest")
    above = _levels(subroots, ["source"], "root", ["source"])
    top = above[-1].select("digest").first()
    root = F.lit(top["digest"] if top else None).cast("string")
    nothing = spark.range(1).select(F.lit(0).alias("grp"), root.alias("top"), F.array().cast(_STEPS).alias("steps"))
    shown = _leaves_of(_attach(above, nothing))
    tops = shown.select(F.col("child.source").alias("grp"), F.col("child.digest").alias("top"), "steps")
    rows = _leaves_of(_attach(levels, tops))
    child, leaf = F.col("child"), F.col("child.digest")
    folded = _folded(F.coalesce(child["found"], leaf), "steps")
    return rows.select(child["id"].alias(id_col), leaf.alias("leaf"), F.col("top").alias("subroot"), root.alias("root"),
                       F.sha2(_joined("steps"), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _leaves_of(runs: DataFrame) -> DataFrame:
    """A row for each child of the lowest runs, with all its steps: child, top, steps."""
    each = runs.select("children", "alone", "top", "steps", F.explode("children").alias("child"))
    own = F.array(_step("children", F.col("child.lo"), F.col("child.hi")))
    return each.select("child", "top", F.when(F.col("alone"), F.col("steps")).otherwise(F.concat(own, "steps")).alias("steps"))


def oracle(levels: int = 5) -> str:
    """The query on ``documents`` in SQL, for groups of up to FAN ** levels rows and as many groups."""
    framed = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in FIELDS)
    tampered = framed.replace("(text as", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as")
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), "
           f"lambda x: cast(ascii(x) as bigint))), lambda c, b: {bits}), 4294967295)")
    out = [f"""g0 as (select *, row_number() over (partition by source order by doc_id nulls first, digest) - 1 as idx,
        count(*) over (partition by source) as n from (select doc_id, source, sha256({framed}) as digest,
        case when {crc} % 5 = 0 then sha256({tampered}) else sha256({framed}) end as found from documents))"""]

    def up(p: str, key: str) -> None:
        for i in range(1, levels + 1):
            out.append(f"""{p}{i} as (select {key}, idx // {FAN} as idx, case when any_value(n) = 1 then any_value(digest)
                else sha256(string_agg(digest, '' order by idx)) end as digest, (any_value(n) + {FAN - 1}) // {FAN} as n
                from {p}{i - 1} group by {key}, idx // {FAN})""")

    up("g", "source")
    out.append(f"""r0 as (select 1 as one, source, digest, row_number() over (order by encode(source) nulls first) - 1 as idx,
        count(*) over () as n from g{levels})""")
    up("r", "one")

    def side(p: str, i: int, op: str, key: str) -> str:
        own = f"(l.{p}idx // {FAN ** i})"
        same = "s.source is not distinct from l.source" if key == "source" else "true"
        return (f"coalesce((select string_agg(s.digest, '' order by s.idx) from {p}{i} s where {same} "
                f"and s.idx // {FAN} = {own} // {FAN} and s.idx {op} {own}), '')")

    last, proof = "l0", []
    out.append(f"""l0 as (select g0.doc_id, g0.source, g0.digest as leaf, g0.found as folded, g0.idx as gidx, r0.idx as ridx,
        r0.digest as subroot, g0.n as gn, r0.n as rn, '' as proof,
        (select digest from r{levels}) as root from g0 join r0 on g0.source is not distinct from r0.source)""")
    for p, key in (("g", "source"), ("r", "one")):
        for i in range(levels):
            name = f"{p}fold{i}"
            many = f"(l.{p}n + {FAN ** i - 1}) // {FAN ** i} > 1"
            out.append(f"""{name} as (select l.* replace (
                case when {many} then sha256(before || l.folded || behind) else l.folded end as folded,
                case when {many} then l.proof || before || behind else l.proof end as proof) from
                (select l.*, {side(p, i, '<', key)} as before, {side(p, i, '>', key)} as behind from {last} l) l)""")
            out[-1] = out[-1].replace("select l.* replace", "select l.* exclude (before, behind) replace")
            last = name
    return ("with " + ",\n".join(out) + f"""
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
        from {last}""")
