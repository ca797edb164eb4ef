"""Approximate nearest neighbours by multiprobe p-stable hashing, largest inner product first.

Vectors are scaled by the largest norm and given one more component that makes all of them
unit vectors (0 for queries), so the largest inner product is the smallest distance. A table
hashes a vector by ``hashes`` slots floor((a.x + b) / width) with Gaussian a. A query
visits, in each of the tables, its own bucket and the buckets that differ by one slot step
in some of the hashes, in the order of the summed squared distances to the crossed slot
borders: the likeliest first. Candidates of all tables are merged and ranked by the exact
inner product of the original vectors in double precision.

The number of hashes and of probes is fitted on ``probe_sample`` queries, whose true
neighbours are found against all rows, and on ``row_sample`` rows: of the settings that reach ``target``
recall there, over a few slot widths, the one that visits the smallest share of rows. All rows are indexed. A candidate that scores below 2 (k + 1) of the sampled
rows can't be among the nearest and does not leave its task. A query that
still finds fewer than k rows is searched against all rows, so short buckets lose nothing.

Equal vectors are one class with its k + 1 smallest ids (no query can need more of them).
Index rows are packed by shard of the bucket key in blocks of bounded size, and so are queries;
a hot bucket is many blocks. A joined row is one block against one block.

Vectors that are null, zero, hold null or non-finite components, or have another length
than most vectors take no part; nor do rows with a null id. Repeated rows (same id and
vector) count once. Ties go to the smaller id. An empty table gives an empty result.
Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import few_rows_a_batch, mix

INDEX_BLOCK, QUERY_BLOCK = 2048, 256
TABLES = 4
WIDTHS = (0.8, 1.2, 1.8, 2.6, 3.6)     # slots on the scale of unit vectors
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Hashes:
    """Hash functions of all tables, and how many buckets a query visits in each."""

    a: np.ndarray           # table, component, hash
    b: np.ndarray           # table, hash
    width: float
    norm: float
    probes: int = 1

    @classmethod
    def make(cls, dim: int, hashes: int, width: float, norm: float, seed: int = 11) -> Hashes:
        rng = np.random.default_rng([seed, hashes])
        return cls(rng.standard_normal((TABLES, dim + 1, hashes)), rng.uniform(0, width, (TABLES, hashes)), width, norm)

    def _places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """table, row, hash: the place on each line, in slots."""
        length = np.linalg.norm(x, axis=1)
        unit = x / (length[:, None] if query else self.norm)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (length / self.norm) ** 2))
        full = np.concatenate([unit, rest[:, None]], axis=1)
        return (np.einsum("nd,tdh->tnh", full, self.a) + self.b[:, None]) / self.width

    @staticmethod
    def _key(slots: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """One 63-bit key for the slots (last axis) of a table."""
        out = np.broadcast_to(tables, slots.shape[:-1]).astype(np.uint64) + np.uint64(1)
        for h in range(slots.shape[-1]):
            out = mix(out * _STEP + slots[..., h].astype(np.int64).view(np.uint64))
        return (out >> np.uint64(1)).view(np.int64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """row, table: bucket keys of index rows."""
        slots = np.floor(self._places(x, False))
        return self._key(slots, np.arange(len(slots))[:, None]).T

    def probe_keys(self, q: np.ndarray, probes: int | None = None) -> np.ndarray:
        """row, table, probe: keys in the order in which they are visited."""
        place = self._places(q, True)
        slots = np.floor(place)
        over = place - slots
        steps = perturbations(over, probes or self.probes)                 # table, row, probe, hash
        return self._key(slots[:, :, None, :] + steps, np.arange(len(slots))[:, None, None]).transpose(1, 0, 2)


def perturbations(over: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cheapest steps in {-1, 0, 1} per hash; ``over``: distance to the lower border.

    The cost of a step is the squared distance to the border that it crosses. Built hash by
    hash, keeping the cheapest ``probes`` of the partial steps: a prefix of a cheapest
    step is among the cheapest prefixes, so none is missed.
    """
    cost = np.zeros((*over.shape[:2], 1))
    steps = np.zeros((*over.shape[:2], 1, 0), np.int8)
    for h in range(over.shape[2]):
        o = over[:, :, h, None]
        grown = np.concatenate([cost, cost + o ** 2, cost + (1 - o) ** 2], axis=2)
        n = cost.shape[2]
        order = np.argsort(grown, axis=2, kind="stable")[:, :, :probes]
        cost = np.take_along_axis(grown, order, axis=2)
        kept = np.take_along_axis(steps, (order % n)[..., None], axis=2) if h else np.zeros((*order.shape, 0), np.int8)
        step = np.array([0, -1, 1], np.int8)[order // n]
        steps = np.concatenate([kept, step[..., None]], axis=3)
    return steps


def fit(x: np.ndarray, q: np.ndarray, truth: list[np.ndarray], norm: float, target: float, rows: int) -> Hashes:
    """Choose hashes and probes: ``truth`` has the true neighbours' vectors of each query in ``q``."""
    best, fewest = None, np.inf
    for width, hashes in product(WIDTHS, range(2, 13)):
        h = Hashes.make(q.shape[1], hashes, width, norm)
        most = min(3 ** hashes, 1024)
        probes = h.probe_keys(q, most)
        first = []
        for i, near in enumerate(truth):
            if len(near):
                hit = h.keys(near)[:, :, None] == probes[i][None]
                first.append(np.where(hit.any(axis=2), hit.argmax(axis=2), most).min(axis=1))
        seen = np.concatenate(first) if first else np.zeros(0)
        need = np.sort(seen)[int(np.ceil(target * len(seen))) - 1] if len(seen) else 0
        if need >= most:
            continue
        h.probes = int(need) + 1
        keys = h.keys(x)
        visited = np.mean([np.isin(keys[:, t], probes[i, t, :h.probes]).sum() for i in range(0, len(q), 4) for t in range(TABLES)])
        cost = visited / max(1, len(x)) * rows * TABLES + 4 * h.probes * TABLES
        if cost < fewest:
            best, fewest = h, cost
    if best is None:                                 # no setting gets there: one slot for all rows
        best = Hashes.make(q.shape[1], 1, 1e6, norm)
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _exact_top(classes: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """q, v: the k nearest class vectors of a few queries, against all classes."""
    shared = classes.sparkSession.sparkContext.broadcast(queries)
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = shared.value @ _matrix(batch.column(0), dim).T
            n = min(k, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(s)), n)), pa.array(np.take_along_axis(s, top, 1).ravel()),
                 batch.column(0).take(pa.array(top.ravel()))], names=["q", "s", "v"])

    rows = classes.select("v").mapInArrow(run, "q long, s double, v array<float>")
    w = Window.partitionBy("q").orderBy(F.desc("s"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("q", "v")


def _blocks(rows: DataFrame, size: int, by: str) -> DataFrame:
    """shard, rows: lists of about ``size`` rows of a shard each."""
    cols = [c for c in rows.columns if c != "shard"]
    count = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    return rows.join(count, "shard").withColumn("_b", F.pmod(F.xxhash64(by), "_n")).groupBy("shard", "_b").agg(
        *(F.collect_list(c).alias(c) for c in cols)).drop("_b")


def _tiles(index: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """q, cid: candidates, the best k of each query, and all that score like the last of them."""
    def slack(cut: np.ndarray) -> np.ndarray:
        """Sums in another order may differ by so much."""
        return np.where(np.isfinite(cut), 1e-9 * np.maximum(1.0, np.abs(cut)), 0.0)

    pairs = index.join(queries, "shard").select("keys", "cids", "vs", "qs", "qkeys", "qvs", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                part = [batch.column(c)[r].values for c in range(7)]
                keys, cids, qs = (part[i].to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                known, slot = np.unique(keys, return_inverse=True)
                ask = part[4]
                owner = np.repeat(np.arange(len(qs)), np.diff(ask.offsets.to_numpy()))
                asked = ask.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = known[at] == asked
                open_ = np.zeros((len(qs), len(known)), bool)
                open_[owner[hit], at[hit]] = True
                open_[np.diff(ask.offsets.to_numpy()) == 0] = True      # no keys: a search of everything
                mine = np.flatnonzero(open_.any(axis=1))
                if not len(mine):
                    continue
                left, right = (part[i].to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for i in (5, 2))
                order = np.argsort(cids, kind="stable")              # one class may be here by several tables
                cids, start = np.unique(cids[order], return_index=True)
                seen = np.logical_or.reduceat(open_[mine][:, slot[order]], start, axis=1)
                s = left[mine] @ right[order[start]].T
                s[~seen | (s < part[6].to_numpy(zero_copy_only=False)[mine][:, None])] = -np.inf
                n = min(k, s.shape[1])
                cut = -np.partition(-s, n - 1, axis=1)[:, n - 1]         # all that tie with the last one stay
                who, what = np.nonzero(np.isfinite(s) & (s >= cut[:, None] - slack(cut)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(qs[mine][who]), pa.array(cids[what]), pa.array(s[who, what])],
                                                 names=["q", "cid", "s"])

    found = pairs.mapInArrow(run, "q long, cid long, s double")
    merged = found.groupBy("q", "cid").agg(F.max("s").alias("s"))
    w = Window.partitionBy("q").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.col("_cut")
    return merged.withColumn("_cut", F.nth_value("s", k).over(w)).where(
        cut.isNull() | (F.col("s") >= cut - 1e-9 * F.greatest(F.lit(1.0), F.abs(cut)))).select("q", "cid")


def search(vectors: DataFrame, is_query, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
           target: float = 0.96, probe_sample: int = 64, row_sample: int = 16384) -> DataFrame:
    """The k nearest rows found for every row where ``is_query(id column)`` holds.

    Columns: query_id, rank (from 1), vec_id, score (inner product of the original vectors).
    """
    spark = vectors.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"neighbours-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda e: e != 0))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    good = good.where(F.size("v") == dim).withColumn("cid", F.xxhash64("v"))
    w = Window.partitionBy("v").orderBy("id")
    firsts = good.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    classes = kept(firsts.groupBy("v").agg(F.first("cid").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                                   lambda s, e: s + e)
    asked = kept(good.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("cid").alias("q")).distinct(), "asked")
    queries = classes.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi").select("cid", "v")
    shape = classes.agg(F.count(F.lit(1)), F.max(dot("v", "v"))).first()
    n, norm = shape[0], float(np.sqrt(shape[1]))
    few = queries.orderBy(F.xxhash64("cid"), "cid").limit(probe_sample).toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], schema)
    q = _matrix(few.column("v"), dim)
    rows = _matrix(classes.select("v", "cid").orderBy(F.xxhash64("cid"), "cid").limit(row_sample).toArrow().column("v"), dim)
    truth: list[list] = [[] for _ in q]
    for r in _exact_top(classes, q, k + 1).toArrow().to_pylist():
        truth[r["q"]].append(r["v"])
    shown = spark.sparkContext.broadcast(rows)
    hashes = fit(rows[:4096], q, [np.array(t, float) for t in truth], norm, target, n)

    shards = max(1, -(-n * TABLES // INDEX_BLOCK))

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = hashes.keys(_matrix(batch.column(1), dim))
                at = pa.array(np.repeat(np.arange(len(batch)), TABLES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel() % shards), pa.array(keys.ravel()), batch.column(0).take(at),
                     batch.column(1).take(at)], names=["shard", "keys", "cids", "vs"])

    def floor(x: np.ndarray) -> np.ndarray:
        """A score that the k + 1 nearest classes of each query reach, as 2 (k + 1) sampled rows do."""
        s, at = x @ shown.value.T, 2 * (k + 1)
        if s.shape[1] <= at:
            return np.full(len(x), -np.inf)
        return np.partition(s, s.shape[1] - at, axis=1)[:, s.shape[1] - at] - 1e-9

    def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                mine_all = _matrix(part.column(1), dim)
                probes = hashes.probe_keys(mine_all).reshape(len(part), -1)
                floors = floor(mine_all)
                out: list[list] = [[], [], []]
                for i, mine in enumerate(probes):
                    mine = np.unique(mine)
                    place = mine % shards
                    order = np.argsort(place, kind="stable")
                    names, starts = np.unique(place[order], return_index=True)
                    for name, group in zip(names.tolist(), np.split(mine[order], starts[1:])):
                        out[0].append(name)
                        out[1].append(i)
                        out[2].append(group)
                take = pa.array(out[1], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), part.column(0).take(take), pa.array(out[2], pa.list_(pa.int64())),
                     part.column(1).take(take), pa.array(floors).take(take)], names=["shard", "qs", "qkeys", "qvs", "floors"])

    index = _blocks(classes.select("cid", "v").mapInArrow(
        index_rows, "shard long, keys long, cids long, vs array<float>"), INDEX_BLOCK, "cids")
    index = kept(index.withColumn("vs", F.flatten("vs")), "index")
    probing = _blocks(queries.mapInArrow(query_rows, "shard long, qs long, qkeys array<long>, qvs array<float>, floors double"), QUERY_BLOCK, "qs")
    with few_rows_a_batch(spark):
        top = kept(_tiles(index, probing.withColumn("qvs", F.flatten("qvs")), dim, k + 1), "top")

    members = classes.select("cid", F.col("v").alias("_cv"), "ids")

    def found(top: DataFrame) -> DataFrame:
        """The rows of the found classes, exactly scored and ranked, for every query id."""
        scored = top.join(members, "cid").join(queries.select(F.col("cid").alias("q"), F.col("v").alias("_qv")), "q").select(
            "q", "ids", dot(F.col("_qv"), F.col("_cv")).alias("score"))
        each = asked.join(scored, "q").select("query_id", "q", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))      # an id may have several vectors
        return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    got = kept(found(top), "found")
    have = got.groupBy("query_id").count()
    short = asked.join(have, "query_id", "left").where(F.coalesce("count", F.lit(0)) < k).select("query_id", "q")
    short = kept(short, "short")
    shape_out = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    if not short.limit(1).count():
        return got.select(*shape_out)
    again = queries.join(short.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi")
    everywhere = again.select(F.col("cid").alias("qs"), F.col("v").alias("qvs"), F.array().cast("array<long>").alias("qkeys"), F.lit(float("-inf")).alias("floors"),
                              F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("shard", F.col("shard").cast("long"))
    rest = _tiles(index, _blocks(everywhere, QUERY_BLOCK, "qs").withColumn("qvs", F.flatten("qvs")), dim, k + 1)
    with few_rows_a_batch(spark):
        rest = kept(rest, "rest")
    more = found(rest).join(short.select("query_id"), "query_id", "left_semi")
    return got.join(short, "query_id", "left_anti").select(*shape_out).unionByName(more.select(*shape_out))
