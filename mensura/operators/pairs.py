"""Pairs and neighbours: duplicate scan, clusters, nearest vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as dist
from ..session import cut_lineage
from . import enroll

ART = enroll.ARTICLE


# --- duplicate scan ---------------------------------------------------------

def article_profiles(shots: DataFrame, profile: str, length: str | None = None) -> DataFrame:
    """article, n, proto, sigma, estimated: mean profile and rms spread of its shots.

    One-shot articles get the pooled (rms) spread of the others, flagged estimated.
    """
    vec = shots.where(F.size(profile) > 0).select(
        ART, F.col(profile).alias("vec"), *([F.col(length).alias("_len")] if length else []))
    proto = enroll.vector_mean(vec, [ART])
    d = dist.rms_difference(F.col("vec"), F.col("proto"))
    aggs = [F.count(F.lit(1)).alias("n_profiles"), enroll.rms(F.col("_d")).alias("_s")]
    if length:
        aggs.append(F.avg("_len").alias("length_mm"))
    per = vec.join(proto, ART).withColumn("_d", d).groupBy(ART).agg(*aggs)
    own = F.when(F.col("n_profiles") >= 2, F.col("_s"))
    pooled = per.agg(F.sqrt(F.avg(own * own)).alias("_pool"))          # one row
    return proto.join(per, ART).join(F.broadcast(pooled)).select(
        ART, "n_profiles", "proto", F.coalesce(own, F.col("_pool")).alias("sigma"),
        own.isNull().alias("estimated"), *(["length_mm"] if length else []))


def _pair_columns(p: DataFrame) -> DataFrame:
    d = dist.rms_difference(F.col("proto"), F.col("proto_r"))
    eff = F.sqrt((F.col("sigma") * F.col("sigma") + F.col("sigma_r") * F.col("sigma_r")) / 2.0)
    cols = [F.col(ART).alias("a"), F.col(f"{ART}_r").alias("b"), d.alias("d"), eff.alias("_e"),
            (F.col("estimated") | F.col("estimated_r")).alias("estimated")]
    if "length_mm" in p.columns:
        cols.append(F.abs(F.col("length_mm") - F.col("length_mm_r")).alias("d_length"))
    out = p.select(*cols)
    return out.where("_e > 0").withColumn("d_sigma", F.col("d") / F.col("_e")).drop("_e")


def _right(profiles: DataFrame) -> DataFrame:
    return profiles.select([F.col(c).alias(f"{c}_r") for c in profiles.columns])


def all_pairs(profiles: DataFrame, tiles: int = 16) -> DataFrame:
    """Every article pair a < b with d and d/sigma.

    The listing is quadratic in the stock by definition. Both sides are dealt into
    hash tiles and only tile pairs meet, so no task ever holds a whole side.
    """
    t = F.pmod(F.xxhash64(ART), F.lit(tiles)).cast("int")
    left = profiles.withColumn("_i", t).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = profiles.withColumn("_j", t).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = right.select("_i", "_j", *[F.col(c).alias(f"{c}_r") for c in profiles.columns])
    return _pair_columns(left.join(right, ["_i", "_j"]).where(F.col(ART) < F.col(f"{ART}_r")))


BLOCKS = 8                  # parts of a profile whose means bound the distance
MOST_BINS = 1024            # bins of one of the two axes


def _block_means(proto: Column) -> Column:
    """Means of up to BLOCKS consecutive parts, and the square root of length over part length, as arrays of structs."""
    n = F.size(proto)
    parts = F.least(F.lit(BLOCKS), n)

    def part(j: Column) -> Column:
        at = F.floor(j * n / parts).cast("int")
        size = F.floor((j + 1) * n / parts).cast("int") - at
        total = F.aggregate(F.slice(proto, at + 1, size), F.lit(0.0), lambda s, x: s + x)
        return F.struct((total / size).alias("m"), F.sqrt(n / size).alias("w"))

    return F.transform(F.sequence(F.lit(0), parts - 1), part)


def _edges(values: list[float], least: float) -> list[float]:
    """Quantiles as bin edges, none closer than ``least`` to the one before."""
    out: list[float] = []
    for v in values:
        if not out or v >= out[-1] + least:
            out.append(v)
    return out


def close_pairs(profiles: DataFrame, limit: float) -> DataFrame:
    """Exactly the pairs with d/sigma below ``limit``, without looking at all pairs.

    The mean square difference is at least the weighted mean square difference of the means of the profile's
    parts, and the pooled sigma at most (sigma_a + sigma_b) / sqrt(2). So every part's mean of a close pair
    differs by no more than limit * (sigma_a + sigma_b) / sqrt(2) * sqrt(length / part length). The two parts that
    spread most, in units of the mean reach, are the axes of a grid with quantile bins; profiles go to the cells that their
    reach touches, meet by length and cell, and once only, in the last cell where both start. All parts are compared
    before the distance is taken. Profiles of equal mean meet only if they are alike in their parts.
    """
    reach = F.lit(float(limit) / math.sqrt(2.0)) * F.col("sigma")
    p = profiles.withColumns({"_b": _block_means(F.col("proto")), "_len": F.size("proto"), "_r": reach}).where("_len > 0")
    p = cut_lineage(p)
    part = [F.get("_b", j) for j in range(BLOCKS)]
    stats = p.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(x["m"]).alias(f"s{j}") for j, x in enumerate(part)],
                  *[F.avg(F.col("_r") * x["w"]).alias(f"r{j}") for j, x in enumerate(part)]).first()
    wide = sorted(range(BLOCKS), key=lambda j: -(stats[f"s{j}"] or 0.0) / max(stats[f"r{j}"] or 0.0, 1e-12))
    axes = sorted(wide[:2])
    bins = int(min(MOST_BINS, max(1, math.isqrt(int(stats["n"]) // 16))))
    qs = F.array(*[F.lit(i / bins) for i in range(1, bins)]) if bins > 1 else None
    found = p.agg(*[F.percentile_approx(part[j]["m"], qs, F.lit(bins * 20)).alias(f"e{j}") for j in axes]).first() if qs is not None else None
    first, last = [], []
    for j in axes:
        edges = F.array(*[F.lit(float(e)) for e in _edges((found[f"e{j}"] or []) if found else [], stats[f"r{j}"] or 0.0)]).cast("array<double>")
        m, r = F.coalesce(part[j]["m"], F.lit(0.0)), F.coalesce(F.col("_r") * part[j]["w"], F.lit(0.0)) + 1e-9

        def bin_of(x: Column, edges: Column = edges) -> Column:
            return F.size(F.filter(edges, lambda e: e <= x))
        first.append(bin_of(m - r))
        last.append(bin_of(m + r))
    p = p.withColumns({"_x": first[0], "_x1": last[0], "_y": first[1], "_y1": last[1]})
    cells = p.withColumn("_cx", F.explode(F.sequence("_x", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y", "_y1"))).drop("_x1", "_y1")
    right = cells.select([F.col(c).alias(c if c in ("_cx", "_cy", "_len") else f"{c}_r") for c in cells.columns])
    near = F.forall(F.arrays_zip(F.col("_b").alias("a"), F.col("_b_r").alias("b")), lambda z: F.abs(z["a"]["m"] - z["b"]["m"])
                    <= (F.col("_r") + F.col("_r_r")) * z["a"]["w"] + 1e-9)
    meet = ((F.col(ART) < F.col(f"{ART}_r")) & (F.col("_cx") == F.greatest("_x", "_x_r")) & (F.col("_cy") == F.greatest("_y", "_y_r")) & near)
    pairs = cells.join(right, ["_len", "_cx", "_cy"]).where(meet)
    return _pair_columns(pairs).where(F.col("d_sigma") < limit)


def _number_of_pairs(profiles: DataFrame, *keys: str) -> int:
    """Pairs (within equal ``keys``) of which not both spreads are 0, counted from group sizes."""
    g = profiles.where("sigma is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sigma") == 0).alias("z"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    return int(g.agg(F.sum(two("n") - two("z"))).first()[0] or 0)


def gap_candidates(profiles: DataFrame, edge: int, k: int = 3, limit: float = 0.25) -> DataFrame:
    """The k largest ratio jumps among the ``edge`` closest pairs, with the share of pairs below.

    The closest pairs come from ``close_pairs`` with a limit that doubles until it holds enough of
    them; all pairs are only counted. The edge is a short list by definition; only that list reaches the window.
    """
    want = max(edge, 2)
    total = _number_of_pairs(profiles)
    alike = _number_of_pairs(profiles.withColumn("_len", F.size("proto")), "_len")
    while True:
        near = cut_lineage(close_pairs(profiles, limit))
        if near.limit(min(want, alike)).count() >= min(want, alike):
            break
        limit *= 2.0
    low = near.orderBy("d_sigma", "a", "b").limit(want).select("d_sigma", "a", "b")
    w = Window.orderBy("d_sigma", "a", "b")
    j = low.withColumns({"below": F.row_number().over(w).cast("long"), "upper": F.lead("d_sigma").over(w)})
    j = j.where((F.col("d_sigma") > 0) & F.col("upper").isNotNull())
    return j.select("below", F.col("d_sigma").alias("lower"), "upper",
                    (F.col("upper") / F.col("d_sigma")).alias("factor"),
                    (F.col("below") / F.lit(total)).alias("share")).orderBy(F.desc("factor"), "below").limit(k)


_EDGES = 1 << 14            # both directions of the pairs that a task holds of a kept list, or more


def clusters(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, cluster: transitive closure of a pair list, cluster = smallest member.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so long chains shrink geometrically. A hub's edges are reduced by a
    partial minimum before the shuffle. Rounds stop when no label changes; labels only fall, so they do.
    What a round keeps has a part for each _EDGES edges, so that a short list is not a task for each shuffle partition.
    """
    both = edges.select(F.col(a).alias("n"), F.col(b).alias("m")).unionByName(
        edges.select(F.col(b).alias("n"), F.col(a).alias("m"))).distinct()
    both = cut_lineage(both)
    parts = 1 + both.count() // _EDGES
    both = both.coalesce(parts)
    label = cut_lineage(both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("c")).coalesce(parts))
    while True:
        near = both.join(label.select(F.col("n").alias("m"), "c"), "m").groupBy("n").agg(F.min("c").alias("k"))
        step = label.join(near, "n").select("n", F.least("c", "k").alias("c1"), F.col("c").alias("c0"))
        jump = label.select(F.col("n").alias("c1"), F.col("c").alias("j"))
        nxt = cut_lineage(step.join(jump, "c1", "left").select(
            "n", F.least(F.col("c1"), F.coalesce("j", "c1")).alias("c"), "c0").coalesce(parts))
        label = nxt.select("n", "c")
        if not nxt.where("c <> c0").take(1):
            return label.select(F.col("n").alias("node"), F.col("c").alias("cluster"))


def runnable(shots: DataFrame, profile: str, image: str) -> DataFrame:
    """One row: counts and the reason a scan cannot run, NULL when it can."""
    per = shots.groupBy(ART).agg(
        F.count(F.lit(1)).alias("_refs"), F.count(image).alias("_imgs"),
        F.count_if(F.coalesce(F.size(profile) > 0, F.lit(False))).alias("_prof"))
    t = per.agg(F.count(F.lit(1)).alias("n_articles"), F.coalesce(F.sum("_refs"), F.lit(0)).alias("n_references"),
                F.coalesce(F.sum("_imgs"), F.lit(0)).alias("n_images"),
                F.count_if(F.col("_prof") >= 1).alias("n_usable"))
    why = (F.when(F.col("n_articles") == 0, "keine Referenzen").when(F.col("n_images") == 0, "keine Referenzbilder")
           .when(F.col("n_usable") < 2, "weniger als zwei verwertbare Artikel"))
    return t.withColumn("reason", why)


# --- nearest vectors --------------------------------------------------------

_BLOCK = 4096
_COPIES = 20_000            # rows that a batch of queries becomes at a time
_ROWS = 512                 # queries multiplied at a time
MOST_CELLS = 4096           # pivots that every task holds


def _chords(x, y):
    """Distances between the rows of two matrices."""
    import numpy as np
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T))


def _normalised(df: DataFrame, key: str, vec: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return df.where(F.size(vec) > 0).withColumn("_n", norm).withColumn(
        "_v", F.transform(vec, lambda x: x.cast("double") / F.col("_n"))).select(
        F.col(key).cast("long").alias("_id"), *[c for c in df.columns if c not in (key, vec)], "_v")


def embedding_knn(queries: DataFrame, index: DataFrame, k: int, *, key: str = "vec_id",
                  vec: str = "embedding", label: str = "label", n_cells: int | None = None) -> DataFrame:
    """key, rank, neighbour, label, similarity: exact cosine top-k of every query.

    The index is cut into about sqrt(n) cells around pivot vectors, found through two levels of pivots. Blocks of
    bounded size hold a part of a large cell or several small ones of one upper pivot. A first look at one block of the own
    cell bounds the k-th distance; by the triangle inequality only cells that can beat it are visited, and a query
    is sent once to each block it visits, a bounded number of rows at a time. A block goes to the query parts that visit it, by a
    join on the distinct (block, part) list. Blocks are multiplied inside tasks, each returning its k best, never its pairs.
    """
    import numpy as np
    import pandas as pd

    idx, qry = _normalised(index, key, vec), _normalised(queries, key, vec)
    if n_cells is None:
        n_cells = min(MOST_CELLS, max(16, math.isqrt(idx.count())))
    pivots = np.array([r["_v"] for r in idx.orderBy(F.xxhash64("_id")).limit(n_cells).collect()])
    if len(pivots) == 0:
        raise ValueError("the index is empty")
    tops = pivots[:max(1, math.isqrt(len(pivots)))]             # the upper level
    under = _chords(pivots, tops).argmin(1)
    own = [np.flatnonzero(under == t) for t in range(len(tops))]

    def chord(x):
        return _chords(x, pivots)

    def assign(batches):
        # Any cell near by will do: its radius says how far its vectors are.
        for b in batches:
            if len(b):
                x = np.stack(b["_v"].to_numpy())
                top, cell, dist_ = _chords(x, tops).argmin(1), np.zeros(len(x), "int32"), np.zeros(len(x))
                for t in np.unique(top):
                    rows = np.flatnonzero(top == t)
                    d = _chords(x[rows], pivots[own[t]])
                    cell[rows], dist_[rows] = own[t][d.argmin(1)], d.min(1)
                yield b.assign(_cell=cell, _dist=dist_)

    cells_schema = T.StructType(idx.select("_id", label, "_v").schema.fields + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_dist", T.DoubleType())])
    idx = idx.select("_id", label, "_v").mapInPandas(assign, cells_schema)
    idx = cut_lineage(idx)
    info = {r["_cell"]: (r["n"], r["r"]) for r in idx.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("_dist").alias("r")).collect()}   # n_cells rows
    blocks = {c: max(1, -(-n // _BLOCK)) for c, (n, _) in info.items()}
    offs, total, room, top = {}, 0, 0, None
    for c in sorted(blocks, key=lambda c: (int(under[c]), c)):
        n = info[c][0]
        if blocks[c] == 1 and n <= room and top == under[c]:
            offs[c], room = total - 1, room - n                 # beside the cells before it
            continue
        offs[c], total, top = total, total + blocks[c], under[c]
        room = _BLOCK - n if blocks[c] == 1 else 0
    spread = F.create_map(*[F.lit(x) for c in blocks for x in (c, blocks[c])])
    start = F.create_map(*[F.lit(x) for c in offs for x in (c, offs[c])])
    idx = idx.withColumn("_block", (start[F.col("_cell")] + F.pmod(
        F.xxhash64("_id"), spread[F.col("_cell")])).cast("int")).select("_id", label, "_v", "_block")
    radius = np.full(len(pivots), -1.0)
    for c, (_, r) in info.items():
        radius[c] = r
    q_parts = max(1, -(-qry.count() // _BLOCK))
    first_block, n_blocks = np.zeros(len(pivots), "int64"), np.zeros(len(pivots), "int64")
    for c in blocks:
        first_block[c], n_blocks[c] = offs[c], blocks[c]

    def visit(first: bool):
        def fn(batches):
            for b in batches:
                if not len(b):
                    continue
                d = chord(np.stack(b["_v"].to_numpy()))
                d[:, radius < 0] = np.inf
                near = d.argmin(1)
                if first:
                    yield b.assign(_block=[offs[int(c)] for c in near])
                    continue
                ok = d - radius[None, :] <= b["_kth"].to_numpy()[:, None] + 1e-6
                # One copy for each block, however many of its cells are visited, and few copies at a time.
                ok &= np.isfinite(d)
                for part in np.array_split(np.arange(len(b)), max(1, len(b) * total // _COPIES)):
                    rows, cs = np.nonzero(ok[part])
                    reps = n_blocks[cs]
                    step = np.arange(reps.sum()) - np.repeat(reps.cumsum() - reps, reps)
                    both = np.unique(part[np.repeat(rows, reps)] * total + np.repeat(first_block[cs], reps) + step)
                    yield b.iloc[both // total].assign(_block=(both % total).astype("int32"))
        return fn

    label_type = idx.schema[label].dataType
    found = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_id", T.LongType()),
                          T.StructField("_label", label_type), T.StructField("_sim", T.DoubleType())])

    def best(q: pd.DataFrame, ix: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(ix):
            return pd.DataFrame({"_q": [], "_id": [], "_label": [], "_sim": []})
        x, y, ids, labels, out = np.stack(q["_v"].to_numpy()), np.stack(ix["_v"].to_numpy()).T, ix["_id"].to_numpy(), ix[label].to_numpy(), []
        qs, kk = q["_id"].to_numpy(), min(k, len(ix))
        for at in range(0, len(x), _ROWS):                      # the products of a few queries at a time
            sims = x[at:at + _ROWS] @ y
            near = np.round(sims, 12)
            kth = -np.partition(-near, kk - 1, axis=1)[:, kk - 1:kk]
            rows, cols = np.nonzero(near >= kth)                # all that ties at the cut, then by id
            order = np.lexsort((ids[cols], -near[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[place < kk], cols[place < kk]
            out.append(pd.DataFrame({"_q": qs[at + rows], "_id": ids[cols], "_label": labels[cols], "_sim": sims[rows, cols]}))
        return pd.concat(out, ignore_index=True)

    def search(q: DataFrame, ix: DataFrame) -> DataFrame:
        # A query part and an index block have at most _BLOCK expected rows each.
        qp = q.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(q_parts)).cast("int"))
        asked = qp.select(F.col("_block").alias("_b"), F.col("_part").alias("_p")).distinct()
        ip = ix.join(asked, F.col("_block") == F.col("_b")).select("_id", label, "_v", "_block", F.col("_p").alias("_part"))
        return qp.groupBy("_block", "_part").cogroup(ip.groupBy("_block", "_part")).applyInPandas(best, found)

    base = qry.select("_id", "_v")
    first_schema = T.StructType(base.schema.fields + [T.StructField("_block", T.IntegerType())])
    first_blocks = idx.where(F.col("_block").isin(list(offs.values())))
    seen = search(base.mapInPandas(visit(True), first_schema), first_blocks)
    kth = seen.groupBy("_q").agg(F.count(F.lit(1)).alias("_c"), F.min("_sim").alias("_s")).select(
        F.col("_q").alias("_id"), F.when(F.col("_c") >= k, F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("_s"))))
        .alias("_kth"))
    bounded = base.join(kth, "_id", "left").select("_id", "_v", F.coalesce("_kth", F.lit(4.0)).alias("_kth"))
    second_schema = T.StructType(bounded.schema.fields + [T.StructField("_block", T.IntegerType())])
    hits = search(bounded.mapInPandas(visit(False), second_schema), idx)
    # k rows per visited block and query
    w = Window.partitionBy("_q").orderBy(F.round("_sim", 12).desc(), F.col("_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("_q").alias(key), F.col("rank").cast("long").alias("rank"), F.col("_id").alias("neighbour"),
        F.col("_label").alias(label), F.col("_sim").alias("similarity"))
