"""Set-similarity join on word n-grams: universe partition and pigeonhole, exact.

A document is the set of its distinct n-word shingles. Two sets of sizes s <= l whose
Jaccard is at least t differ in at most (1-t)/(1+t) (s+l) elements. For a band of
sizes this gives a bound H; the universe is cut by hash in H+1 segments, so of two
linked sets some segment is equal in both. Sets are joined on (band, segment, content).

Allocation by cost. Each segment may miss one difference (a key of its content), none
(no key) or two (its content and every content with one element deleted). An empty
segment's key would be shared by all sets that are empty there, the costliest list of all, so it
gets no key, and its partner segment gets the one-deletion neighbourhood in turn: the
bound still holds. Where both partners are empty, the pair has the keys of one element deleted to
nothing, which all sets have that are empty in one partner and hold one element in the other.

Work per key stays linear in the group: equal sets are one class from the start, and
only the component of a document is asked for. First each class is verified against
the smallest class that shares a key with it, and links are closed to components. Then,
for keys that still hold several components, members are verified against the key's
smallest class, and at last the pairs of different components that remain, where the
sizes allow a link: as rows in keys of few members, and block against block in larger
ones, where a pair of blocks gives no more rows than it merges components. Every pair that
shares a key is thus verified, ruled out by its counts or already connected. Sets that are all close to each other but
mostly not linked are compared with one another in any exact method; that work, inside such a
group, is the one that grows with the square of its size, and it runs in bounded blocks over
many tasks.

Counts before sets. Each set has a row of counts, a bin for about four shingles. The counts of
two sets differ, summed over the bins, by no more than the sets do, so a pair whose counts differ
by more than a link allows is no link. Pairs, and members of large keys, are tried by
their counts first; only what these leave open is compared by the sets themselves.

Shingles are compared as 64-bit hashes (two different shingles of a pair of documents
are taken for equal with a chance of about 1e-13 for sets of a thousand).

Null or empty texts have n_shingles 0 and are linked with nothing. A row with a null
id is returned with its n_shingles and a null component and links nothing. Repeated rows
are equal sets: one component. An empty table gives an empty result. Other columns are
not read, so they may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairs import clusters
from ..session import scratch_path, store
from .common import SPACE, few_rows_a_batch, mix, slices, text_buffers, word_hashes

GROWTH = Fraction(3, 2)      # sizes of a band: from b to under b * GROWTH
FEW = 32                     # members of a key that are compared pair by pair as rows
BLOCK_SHINGLES = 1 << 16     # shingles of a block of members of a larger key
VOCABULARY = 1 << 14         # shingles that one step of comparing two blocks takes
BLOCK_COUNTS = 1 << 17       # bins of a block of members whose counts are compared
LEAST_BINS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Bands:
    """Size bands and their number of segments for one threshold (a fraction of 100)."""

    def __init__(self, percent: int):
        self.t = Fraction(percent, 100)
        self.edges = [1]

    def of(self, n: int) -> int:
        """Band of a size: the sizes from edges[b] to under edges[b + 1]."""
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, math.floor(self.edges[-1] * GROWTH)))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def differences(self, band: int) -> int:
        """Largest symmetric difference of a linked pair whose smaller set is in the band."""
        self.of(self.edges[band])
        s = self.edges[band + 1] - 1
        return math.floor((1 - self.t) / (1 + self.t) * (s + math.floor(s / self.t)))

    def joined(self, n: int) -> list[int]:
        """Bands in which a set of this size may be the smaller or the larger of a linked pair."""
        return list(range(self.of(math.ceil(self.t * n)), self.of(n) + 1))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        tokens, first = word_hashes(data, offsets[a:b + 1], SPACE)
        count = np.diff(first)
        rolled = np.zeros(max(0, len(tokens) - words + 1), np.uint64)
        for i in range(words):
            rolled = mix(rolled * _ODD + tokens[i:len(tokens) - words + 1 + i]) if len(rolled) else rolled
        for row in range(b - a):
            n, at = int(count[row]), int(first[row])
            if n >= words:
                yield np.unique(rolled[at:at + n - words + 1])
            elif n:
                whole = np.array([n], np.uint64)     # a short text is one shingle of all its words
                for i in range(at, at + n):
                    whole = mix(whole * _ODD + tokens[i])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def segment_keys(value: np.ndarray, segment: np.ndarray, m: int, seed: np.uint64) -> list[np.ndarray]:
    """Keys of one set in one band, of whose hashes each lies in a segment of m."""
    order = np.argsort(segment, kind="stable")
    size = np.bincount(segment, minlength=m)
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, value)
    name = mix(np.arange(m, dtype=np.uint64) * _ODD + seed)
    out = [mix(total + name)[size > 0]]
    ends = np.cumsum(size)
    for s in np.flatnonzero(size == 0).tolist():
        partner = s ^ 1
        members = value[order[ends[partner] - size[partner]:ends[partner]]]
        extra = np.append(total[partner] - members, total[partner])      # an empty partner: as one element less of one
        out.append(mix(extra + name[partner] + np.uint64(13 + s)))
    return out


def keys_of(sets: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of one sorted set in all bands where it may find a partner."""
    out = []
    for band in bands.joined(len(sets)) if len(sets) else ():
        most = bands.differences(band)
        if not most:
            continue                                 # only equal sets: those are one class already
        m = most + 1 + (most + 1) % 2                # an even number: each segment has a partner
        seed = np.uint64((band * 0x2545F4914F6CDD1D + 1) & (1 << 64) - 1)
        value = mix(sets ^ mix(np.array([seed]))[0])
        segment = ((value >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        out += segment_keys(value, segment, m, seed)
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _digest(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n and a 128-bit print of the set of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix(s ^ _ODD).sum(dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                 pa.array(np.array(two, np.uint64).view(np.int64))], names=["id", "n", "fp1", "fp2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        run, "id long, n long, fp1 long, fp2 long")


def _keys(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """id and its join keys, for every row with an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            keys = [keys_of(s, bands) for s in shingle_sets(batch.column(1), words)]
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(
                    np.concatenate([np.zeros(0, np.int64), *keys])))], names=["id", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).where("id is not null").mapInArrow(
        run, "id long, keys array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """key, id, pivot (the key's smallest id) of keys with two ids or more.

    Nearly all keys have one id, and there are far more keys than words: they are exchanged once and stored nowhere.
    """
    w = Window.partitionBy("key")
    return keyed.withColumns({"pivot": F.min("id").over(w), "top": F.max("id").over(w)}).where("pivot < top").select(
        "key", "id", "pivot").distinct()


def counts_of(sets: np.ndarray) -> bytes:
    """Shingles by the low bits of their hashes, a byte for each bin (255: or more)."""
    bins = max(LEAST_BINS, 1 << (max(1, len(sets) // 4) - 1).bit_length())
    at = (sets & np.uint64(bins - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=bins), 255).astype(np.uint8).tobytes()


def _narrowed(counts: np.ndarray, bins: int) -> np.ndarray:
    """Rows of counts in fewer bins: those of equal low bits are added."""
    return counts.reshape(len(counts), -1, bins).sum(axis=1, dtype=np.int32)


def _table(rows: list[bytes]) -> np.ndarray:
    """Counts of one width as rows of a matrix."""
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def may_link(nx: np.ndarray, ny: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """False where sets of these sizes, whose counts are so far apart, can't be linked."""
    return 100 * (nx + ny - apart) >= percent * (nx + ny + apart)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n, the shingle hashes and their counts, of the documents in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(shingle_sets(batch.column(1), words))
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64))),
                 pa.array(list(map(len, got)), pa.int64()), pa.array(map(counts_of, got), pa.binary())],
                names=["id", "shingles", "n", "counts"])

    few = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        ids, "id", "left_semi").dropDuplicates(["id"])
    return few.mapInArrow(run, "id long, shingles array<long>, n long, counts binary")


def _near_by_counts(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose counts do not rule out a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ok = np.zeros(len(batch), bool)
            width = np.array([list(map(len, x)), list(map(len, y))])
            for wx, wy in np.unique(width, axis=1).T.tolist() if len(batch) else ():
                rows = np.flatnonzero((width[0] == wx) & (width[1] == wy))
                w = min(wx, wy)
                apart = np.abs(_narrowed(_table([x[i] for i in rows]), w) - _narrowed(_table([y[i] for i in rows]), w)).sum(axis=1)
                ok[rows] = may_link(nx[rows], ny[rows], apart, percent)
            yield batch.select([0, 1]).filter(pa.array(ok))

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("nx"), F.col("counts").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("ny"), F.col("counts").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = store(_near_by_counts(pairs, sets, percent), scratch_path(pairs.sparkSession, "jaccard-pairs"))
    return near.join(left, "a").join(right, "b").where(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _merges(x: list[np.ndarray], cx: list[int], y: list[np.ndarray], cy: list[int], percent: int) -> list[tuple[int, int]]:
    """Linked places (in x, in y) that join different components: a spanning forest of those links."""
    nx, ny = np.array(list(map(len, x))), np.array(list(map(len, y)))
    xs, ys = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(xs, ys)
    both = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(common), VOCABULARY):
        words = common[at:at + VOCABULARY]
        dense = []
        for values, sizes in ((xs, nx), (ys, ny)):
            place = np.minimum(np.searchsorted(words, values), len(words) - 1)
            hit = words[place] == values
            m = np.zeros((len(sizes), len(words)), np.float32)
            m[np.repeat(np.arange(len(sizes)), sizes)[hit], place[hit]] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    ok = (100 * both >= percent * (nx[:, None] + ny[None] - both)) & (np.array(cx)[:, None] != np.array(cy)[None])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(ok)):
        a, b = root(cx[i]), root(cy[j])
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def _block_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """key, x, y: the ``columns`` of the members of two of a key's blocks, for each pair of its blocks.

    A key's members are dealt to ``blocks`` blocks, so that none is larger than about the bound
    that number was made for.
    """
    blocks = rows.withColumn("_b", F.pmod(F.xxhash64("id"), "blocks")).groupBy("key", "_b").agg(
        F.collect_list(F.struct(*columns)).alias("m"))
    left, right = blocks.alias("l"), blocks.alias("r")
    return left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l._b") <= F.col("r._b"))).select(
        F.col("l.key"), F.col("l.m").alias("x"), F.col("r.m").alias("y"))


def _by_width(cell: pa.Scalar) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, components, sizes and counts of a block's members, by the width of the counts."""
    ids, cs, ns, counts = (c.to_pylist() for c in cell.values.flatten())
    out: dict[int, list[int]] = {}
    for i, row in enumerate(counts):
        out.setdefault(len(row), []).append(i)
    return {w: (np.array(ids)[rows], np.array(cs)[rows], np.array(ns)[rows], _table([counts[i] for i in rows]))
            for w, rows in out.items()}


def _open_by_counts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id) of members that have a partner in the key, of another component, that counts do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                found: set[int] = set()
                left, right = _by_width(batch.column(1)[r]), _by_width(batch.column(2)[r])
                for wx, (ix, cx, nx, x) in left.items():
                    for wy, (iy, cy, ny, y) in right.items():
                        w = min(wx, wy)
                        xs, ys = _narrowed(x, w), _narrowed(y, w)
                        for i in range(len(ix)):
                            try_ = np.flatnonzero((cy != cx[i]) & may_link(nx[i], ny, np.abs(ny - nx[i]), percent))
                            hit = try_[may_link(nx[i], ny[try_], np.abs(ys[try_] - xs[i]).sum(axis=1), percent)]
                            if len(hit):
                                found.add(int(ix[i]))
                                found.update(iy[hit].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[r].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["key", "id"])

    rows = members.join(sets.select("id", "counts"), "id")
    return _block_pairs(rows, "id", "c", "n", "counts").mapInArrow(run, "key long, id long").distinct()


def _in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside keys of many members.

    Each pair of blocks is one row, compared at once, and gives no more links than it merges components.
    """
    pairs = _block_pairs(members.join(sets.select("id", "shingles"), "id"), "id", "c", "shingles").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                side = []
                for c in (0, 1):
                    ids, cs, lists = batch.column(c)[r].values.flatten()
                    ends = lists.offsets.to_numpy()
                    values = lists.values.to_numpy(zero_copy_only=False)
                    side.append((ids.to_numpy(), cs.to_pylist(), [values[a:b] for a, b in zip(ends, ends[1:])]))
                (ia, ca, xa), (ib, cb, xb) = side
                got = _merges(xa, ca, xb, cb, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ia[i] for i, _ in got], pa.int64()), pa.array([ib[j] for _, j in got], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links).

    Two rows are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        return store(df, scratch_path(spark, f"jaccard-{name}"))

    digest = kept(_digest(docs, id_col, text_col, words), "digest")
    row = ["fp1", "fp2", "n"]
    classes = kept(digest.where("n > 0 and id is not null").groupBy(*row).agg(F.min("id").alias("rep")), "classes")
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    keys = _keys(docs, id_col, text_col, words, percent).join(sizes.select("id"), "id", "left_semi")
    near = kept(_shared(keys.select(F.explode("keys").alias("key"), "id")).join(sizes, "id"), "near")

    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    sets = kept(_sets(docs, near.select("id").distinct(), id_col, text_col, words), "sets")

    first = near.where("pivot < id").groupBy("id").agg(F.min("pivot").alias("b"))
    links = kept(_verified(first.select(F.col("id").alias("a"), "b"), sets, percent), "links1")

    def named(members: DataFrame, label: DataFrame) -> DataFrame:
        """``members`` with the components ``c`` that ``label`` joins under their new name."""
        return members.join(label.select(F.col("node").alias("c"), "cluster"), "c", "left").select(
            *(F.coalesce("cluster", "c").alias("c") if x == "c" else x for x in members.columns))

    def mixed(members: DataFrame, *more: Column) -> DataFrame:
        """The keys with several components."""
        of = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *more)
        return of.where("lo < hi").drop("lo", "hi")

    def sized(bound: int, n: Column) -> list[Column]:
        """Aggregates of a key: its number of members and of blocks, over members whose ``n`` is not null."""
        return [F.count(n).alias("size"), F.ceil(F.sum(n) / bound).alias("blocks")]

    def merged(found: DataFrame, members: DataFrame) -> DataFrame | None:
        """The closure of the components of ``members`` that the pairs link; None without a pair.

        It begins at the components that are known, so a pass joins few of them and ends after few rounds.
        """
        of = members.select("id", "c").distinct()
        pairs = found.join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(
            of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        pairs = kept(pairs.distinct(), "merged")
        return clusters(pairs) if pairs.take(1) else None

    # Steps read what is stored, so that no plan holds a step more than twice: that bounds the driver's work on it.
    labels = [clusters(links)]
    known = named(near.withColumn("c", F.col("id")), labels[0])
    open_ = kept(known.join(mixed(known), "key", "left_semi"), "open")
    pivots = open_.where("id = pivot").select("key", F.col("c").alias("pc"), F.col("n").alias("pn"))
    second = open_.join(pivots, "key").where((F.col("c") != F.col("pc")) & fits(F.col("n"), F.col("pn"))).select(
        F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    label = merged(_verified(second, sets, percent), open_)
    if label is not None:
        labels.append(label)
        open_ = named(open_, label)

    others = F.when(F.col("id") != F.col("pivot"), F.col("n"))
    rest = kept(open_.where("id <> pivot").drop("pivot").join(mixed(open_, *sized(BLOCK_COUNTS, others)), "key"), "rest")
    with few_rows_a_batch(spark):
        tried = kept(_open_by_counts(rest.where(F.col("size") > FEW), sets, percent), "tried")
    left = rest.drop("size", "blocks").join(tried, ["key", "id"], "left_semi")
    large = kept(left.join(left.groupBy("key").agg(*sized(BLOCK_SHINGLES, F.col("n"))), "key"), "large")
    few = rest.where(F.col("size") <= FEW).unionByName(large.where(F.col("size") <= FEW))
    one, two = few.alias("p"), few.alias("q")
    third = one.join(two, (F.col("p.key") == F.col("q.key")) & (F.col("p.id") > F.col("q.id"))
                     & (F.col("p.c") != F.col("q.c")) & fits(F.col("p.n"), F.col("q.n"))).select(
        F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    third = kept(_verified(third, sets, percent), "third")
    with few_rows_a_batch(spark):
        blocks = kept(_in_blocks(large.where(F.col("size") > FEW), sets, percent), "blocks")
    label = merged(third.unionByName(blocks), rest)
    if label is not None:
        labels.append(label)

    component = classes.withColumn("c", F.col("rep"))
    for label in labels:
        component = named(component, label)
    component = component.select(*row, "c")
    out = digest.select("id", *row).join(component, row, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
