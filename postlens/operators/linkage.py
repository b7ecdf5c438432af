"""A tree of token groups, merged in rounds of reciprocal nearest pairs, and its
cuts at any number of groups.

IDs: EXP1 (learned groups), EXP5 (all counts from one tree).

The similarity of two groups is the mean over their pairs of the vectors'
cosine, which for vectors of length 1 is the product of the groups' mean
vectors.  With this measure a merged group is never nearer to a third than the
nearer of its parts was, so all pairs that are each other's nearest can merge
in one round, and the tree is the one that merging the single nearest pair each
time gives.  A group whose nearest did not merge keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.blocks import _whole
from postlens.session import forget, stored

#: Groups of one block of the search for nearest groups (of 16 numbers: 4 MB).
BLOCK = 32_768
#: So many groups, whatever the vocabulary's size, are merged in one task, which
#: holds their vectors and no matrix of pairs.
LAST_GROUPS = 65_536
#: Merges whose places are worked out in one task (100 MB); more take joins.
PLACES_AT_ONCE = 1 << 20
#: Rows and columns of a tile of similarities, which stays in a core's cache.
_TILE = (256, 2_048)
#: Rounds that merge fewer than this share of the groups are not worth another.
_FEW = 0.02
#: A merged group's number: its round above, the least leaf of it below.
_ROUND = 1 << 40
MERGES = "node long, l long, r long, similarity double, size long, l_size long, round int"


def unit_vectors(vectors: DataFrame, leaf: str = "leaf", vector: str = "vector") -> DataFrame:
    """(node, size, v, low): leaves with vectors of length 1; vectors that are
    null, of no length or hold something else than finite numbers are left out."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return (vectors.select(F.col(leaf).cast("long").alias("node"), F.col(vector).cast("array<double>").alias(vector))
            .withColumn("__n", norm).where((F.col("__n") > 0) & (F.col("__n") < float("inf")))
            .select("node", F.lit(1).cast("long").alias("size"), F.transform(vector, lambda x: x / F.col("__n")).alias("v"),
                    F.lit(float("inf")).alias("low")))


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    flat = _whole(table.column(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(table.num_rows, -1)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """What a product of two rows can be off by in single precision, and more."""
    longest = max((float(np.sqrt((x * x).sum(1).max(initial=0.0))) for x in (a, b)))
    return 1e-6 * (a.shape[1] + 8) * max(longest * longest, 1e-30)


def nearest_rows(a: np.ndarray, at: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, similarity) of each row's nearest row of ``b``, the first of equal
    ones (to 12 digits); not the row ``at`` of ``b``, which is the row itself, -1
    if none.  Tiles in single precision tell where the nearest can be; there the
    products are taken anew."""
    rows, columns = _TILE
    tiles = range(0, len(b), columns)
    top = np.full((len(a), len(tiles)), -np.inf, np.float32)
    small_a, small_b = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    for i in range(0, len(a), rows):
        for t, j in enumerate(tiles):
            s = small_a[i:i + rows] @ small_b[:, j:j + columns]
            mine = np.flatnonzero((at[i:i + rows] >= j) & (at[i:i + rows] < j + columns))
            s[mine, at[i:i + rows][mine] - j] = -np.inf
            s.max(axis=1, out=top[i:i + rows, t])
    best, place = np.full(len(a), -np.inf), np.full(len(a), -1)
    if not len(tiles):
        return place, best
    ask = top >= top.max(axis=1, keepdims=True) - np.float32(_slack(a, b))
    ask &= top > -np.inf
    for t, j in enumerate(tiles):  # in order: an equal one further on does not replace
        mine = np.flatnonzero(ask[:, t])
        for i in range(0, len(mine), rows):
            some = mine[i:i + rows]
            s = np.round(a[some] @ b[j:j + columns].T, 12)  # equal from both sides
            own = np.flatnonzero((at[some] >= j) & (at[some] < j + columns))
            s[own, at[some][own] - j] = -np.inf
            k = s.argmax(1)
            value = s[np.arange(len(s)), k]
            more = value > best[some]
            best[some[more]], place[some[more]] = value[more], k[more] + j
    return place, best


def _dealt(groups: DataFrame, n: int, side: str, other: str, others: int) -> DataFrame:
    """(side, other, nodes, vectors): ``n`` parts of the groups, packed in order
    of their numbers, each for all ``others``."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        return pa.table({side: table.column("part").slice(0, 1), "nodes": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
                         "vectors": pa.array([_matrix(table).tobytes()], pa.binary())})

    parts = groups.select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("part"), "node", "v").groupBy("part").applyInArrow(
        pack, f"{side} int, nodes binary, vectors binary")
    return parts.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def nearest_groups(asked: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """(node, other, similarity): each asked group's nearest other group, ties
    to the smaller number.  Packed parts meet packed parts; a part gives one row
    for each group that it is asked for, and the best is a partial aggregate."""
    parts = max(blocks, -(-2 * groups.sparkSession.sparkContext.defaultParallelism // blocks))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        node, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            (node, x), (ids, y) = ((np.frombuffer(t.column("nodes")[0].as_buffer(), np.int64),
                                    np.frombuffer(t.column("vectors")[0].as_buffer())) for t in (a, b))
            at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
            at = np.where(ids[at] == node, at, -1)
            place, score = nearest_rows(x.reshape(len(node), -1), at, y.reshape(len(ids), -1))
            there = place >= 0
            node, other, score = node[there], ids[place[there]], score[there]
        return pa.table({"node": node, "other": other, "similarity": score})

    left, right = _dealt(asked, parts, "lb", "rb", blocks), _dealt(groups, blocks, "rb", "lb", parts)
    found = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(
        best, "node long, other long, similarity double")
    top = F.max(F.struct("similarity", (-F.col("other")).alias("o")))
    return found.groupBy("node").agg(top.alias("t")).select("node", (-F.col("t.o")).alias("other"), "t.similarity")


def _merged(pairs: DataFrame, round_: int) -> DataFrame:
    """New groups from pairs (l, r, similarity and both sides' size, v, low)."""
    size = F.col("l_size") + F.col("r_size")
    mean = F.zip_with("l_v", "r_v", lambda x, y: (x * F.col("l_size") + y * F.col("r_size")) / size)
    return pairs.select((F.lit(round_ * _ROUND) + F.least(F.col("l") % _ROUND, F.col("r") % _ROUND)).alias("node"), "l", "r",
                        size.alias("size"), mean.alias("v"),
                        F.least("similarity", "l_low", "r_low").alias("low"), "l_size")


class _Last:
    """The last groups, which one task merges."""

    def __init__(self, node, size, low, v, first_round: int):
        self.node, self.size, self.low, self.v, self.round, self.out = node, size, low, v, first_round, []

    def rounds(self) -> None:
        """Reciprocal nearest pairs, as long as a round merges many."""
        near, top = np.full(len(self.node), -1), np.full(len(self.node), -np.inf)
        while len(self.node) > 1:
            stale = np.flatnonzero(near < 0)
            near[stale], top[stale] = nearest_rows(self.v[stale], stale, self.v)
            i = np.arange(len(near))
            i = i[(near[near] == i) & (i < near)]
            j = near[i]
            if not len(i):
                return
            low = np.minimum(top[i], np.minimum(self.low[i], self.low[j]))
            size = self.size[i] + self.size[j]
            node = self.round * _ROUND + np.minimum(self.node[i] % _ROUND, self.node[j] % _ROUND)
            v = (self.v[i] * self.size[i][:, None] + self.v[j] * self.size[j][:, None]) / size[:, None]
            self.out.append((node, self.node[i], self.node[j], low, size, self.size[i], np.full(len(i), self.round)))
            many, order = len(self.node), np.argsort(node)
            stays = np.ones(many, bool)
            stays[i] = stays[j] = False
            to = np.where(stays, np.cumsum(stays) - 1, -1)
            new = np.full(len(i), -1)
            # new numbers are above all others
            near, top = np.r_[to[near[stays]], new], np.r_[top[stays], new.astype(float)]
            self.node, self.size, self.low = (np.r_[x[stays], y[order]] for x, y in ((self.node, node), (self.size, size), (self.low, low)))
            self.v = np.concatenate([self.v[stays], v[order]])
            self.round += 1
            if len(i) < _FEW * many:
                return

    def chain(self) -> None:
        """From a group to its nearest and on to that one's, until two are each
        other's nearest: they merge, and the way goes on from where it was."""
        node, size, low, v = self.node, self.size, self.low, self.v
        slack = np.float32(_slack(v, v))
        small, alive, way = v.astype(np.float32), np.ones(len(node), bool), []
        left = len(node)
        while left > 1:
            if 2 * left < len(node):  # the dead rows go
                to = np.cumsum(alive) - 1
                way = [int(to[k]) for k in way]
                node, size, low, v, small, alive = (x[alive] for x in (node, size, low, v, small, alive))
            if not way:
                way.append(int(np.flatnonzero(alive)[0]))
            i = way[-1]
            s = small @ small[i]
            s[~alive] = s[i] = -np.inf
            could = np.flatnonzero(s >= s.max() - slack)
            exact = np.round(v[could] @ v[i], 12)
            first = could[exact == exact.max()]
            if len(way) > 1 and way[-2] in first:
                j, value = way[-2], float(exact.max())
                del way[-2:]
                i, j = sorted((i, j), key=lambda k: node[k])
                low[i] = min(value, low[i], low[j])
                new = self.round * _ROUND + min(node[i] % _ROUND, node[j] % _ROUND)
                self.out.append(tuple(np.array([x]) for x in (new, node[i], node[j], low[i], size[i] + size[j], size[i], self.round)))
                v[i] = (v[i] * size[i] + v[j] * size[j]) / (size[i] + size[j])
                small[i] = v[i]
                node[i], size[i], alive[j] = new, size[i] + size[j], False
                self.round += 1
                left -= 1
            else:
                way.append(int(first[node[first].argmin()]))


def _finish(first_round: int):
    """Merges the last groups."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        last = _Last(*(table.column(c).to_numpy().copy() for c in ("node", "size", "low")), _matrix(table).copy(), first_round)
        last.rounds()
        last.chain()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
        cols = [np.concatenate(c) for c in zip(*last.out)] or [np.zeros(0)] * 7
        return pa.table([pa.array(c).cast(k) for c, k in zip(cols, kinds)],
                        names=["node", "l", "r", "similarity", "size", "l_size", "round"])

    return run


def dendrogram(leaves: DataFrame, last_groups: int = LAST_GROUPS, block: int = BLOCK) -> DataFrame:
    """EXP1: merges (node, l, r, similarity, size, l_size, round) of the leaves
    of :func:`unit_vectors` (numbers from 0, below 2^40).

    ``similarity`` is that of the two sides, at most that of any merge below;
    ``size`` counts leaves, ``l_size`` those of the side ``l``.  ``n`` leaves
    give ``n - 1`` merges; one leaf or none gives none.  Leaves of equal vectors
    merge like others, ties go to smaller numbers.
    """
    spark = leaves.sparkSession
    groups = stored(leaves.select("node", "size", "v", "low"))
    merges = spark.createDataFrame([], MERGES)
    near, round_, gone_by = None, 1, []
    many = groups.count()
    while many > max(1, last_groups):
        blocks = -(-many // block)
        stale = groups if near is None else groups.join(near, "node", "anti")
        found = nearest_groups(stale, groups, blocks)
        known = near = stored(found if near is None else near.unionByName(found))
        back = near.select(F.col("node").alias("other"), F.col("other").alias("node"))
        pairs = near.join(back, ["node", "other"]).where(F.col("node") < F.col("other")) \
            .select(F.col("node").alias("l"), F.col("other").alias("r"), "similarity")
        side = {p: groups.select(F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("size", "v", "low")))
                for p in "lr"}
        new = stored(_merged(pairs.join(side["l"], "l").join(side["r"], "r"), round_))
        gone = new.select(F.explode(F.array("l", "r")).alias("node"))
        merges = merges.unionByName(new.select("node", "l", "r", F.col("low").alias("similarity"), "size", "l_size",
                                               F.lit(round_).alias("round")))
        before, groups = groups, stored(groups.join(gone, "node", "anti").unionByName(new.select("node", "size", "v", "low")))
        near = near.join(gone, "node", "anti").join(gone.withColumnRenamed("node", "other"), "other", "anti") \
            .select("node", "other", "similarity")
        # the last round's are read no more
        forget(spark, before, *gone_by)
        gone_by = [known]
        left = groups.count()
        if left == many:
            raise RuntimeError("no pair of groups is each other's nearest")
        many, round_ = left, round_ + 1
    if many > 1:  # at most ``last_groups`` rows
        last = groups.groupBy(F.lit(0).alias("one")).applyInArrow(_finish(round_), MERGES)
        merges = merges.unionByName(last)
    return stored(merges)


def _places_at_once(merges: pa.Table) -> pa.Table:
    l, r, node, l_size = (merges.column(c).to_numpy() for c in ("l", "r", "node", "l_size"))
    child, place, up = np.r_[l, r], np.r_[np.zeros_like(l_size), l_size], np.r_[node, node]
    order = np.argsort(child)
    child, place, up = child[order], place[order], up[order]
    at = np.minimum(np.searchsorted(child, up), max(len(child) - 1, 0))
    at = np.where(child[at] == up, at, -1)  # -1: the root
    while (at >= 0).any():
        place = place + np.where(at >= 0, place[at], 0)
        at = np.where(at >= 0, at[at], -1)
    return pa.table({"node": child, "place": place})


def places(merges: DataFrame, at_once: int = PLACES_AT_ONCE) -> DataFrame:
    """(node, place): interval labels.  The leaves of a group hold consecutive
    places, from the group's own on; the number of leaves in front is added up
    along the way to the root, in steps of doubling length."""
    if 0 < merges.count() <= at_once:
        return stored(merges.groupBy(F.lit(0).alias("one")).applyInArrow(_places_at_once, "node long, place long"))
    left = F.struct(F.col("l").alias("node"), F.lit(0).cast("long").alias("place"))
    right = F.struct(F.col("r").alias("node"), F.col("l_size").alias("place"))
    way = stored(merges.select(F.explode(F.array(left, right)).alias("c"), F.col("node").alias("up"))
                 .select("c.node", "up", "c.place"))
    while True:
        above = way.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        before, way = way, stored(way.join(above, "up", "left").select(
            "node", F.coalesce("next", "up").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
            F.col("next").isNotNull().alias("moved")))
        forget(merges.sparkSession, before)
        if way.where("moved").isEmpty():
            return way.select("node", "place")


def cuts(merges: DataFrame, counts) -> DataFrame:
    """EXP5: (node, num_clusters, cluster) of every leaf at each count.

    The last ``k - 1`` merges, undone, leave ``k`` groups; they are numbered in
    the order of their places, so the groups of a larger count lie inside those
    of a smaller one.  Fewer leaves than ``k`` are a group each.
    """
    counts = sorted(set(counts))
    each = F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in counts)).alias("k"), F.col("clusters").alias("c")))
    return cut_lists(merges, counts).select("node", each.alias("at")).select("node", F.col("at.k").alias("num_clusters"), F.col("at.c").alias("cluster"))


def cut_lists(merges: DataFrame, counts) -> DataFrame:
    """(node, clusters): :func:`cuts` with one row for each leaf, its clusters at
    the ``counts``, which are in order."""
    at = places(merges)
    top = merges.orderBy("similarity", F.desc("node")).limit(max(counts) - 1)
    from pyspark.sql import Window
    # fewer rows than the largest count
    ranked = top.withColumn("nth", F.row_number().over(Window.orderBy("similarity", F.desc("node"))))
    borders = [tuple(r) for r in ranked.select(F.col("r").alias("node"), "nth").join(at, "node").select("nth", "place").collect()]
    first = [np.array(sorted(place for nth, place in borders if nth < k), np.int64) for k in counts]

    def run(batches):
        for batch in batches:
            place = batch.column(1).to_numpy()
            found = np.stack([np.searchsorted(x, place, side="right") for x in first], 1).astype(np.int32)
            offsets = pa.array(np.arange(len(place) + 1, dtype=np.int32) * len(first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["node", "clusters"])

    return at.where(F.col("node") < _ROUND).mapInArrow(run, "node long, clusters array<int>")
