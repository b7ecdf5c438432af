"""Exact search of the largest inner products with ball trees.

Rows are dealt over shards of near vectors, and each shard's rows form a ball
tree.  No row of a ball with centre ``c`` and radius ``r`` has an inner product
with ``q`` above ``q.c + |q| r``.  A query visits shards in the order of that
bound, in waves of growing size; the score of its k-th best row so far goes
with it from wave to wave, and a ball whose bound is below it is left out: a
whole shard before its rows are touched, else a node of its tree.  Inside a
shard the open leaves are visited in the order of their bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_groups

#: Rows of one shard and queries of one block, about.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 4_096
#: Shard centres: at most so many, fitted on at most so many vectors (of least
#: hash).  They decide only where rows go; a centre with more rows than a shard
#: holds has several shards.
CENTRES, SAMPLE = 256, 8_192
LEAF = 64
#: Shards of one wave, as a multiple of the wave before.
WIDEN = 4
#: Sums of whole numbers up to here are exact in doubles.
EXACT = 2.0 ** 52
_LONG = (1 << 63) - 1


def whole_numbers(column: pa.ListArray, scale: float) -> list[bytes | None]:
    """floor(scale * x) of each vector as bytes: 32-bit integers where they
    all fit, else doubles; None where one is not finite."""
    offsets = column.offsets.to_numpy()
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        x = flat[a:b]
        if not np.isfinite(x).all():
            out.append(None)
        elif len(x) and abs(x).max() >= 1 << 31:
            out.append((x + 0.0).astype("<f8").tobytes())  # + 0.0: no negative zero
        else:
            out.append(x.astype("<i4").tobytes())
    return out


def matrix(column, d: int) -> np.ndarray:
    """The vectors of a column of :func:`whole_numbers`, each of ``d`` numbers."""
    rows = column.to_pylist()
    if all(len(r) == 4 * d for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), d).astype(np.float64)
    return np.array([np.frombuffer(r, "<i4" if len(r) == 4 * d else "<f8") for r in rows], np.float64).reshape(len(rows), d)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers; one outside a long's
    range is the nearest long."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    with np.errstate(over="ignore"):
        most = np.sqrt((q * q).sum(1).max() * (x * x).sum(1).max())
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q).dot(whole(x).T) if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x balls) of inner products, widened by more than
    their rounding errors; infinite where doubles overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((q * q).sum(1))[:, None]
        reach = np.sqrt((centre * centre).sum(1)) + radius
        out = q @ centre.T + length * radius + 1e-9 * length * reach + 1e-3
    return np.where(np.isnan(out), np.inf, out)


class BallTree:
    """Nested balls over rows: ``levels`` holds, from the root on, (centre,
    radius, number of the parent in the level above); ``leaves`` the rows of
    each node of the last level."""

    def __init__(self, x: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        groups, parents = [np.arange(len(x))], np.zeros(1, np.int64)
        self.levels = []
        for level in range(depth + 1):
            centre = np.array([x[g].mean(0) for g in groups])
            radius = np.array([self._far(x[g], c).max() for g, c in zip(groups, centre)])
            self.levels.append((centre, radius * (1 + 1e-9), parents))
            if level < depth:
                halves = [h for g, c in zip(groups, centre) for h in self._halves(x, g, c)]
                parents = np.repeat(np.arange(len(groups)), 2)
                groups = halves
        self.leaves = groups

    @staticmethod
    def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.sqrt(((x - c) ** 2).sum(1))
        return np.where(np.isnan(far), np.inf, far)

    def _halves(self, x: np.ndarray, g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves of a node along the line between two far rows."""
        a = x[g[self._far(x[g], c).argmax()]]
        b = x[g[self._far(x[g], a).argmax()]]
        with np.errstate(over="ignore", invalid="ignore"):
            along = np.nan_to_num(x[g] @ (b - a))
        order = np.argpartition(along, len(g) // 2)
        return g[order[:len(g) // 2]], g[order[len(g) // 2:]]


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, kth: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) triples: each query's ``k`` best rows with another
    id than its own and a score of at least ``kth``, where there are so many."""
    kth = kth.astype(np.float64)
    open_ = np.ones((len(q), 1), bool)
    for centre, radius, parent in tree.levels:
        bound = bounds(q, centre, radius)
        open_ = open_[:, parent] & (bound >= kth[:, None])
    bound = np.where(open_, bound, -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), -1, np.int64)  # row numbers
    score = np.zeros((len(q), k), np.int64)
    for step in range(order.shape[1]):
        leaf = order[:, step]
        top = bound[np.arange(len(q)), leaf]
        active = np.flatnonzero((top >= kth) & (top > -np.inf))
        if not len(active):
            break
        active = active[np.argsort(leaf[active], kind="stable")]
        for some in np.split(active, np.flatnonzero(np.diff(leaf[active])) + 1):
            rows = tree.leaves[leaf[some[0]]]
            got = products(q[some], x[rows])
            new = (got >= kth[some, None]) & (ids[rows] != own[some, None])
            hit = new.any(1)
            some, got, new = some[hit], got[hit], new[hit]
            if not len(some):
                continue
            # the best so far and the leaf's rows, by score, then by id
            row = np.concatenate([best[some], np.where(new, rows, -1)], axis=1)
            value = np.concatenate([score[some], got], axis=1)
            there = row >= 0
            rank = np.lexsort((ids[row], ~value, ~there), axis=1)[:, :k]  # ~v = -v - 1: descending
            best[some] = np.take_along_axis(row, rank, 1)
            score[some] = np.take_along_axis(value, rank, 1)
            full = best[some, -1] >= 0
            kth[some[full]] = np.maximum(kth[some[full]], _below(score[some[full], -1]))
    at, place = np.nonzero(best >= 0)
    return at, best[at, place], score[at, place]


def _below(score: np.ndarray) -> np.ndarray:
    """Doubles not above the integers."""
    near = score.astype(np.float64)
    return np.where(abs(near) < EXACT, near, np.nextafter(near, -np.inf))


def fit_centres(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres by a few rounds of k-means, from rows at even steps."""
    centre = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(8):
        part = _nearest(x, centre)
        size = np.bincount(part, minlength=len(centre))
        for p in np.flatnonzero(size):
            centre[p] = x[part == p].mean(0)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((centre * centre).sum(1) - 2 * (x @ centre.T)).argmin(1)


def largest_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id",
                     vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every``, the ``k`` other rows of largest inner product of the vectors
    floor(scale * x), largest first, ties to the smaller id; all others, if
    they are fewer.  The result is exact.

    Vectors that are null or hold a null or non-finite component (also after
    scaling) take no part, neither do rows with a null id.  A query meets the
    vectors of its own length only; vectors without components have the score
    0.  Of rows with equal ids each is a candidate, except for queries of that
    id; of queries with equal ids the vector of least hash counts.  A score
    outside a long's range counts as the nearest long.  Other columns are not
    read; no vectors give no rows.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    given = (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
             .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite))

    def encode(batches):
        for batch in batches:
            x = pa.array(whole_numbers(batch.column(1), scale), pa.binary())
            size = [len(r) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), x], ["id", "d", "x"])

    rows = given.mapInArrow(encode, "id long, d int, x binary").where("x is not null")
    # equal vectors: no more than the k + 1 least ids can be among the k best of a query
    copies = rows.groupBy("d", "x", "id").agg(F.count(F.lit(1)).alias("times"))
    least = Window.partitionBy("d", "x").orderBy("id")
    kept = stored(copies.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
                  .select("id", "d", "x", "times"), "topk-vectors")
    result = "query_id long, rank int, vec_id long, score long"
    common = kept.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], result)
    d, n = common["d"], common["count"]
    sample = kept.where(F.col("d") == d).orderBy(F.xxhash64("x"), "id").limit(SAMPLE).select("x").toArrow()
    centres = fit_centres(matrix(sample.column("x"), d), min(CENTRES, -(-n // shard_rows)))

    def place(batches):
        for batch in batches:
            sizes, xs = np.array(batch.column(1)), batch.column(2)
            at, far = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            usual = np.flatnonzero(sizes == d)
            if len(usual):
                x = matrix(xs.take(pa.array(usual)), d)
                at[usual] = _nearest(x, centres)
                far[usual] = BallTree._far(x, centres[at[usual]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)],
                                             [*batch.schema.names, "centre", "far"])

    placed = stored(kept.mapInArrow(place, "id long, d int, x binary, times long, centre int, far double"), "topk-placed")
    per_centre = stored(placed.groupBy("d", "centre").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards"), F.max("far").alias("radius"))
        .select(F.concat_ws("-", "d", "centre").alias("ball"), "*"), "topk-balls")
    radius = np.zeros(len(centres))
    for r in per_centre.where(F.col("d") == d).collect():  # at most CENTRES rows
        radius[r["centre"]] = r["radius"] * (1 + 1e-9)
    used = np.array(sorted(r["centre"] for r in per_centre.where(F.col("d") == d).select("centre").collect()), np.int64)

    ball = F.concat_ws("-", "d", "centre").alias("ball")
    index = placed.select(ball, "id", "x", "times")
    one = Window.partitionBy("id").orderBy(F.xxhash64("x"), "x")
    queries = stored(rows.where(F.col("id") % every == 0).withColumn("nth", F.row_number().over(one))
                     .where("nth = 1").drop("nth"), "topk-queries")

    def route(first: int, last: int):
        def run(batches):
            for batch in batches:
                sizes, kth = np.array(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False)
                usual = np.flatnonzero(sizes == d)
                other = np.flatnonzero(sizes != d) if first == 0 else np.zeros(0, np.int64)
                x = matrix(batch.column(2).take(pa.array(usual)), d)
                bound = bounds(x, centres[used], radius[used])
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                wanted = np.take_along_axis(bound, order, 1) >= kth[usual, None]
                at, place = np.nonzero(wanted)
                row = np.concatenate([usual[at], other])
                centre = np.concatenate([used[order[at, place]], np.zeros(len(other), np.int64)])
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{a}-{c}" for a, c in zip(sizes[row].tolist(), centre.tolist())], pa.string()),
                     part.column(0), part.column(1), part.column(2), part.column(3)], ["ball", "id", "d", "x", "kth"])
        return run

    def shard_best(q: pa.Table, r: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64),) * 4
        if q.num_rows and r.num_rows:
            size = q.column("d")[0].as_py()
            x, ids = matrix(r.column("x"), size), r.column("id").to_numpy()
            own = q.column("id").to_numpy()
            at, row, score = search(BallTree(x), x, ids, matrix(q.column("x"), size), own, q.column("kth").to_numpy(), k)
            out = own[at], ids[row], r.column("times").to_numpy()[row], score
        return pa.table(dict(zip(["query_id", "vec_id", "times", "score"], out)))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    first, width = 0, 1
    while first < max(1, len(used)):
        asked = queries
        if best is not None:  # the current k-th score of each query
            kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("many"), F.min("score").alias("kth"))
            asked = queries.join(kth.where(F.col("many") >= k).select(F.col("query_id").alias("id"), "kth"), "id", "left")
            near = F.col("kth").cast("double")
            near = F.when(F.abs(near) < EXACT, near).otherwise(near - F.abs(near) * 1e-15)  # not above the score
            asked = asked.withColumn("kth", F.coalesce(near, F.lit(float("-inf"))))
        else:
            asked = queries.withColumn("kth", F.lit(float("-inf")))
        routed = stored(asked.select("id", "d", "x", "kth").mapInArrow(
            route(first, first + width), "ball string, id long, d int, x binary, kth double"), "topk-wave")
        first, width = first + width, width * WIDEN
        open_balls = (routed.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("blocks"))
                      .join(per_centre.select("ball", "shards"), "ball"))
        if routed.isEmpty():  # bounds fall from wave to wave: nothing is open later either
            break
        left = with_groups(routed, open_balls, "ball").select(
            "ball", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "id", "d", "x", "kth")
        right = with_groups(index, open_balls, "ball").select(
            "ball", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("x", "id"), "shards").cast("int").alias("shard"), "id", "x", "times")
        keys = ["ball", "block", "shard"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            shard_best, "query_id long, vec_id long, times long, score long")
        found = found if best is None else found.unionByName(best)
        best = stored(found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k).drop("nth"),
                      "topk-best")
    if best is None:
        return spark.createDataFrame([], result)
    repeated = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    return (repeated.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
