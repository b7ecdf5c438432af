"""Approximate nearest neighbours through learned partitions.

On a bounded sample: the graph of nearest neighbours by inner product is cut
into balanced parts by recursive spectral bisection with swaps, and a small
classifier learns, from a vector's direction and length, how its neighbours are
spread over the parts.  Every row is put into its most probable part.  A second
classifier learns from a query's direction alone (its length changes no order)
in which parts the rows that it looks for have been put; a query visits its
most probable parts until they hold ``MASS`` of its probability, and the rows
found there are ranked by their exact inner product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that the parts and the classifier are fitted on, at most: those
#: whose id has the least hash.
SAMPLE = 8_000
NEIGHBOURS = 15
PARTS, HIDDEN, EPOCHS = 32, 128, 60
MASS = 0.95
#: Rows and queries of one block of the exact ranking.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` rows of largest inner product, without itself."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Halves of equal size with few graph links between them: mask over
    ``nodes``.  ``left``/``right``: links as positions in ``nodes``."""
    n = len(nodes)
    degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n) + 1e-9
    root = np.sqrt(degree)
    v = np.cos(np.arange(n) * 2.399963)  # any start that is not constant
    for _ in range(80):  # second eigenvector of the normalised links, by power iteration
        v -= root * (root @ v) / (root @ root)
        u = v / root
        v = 0.5 * v + 0.5 * (np.bincount(left, u[right], n) + np.bincount(right, u[left], n)) / root
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2:]] = True
    for _ in range(6):  # swaps of equal numbers that cut fewer links
        s = np.where(side, 1.0, -1.0)
        pull = (np.bincount(left, s[right], n) + np.bincount(right, s[left], n)) * s  # own side less the other
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(pull[a], kind="stable")], b[np.argsort(pull[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int((pull[a[:m]] + pull[b[:m]] < 0).sum()) // 2
        if not swap:
            break
        side[a[:swap]], side[b[:swap]] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node; sizes differ by a few nodes at most."""
    n = len(graph)
    left, right = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            nodes = np.flatnonzero(part == p)
            if len(nodes) < 2:
                continue
            at = np.full(n, -1)
            at[nodes] = np.arange(len(nodes))
            inside = (at[left] >= 0) & (at[right] >= 0)
            part[nodes[bisect(nodes, at[left[inside]], at[right[inside]])]] += size
        size *= 2
    return part


@dataclass
class Net:
    """Probabilities of the parts from some numbers, by one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _polar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and logarithms of the lengths."""
    most = abs(x).max(1, keepdims=True)
    x = x / most
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / length, np.log(most) + np.log(length)


@dataclass
class Router:
    """Parts of rows (by direction and length) and of what queries look for."""

    rows: Net
    queries: Net
    centre: float
    spread: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        direction, size = _polar(x)
        # lengths that are all but equal say nothing
        size = (size - self.centre) / self.spread if self.spread > 1e-3 else np.zeros_like(size)
        return np.hstack([direction, np.clip(size, -10, 10)])

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.rows(self.inputs(x)).argmax(1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.queries(_polar(x)[0])


def _new_net(d: int, parts: int, rng) -> Net:
    return Net(rng.normal(0, (2 / d) ** 0.5 * 2, (d, HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, 0.05, (HIDDEN, parts)), np.zeros(parts))


def fit_net(x: np.ndarray, target: np.ndarray, rng) -> Net:
    n, d = x.shape
    net = _new_net(d, target.shape[1], rng)
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        for a in range(0, n, 256):
            rows = np.arange(a, min(n, a + 256))
            h = np.maximum(x[rows] @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (dz @ params[2].T) * (h > 0)
            grads = [x[rows].T @ dh + 1e-5 * params[0], dh.sum(0), h.T @ dz + 1e-4 * params[2], dz.sum(0)]
            t += 1
            rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
            for i, g in enumerate(grads):  # Adam
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return net


def fit_router(x: np.ndarray, parts: int = PARTS) -> Router:
    """Parts of the sample ``x`` and the classifiers that find them."""
    x = np.unique(x, axis=0) * 1.0
    n, d = x.shape
    rng = np.random.default_rng(0)
    x = x[rng.permutation(n)]
    while parts > 1 and n < 4 * parts:
        parts //= 2
    size = _polar(x)[1]
    router = Router(_new_net(d + 1, parts, rng), _new_net(d, parts, rng), float(size.mean()), float(size.std()))
    if parts == 1:
        return router
    k = min(NEIGHBOURS, n - 1)
    graph = nearest(x, k)

    def spread_over(part: np.ndarray) -> np.ndarray:
        target = np.zeros((n, parts))
        np.add.at(target, (np.repeat(np.arange(n), k), part[graph.ravel()]), 1 / k)
        return target

    router.rows = fit_net(router.inputs(x), spread_over(balanced_parts(graph, parts)), rng)
    # queries learn where rows are put, not where the cut had them
    router.queries = fit_net(_polar(x)[0], spread_over(router.place(x)), rng)
    return router


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, d)


def exact_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query number, row number, score): the ``k`` best rows of each query,
    ties to smaller ids, without the query itself."""
    for i, (q, own) in enumerate(zip(queries, query_ids)):
        rough = rows @ q
        rough[row_ids == own] = -np.inf
        if len(rough) > k:
            least = np.partition(rough, len(rough) - k)[len(rough) - k]
            some = np.flatnonzero(rough >= least - 1e-9 * (1 + abs(least)))
        else:
            some = np.arange(len(rough))
        some = some[row_ids[some] != own]
        # each pair summed in the same way: equal vectors get equal scores
        score = (rows[some] * q).sum(1)
        best = np.lexsort((row_ids[some], -score))[:k]
        yield i, some[best], score[best]


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, mass: float = MASS, id_col: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by
    ``every``, the ``k`` rows found of largest inner product, nearest first,
    ties to the smaller id.  A query with fewer candidates gets all of them.

    Vectors that are null, zero, or hold a null or non-finite component take
    no part, neither do rows with a null id, nor vectors of another length than
    most.  Of rows with equal ids each is a candidate, except for queries of
    that id; of queries with equal ids the vector of least hash counts.  No
    vectors give no rows.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    finite = F.forall(F.col("v"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
                   & F.exists(F.col("v"), lambda e: e != 0)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    d = lengths["d"]
    rows = rows.where(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    router = fit_router(np.array(sample["v"].tolist(), float))
    shared = spark.sparkContext.broadcast(router)  # of fixed size

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).values.slice(batch.column(1).offsets[0].as_py(), batch.num_rows * d)
            x = x.to_numpy().reshape(-1, d)
            part = shared.value.place(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(part.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "part", "x"])

    index = stored(rows.mapInArrow(place, "id long, part int, x binary"), "ann-index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one number for each part
    blocks = {p: -(-n // BLOCK_ROWS) for p, n in sizes.items()}
    queries = index.where(F.col("id") % every == 0)
    n_queries = queries.count()

    def route(batches):
        size = np.zeros(shared.value.queries.w2.shape[1], np.int64)
        size[list(sizes)] = list(sizes.values())
        for batch in batches:
            if not batch.num_rows:
                continue
            p = shared.value.probabilities(_matrix(batch.column(2), d))
            order = np.argsort(-p, axis=1, kind="stable")
            got = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
            held = np.cumsum(size[order], axis=1)
            # parts before which the mass or the candidates weren't enough
            before = np.concatenate([np.zeros((len(p), 1)), got[:, :-1]], axis=1) < mass
            before |= np.concatenate([np.zeros((len(p), 1)), held[:, :-1]], axis=1) < k + 1
            q, c = np.nonzero(before)
            part = order[q, c]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(q)), pa.array(part.astype(np.int32)), batch.column(2).take(pa.array(q))],
                ["id", "part", "x"])

    routed = stored(queries.withColumn("least", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("x"))))
                    .where("least = 1").select("id", "part", "x").mapInArrow(route, "id long, part int, x binary"),
                    "ann-queries")
    # both sides in blocks of bounded size: rows by their hash, queries by theirs
    q_blocks = {r["part"]: -(-r["count"] // BLOCK_QUERIES) for r in routed.groupBy("part").count().collect()}
    per_part = spark.createDataFrame([(p, blocks[p], q_blocks.get(p, 1)) for p in sorted(blocks)],
                                     "part int, rb int, qb int") if blocks else None
    if per_part is None or not n_queries:
        return empty
    per_part = F.broadcast(per_part)  # a row for each part
    left = (routed.join(per_part, "part")
            .select("part", (F.pmod(F.xxhash64("id"), "qb")).cast("int").alias("qs"),
                    F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("rs"), "id", "x"))
    right = (index.join(per_part, "part")
             .select("part", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qs"),
                     (F.pmod(F.xxhash64("id", "x"), "rb")).cast("int").alias("rs"), "id", "x"))

    def rank(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [[], [], []]
        if q.num_rows and r.num_rows:
            q_ids, r_ids = q.column("id").to_numpy(), r.column("id").to_numpy()
            for i, found, score in exact_best(_matrix(q.column("x"), d), q_ids, _matrix(r.column("x"), d), r_ids, k):
                out[0] += [q_ids[i]] * len(found)
                out[1] += r_ids[found].tolist()
                out[2] += score.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    keys = ["part", "qs", "rs"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
