"""Token vectors from a table of co-occurrences; nothing as long as the
vocabulary reaches the driver.

IDs: FEA6.

Pairs of tokens at most ``window`` places apart are counted, weighted by
shifted positive pointwise mutual information, and the symmetric table is
factored by subspace iteration: the table is packed once in a grid of cells, the
tall matrix is multiplied with it part by part, and made orthonormal through its
small Gram matrix.  The driver sees matrices of ``dim`` by ``dim`` numbers only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators import blocks as BL
from postlens.operators.grid import from_parts, grid, mapped, summed, to_parts, unpacked
from postlens.operators.pairs import PairCells
from postlens.session import cut_lineage, forget, stored

OVERSAMPLE = 8


def pair_counts(rows: DataFrame, tokens: str = "tokens", window: int = 2, vocab: DataFrame | None = None) -> DataFrame:
    """(a, b, n) with a <= b: how often the tokens stand at most ``window``
    places apart in a row.  Pairs are made inside each row's own array and
    summed before they are shuffled.  Of rows stored in blocks with a ``vocab``,
    a and b are the ids of its tokens, and pairs with other tokens are left out:
    a block's pairs are summed as pairs of numbers."""
    if vocab is not None:
        return _id_pairs(rows, window, vocab)
    t, n = F.col(tokens), F.size(tokens)
    lists = [F.zip_with(F.slice(t, 1, F.greatest(n - d, F.lit(0))), F.slice(t, d + 1, F.greatest(n - d, F.lit(0))),
                        lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
             for d in range(1, window + 1)]
    return (rows.select(F.explode(F.concat(*lists)).alias("p")).select("p.a", "p.b")
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))


def _id_pairs(stored: DataFrame, window: int, vocab: DataFrame) -> DataFrame:
    def run(rows, known):
        row, toks = BL.tokens_of(rows)
        at = BL.places(toks, known.column("token"))
        ids = np.where(at >= 0, known.column("token_id").to_numpy()[at] if known.num_rows else -1, -1).astype(np.int64)
        pairs = []
        for d in range(1, window + 1):
            x, y = ids[:-d], ids[d:]
            there = (row[:-d] == row[d:]) & (x >= 0) & (y >= 0)
            pairs.append(np.minimum(x, y)[there] << 32 | np.maximum(x, y)[there])
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        return pa.table({"a": (pair >> 32).astype(np.int32), "b": (pair & 0xFFFFFFFF).astype(np.int32), "n": n.astype(np.int64)})

    each = BL.met(stored.select("block", "toks"), BL.exploded(stored, "block"), vocab.select("token", "token_id"), "token",
                  run, "a int, b int, n long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"))


def association(counts: DataFrame, vocab: DataFrame, shift: float = 1.0, token: str = "token") -> DataFrame:
    """(a, b, x), both orders: log(n(a,b) N / (n(a) n(b))) - log(shift) where
    that is above 0, over pairs of vocabulary tokens; n(a) and N are sums of the
    symmetric counts, in which a pair of equal tokens counts for both sides."""
    v = vocab.select(token)
    kept = (counts.join(v.withColumnRenamed(token, "a"), "a", "semi")
            .join(v.withColumnRenamed(token, "b"), "b", "semi"))
    one = F.struct(F.col("a").alias("a"), F.col("b").alias("b"))
    other = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut_lineage(kept.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other)))
                                   .alias("p"), F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
                       .select("p.a", "p.b", "n"))
    sums = both.groupBy("a").agg(F.sum("n").alias("na"))
    total = both.agg(F.sum("n").cast("double").alias("all"))
    x = F.log(F.col("n") * F.col("all") / (F.col("na").cast("double") * F.col("nb"))) - F.log(F.lit(float(shift)))
    return (both.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
            .crossJoin(F.broadcast(total)).select("a", "b", x.alias("x")).where(F.col("x") > 0))


def multiply(matrix, tall: DataFrame, width: int) -> DataFrame:
    """(a, y): the table ``matrix`` (a, b, x), or its cells, times ``tall`` (token, q)."""
    if isinstance(matrix, PairCells):
        return matrix.named(matrix.times(matrix.tall(tall, "token", "q", width), width), "a", "y", width)
    cells = grid(matrix, "a", "b", "x")
    v = to_parts(cells.columns, cells.n_columns, tall, "token", "q", width)
    return from_parts(cells.rows, cells.times(v, width), "a", matrix.schema["a"].dataType.simpleString(), "y", width)


def small_products(pairs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """q'y and y'y of a table (q, y) of packed parts: each task sums its rows,
    the driver gets 2 x width x width numbers."""
    def run(q, y):
        q, y = unpacked(q, width), unpacked(y, width)
        return np.stack([q.T @ y, y.T @ y])

    return tuple(summed(pairs.select("q", "y"), run, 2 * width * width).reshape(2, width, width))


def times(table: DataFrame, column: str, width: int, small: np.ndarray, out: str) -> DataFrame:
    """(part, out): the packed ``column`` times a small matrix."""
    return mapped(table, lambda x: (unpacked(x, width) @ small,), [column], [out])


def _basis(gram: np.ndarray) -> tuple[np.ndarray, bool]:
    """What makes the columns of a tall matrix with this Gram matrix
    orthonormal, directions of no length left out; and whether columns nearly
    coincide, which loses digits."""
    value, vector = np.linalg.eigh(gram)
    there = value > 1e-12 * max(value[-1], 1e-300)
    return vector[:, there] / np.sqrt(value[there]), bool(value[there][0] < 1e-8 * value[-1])


def factor(matrix, dim: int, tol: float = 1e-4, max_iter: int = 20, oversample: int = OVERSAMPLE):
    """The ``dim`` eigenvalues of largest size of a symmetric table (a, b, x),
    or of its cells, and its vectors: ((token, vector), values, residuals).

    A vector is the row of the eigenvectors times the roots of the values'
    sizes.  The loop ends when no kept value changes by more than ``tol`` of the
    largest, or after ``max_iter`` products; a residual is |M v - value v| over
    the largest value.
    """
    width = dim + oversample
    if isinstance(matrix, PairCells):
        cells, spark, tokens = matrix, matrix.cells.sparkSession, None
        tall = stored(cells.start(width))
        empty = tall.isEmpty() or not small_products(tall.withColumn("y", F.col("q")), width)[1].any()
    else:
        cells, spark = grid(matrix, "a", "b", "x", square=True), matrix.sparkSession
        tokens = matrix.select(F.col("a").alias("token")).distinct()
        start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.xxhash64("token", i) / F.lit(2.0 ** 63))
        tall = stored(to_parts(cells.rows, cells.n_rows, tokens.select("token", start.alias("q")), "token", "q", width)
                           .withColumnRenamed("v", "q"))
        empty = tall.isEmpty()
    if empty:
        none = spark.createDataFrame([], "token int, vector array<double>") if tokens is None else tokens.select(
            "token", F.array().cast("array<double>").alias("vector"))
        return none, np.zeros(0), np.zeros(0)
    first, _ = _basis(small_products(tall.withColumn("y", F.col("q")), width)[1])
    # made of a stored table, for a product and a join
    tall, width = times(tall, "q", width, first, "q"), first.shape[1]
    last, before = None, None
    for step in range(max_iter):
        both = stored(cells.times(tall.withColumnRenamed("q", "v"), width).withColumnRenamed("v", "y").join(tall, "part"))
        forget(spark, before)
        before = both
        qy, yy = small_products(both, width)
        value, rotate = np.linalg.eigh((qy + qy.T) / 2)
        order = np.argsort(-abs(value), kind="stable")
        value, rotate = value[order], rotate[:, order]
        kept = value[:dim]
        if last is not None and len(last) == len(kept) and abs(kept - last).max() <= tol * abs(kept).max() or step + 1 == max_iter:
            break
        last = kept
        turn, near = _basis(yy)
        tall, width = times(both, "y", width, turn, "q"), turn.shape[1]
        if near:  # once more
            turn, _ = _basis(small_products(tall.withColumn("y", F.col("q")), width)[1])
            tall, width = times(tall, "q", width, turn, "q"), turn.shape[1]
    # |M v - value v|^2 = v'M'M v - 2 value v'M v + value^2, from the small products
    left = np.einsum("ij,ik,kj->j", rotate, yy, rotate) - value ** 2
    residual = np.sqrt(np.maximum(left[:dim], 0)) / abs(value).max()
    vectors = times(both, "q", width, rotate[:, :dim] * np.sqrt(abs(value[:dim])), "vector")
    if tokens is None:
        return cells.named(vectors, "token", "vector", len(value[:dim]), "vector"), value[:dim], residual
    of_kind = matrix.schema["a"].dataType.simpleString()
    return from_parts(cells.rows, vectors, "token", of_kind, "vector", len(value[:dim]), "vector"), value[:dim], residual


def token_vectors(rows: DataFrame, vocab: DataFrame, tokens: str = "tokens", dim: int = 16, window: int = 2,
                  shift: float = 1.0, tol: float = 1e-3, max_iter: int = 20) -> DataFrame:
    """FEA6: (token, vector) of the vocabulary tokens that stand beside another
    more often than by chance; the others have no vector."""
    table = association(pair_counts(rows, tokens, window), vocab, shift)
    return factor(table, dim, tol, max_iter)[0]
