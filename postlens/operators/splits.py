"""Repeatable splits, shuffles and samples keyed by a hash.

IDs: SPL1-SPL6, SET1, SET2.

A seeded permutation on one machine cannot be replayed on partitions, so the
contract kept is: disjoint, complete, repeatable whatever the partitioning,
and close to the requested fractions.  The bucket of a row is a pure function
of its key and the seed, so each executor decides locally and no shuffle is
needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def hash_bucket(key, seed: int = SEED, buckets: int = 100) -> Column:
    """0..buckets-1 from the first 28 bits of ``md5(key || seed)``."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("long")
    return (h % buckets).cast("int")


def split_posts(df: DataFrame, key: str, fractions=(0.6, 0.2, 0.2), seed: int = SEED,
                names=("train", "val", "test"), out: str = "split") -> DataFrame:
    """SPL1: label each row train/val/test by bucket thresholds (60, 80)."""
    b = hash_bucket(key, seed)
    cuts, acc = [], 0.0
    for f in fractions[:-1]:
        acc += f
        cuts.append(int(round(acc * 100)))
    expr = None
    for cut, name in zip(cuts, names):
        expr = (F.when(b < cut, F.lit(name)) if expr is None else expr.when(b < cut, F.lit(name)))
    expr = expr.otherwise(F.lit(names[len(cuts)]))
    return df.withColumn(out, expr)


def split_stance(df: DataFrame, key: str, val_fraction: float = 0.2, seed: int = SEED,
                 out: str = "split") -> DataFrame:
    """SPL2: train/val of labelled rows; both labels travel with the row."""
    return split_posts(df, key, (1 - val_fraction, val_fraction), seed, ("train", "val"), out)


def split_range(df: DataFrame, fraction: float, total: int | Column | None = None, order: str = "row_idx",
                out: str = "split") -> DataFrame:
    """SPL3: first ``fraction`` of a dense row index is ``test``, the rest
    ``train``; no row is lost at the border."""
    if total is None:
        n = df.agg(F.count(F.lit(1)).alias("__n"))
        df = df.crossJoin(n)
        total = F.col("__n")
    elif isinstance(total, int):
        total = F.lit(total)
    cut = F.floor(total * F.lit(fraction))
    res = df.withColumn(out, F.when(F.col(order) < cut, F.lit("test")).otherwise(F.lit("train")))
    return res.drop("__n") if "__n" in res.columns else res


def shuffle_key(key, seed: int = SEED) -> Column:
    """SPL4: sort key of a seeded shuffle, ``md5(key || seed)``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(str(seed))))


def shuffle(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """SPL4: a repeatable shuffle as a distributed range sort."""
    return df.withColumn("shuffle_key", shuffle_key(key, seed)).orderBy("shuffle_key", key)


def sample_trials(spark, n: int, seed: int = SEED) -> DataFrame:
    """SPL5: random-search table: lr = |N(1e-3, 1e-3)|, batch from {16,32,64,128}.

    Drawn from hashes of the trial number (a Box-Muller pair for the normal),
    so the table is the same on every cluster layout."""
    def uniform(part: int):
        h = F.substring(F.md5(F.concat_ws("-", F.col("trial").cast("string"), F.lit(f"{seed}-{part}"))), 1, 8)
        return (F.conv(h, 16, 10).cast("double") + 0.5) / float(1 << 32)

    sizes = F.array(*[F.lit(x) for x in (16, 32, 64, 128)])
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.pi() * uniform(1))
    return (spark.range(n).withColumnRenamed("id", "trial")
            .withColumn("learning_rate", F.abs(normal * 1e-3 + 1e-3))
            .withColumn("batch_size", F.element_at(sizes, (F.floor(uniform(2) * 4) + 1).cast("int"))))


def background(df: DataFrame, key: str, n: int = 512, seed: int = SEED) -> DataFrame:
    """SPL6: ``n`` rows chosen by hash order (top-n, no full sort)."""
    return df.withColumn("__h", shuffle_key(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def union_splits(*dfs: DataFrame) -> DataFrame:
    """SET1: stack parts by name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def select_split(df: DataFrame, part: str, col: str = "split") -> DataFrame:
    """SET2: one part; any other name than train/val means test, as in the reference."""
    p = part if part in ("train", "val") else "test"
    return df.where(F.col(col) == F.lit(p))
