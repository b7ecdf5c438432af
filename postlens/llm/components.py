"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each index's component, for links inside one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's neighbours (larger ones in the large step,
    smaller ones in the small step) are linked to its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        nodes = both
    else:
        nodes = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(nodes.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "star")
    met = nodes.where("b > a") if large else nodes
    out = met.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, root): the least node of the component of every node that has a
    link; ``links`` is (a, b).  Large-star and small-star steps alternate until
    the links are stars around their least nodes."""
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
                 "links")
    before = None
    while True:
        # equal sums of hashes: the steps have left every link as it was
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select("a", F.col("b").alias("root"))
        before = state
        now = stored(_star(stored(_star(now, True), "links"), False), "links")
