"""Counts, histograms, distinct sets and ordered picks.

IDs: AGG1-AGG7, AGG16-AGG21, AGG25, AGG26, SRT1-SRT6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """AGG1/AGG2: rows per value (partial aggregation before the shuffle)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 100, by=(), lo=None, hi=None) -> DataFrame:
    """AGG3-AGG5: equal-width bins from min to max, last bin closed; empty
    bins are kept with n = 0.

    The range is a one-row aggregate joined to every row (a one-row side is
    bounded whatever the data size); the bin counts are a partial aggregate.
    Empty bins come from ``sequence(0, bins-1)`` exploded per group key.
    """
    by = list(by)
    x = F.col(col)
    base = df.where(x.isNotNull())
    if lo is not None and hi is not None:
        base = base.where((x >= F.lit(lo)) & (x <= F.lit(hi)))  # values outside are in no bin
    if lo is None or hi is None:
        rng = base.groupBy(*by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    else:
        rng = base.groupBy(*by).agg(F.lit(lo).cast("double").alias("__lo"), F.lit(hi).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    raw = F.floor(F.try_divide(x - F.col("__lo"), width)).cast("long")
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    joined = base.join(rng, on=by, how="inner") if by else base.crossJoin(rng)
    counts = joined.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(*by, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumn("bin", F.col("bin").cast("long"))
    out = grid.join(counts, on=[*by, "bin"], how="left")
    return out.select(*by, "bin",
                      (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("bin_lo"),
                      F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def median(df: DataFrame, col: str, by=(), exact: bool = True) -> DataFrame:
    """AGG6: median per group, interpolated between the two middle values.

    ``exact=True`` first counts equal values (a partial aggregate, so a value
    that most rows share is one row), then range-sorts the different values
    of all groups; each sorted partition adds up its counts per group, the
    totals of earlier partitions are added, and the one or two values whose
    span of positions holds the middle are averaged.  No task holds a group.
    ``exact=False`` is ``percentile_approx`` (one pass, bounded memory).
    """
    from postlens.session import cut_lineage
    by = list(by)
    if not exact:
        m = F.percentile_approx(col, 0.5, 10000)
        return df.groupBy(*by).agg(m.alias("median")) if by else df.agg(m.alias("median"))
    keys = by or ["__g"]
    base = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__v"))
    if not by:
        base = base.withColumn("__g", F.lit(0))
    values = base.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    parts = cut_lineage(values.repartitionByRange(*keys, "__v").withColumn("__pid", F.spark_partition_id()))
    inside = Window.partitionBy("__pid", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    # one row per group and partition: only groups that span partitions have several
    totals = parts.groupBy(*keys, "__pid").agg(F.sum("__n").alias("__t"))
    over = Window.partitionBy(*keys)
    spans = totals.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys], F.col("__pid").alias("__s_pid"), F.sum("__t").over(over).alias("__all"),
        (F.sum("__t").over(over.orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).alias("__off"))
    ranked = parts.withColumn("__to", F.sum("__n").over(inside))
    cond = [ranked[k].eqNullSafe(spans[f"__s_{k}"]) for k in keys] + [ranked["__pid"] == spans["__s_pid"]]
    r = ranked.join(spans, cond, "inner")
    last = F.col("__off") + F.col("__to") - 1  # positions first .. last hold this value
    first = last - F.col("__n") + 1
    lo, hi = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    hits = ((first <= lo) & (lo <= last)).cast("int") + ((first <= hi) & (hi <= last)).cast("int")
    out = r.where(hits > 0).groupBy(*keys).agg((F.sum(F.col("__v") * hits) / F.sum(hits)).alias("median"))
    return out.select(*by, "median") if by else out.select("median")


def mean(df: DataFrame, col: str, by=()) -> DataFrame:
    """AGG7."""
    return df.groupBy(*by).agg(F.avg(col).alias("mean")) if by else df.agg(F.avg(col).alias("mean"))


def dedup_stats(df: DataFrame, keys) -> DataFrame:
    """AGG17: rows before and after dropping duplicates; nulls compare equal
    (``countDistinct`` would skip rows with a null key, so the distinct keys
    are counted after a grouping)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_before"), F.count(F.lit(1)).alias("n_after"))


def first_seen(df: DataFrame, col: str, order: str = "row_idx") -> DataFrame:
    """AGG18: distinct values with their first position."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("first_idx"))


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG19."""
    return df.select(a, b).dropDuplicates([a, b])


def distinct_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """AGG20: distinct token set of a corpus (explode, then shuffle on token)."""
    return df.select(F.explode(tokens).alias("token")).distinct()


def max_len(df: DataFrame, tokens: str = "tokens", by=()) -> DataFrame:
    """AGG21: longest sequence."""
    m = F.max(F.size(tokens)).cast("long").alias("max_len")
    return df.groupBy(*by).agg(m) if by else df.agg(m)


def sum_vectors(df: DataFrame, col: str, by=()) -> DataFrame:
    """AGG25: element-wise sum of arrays, long form ``(pos, total)``.

    ``posexplode`` + partial sum per position: the shuffle carries one row per
    (map task, position), never a whole vector column per group.
    """
    ex = df.select(*by, F.posexplode(col).alias("pos", "__v"))
    return ex.groupBy(*by, "pos").agg(F.sum(F.col("__v").cast("double")).alias("total"))


def corpus_stats(df: DataFrame, text: str, relevant: Column | None = None, flag: str | None = None,
                 group: str | None = None) -> DataFrame:
    """AGG26: rows, tokens, vocabulary size and share flagged, on relevant rows."""
    from postlens.functions.text import tokenize
    base = df.where(relevant) if relevant is not None else df
    tok = base.select(*([group] if group else []), *([flag] if flag else []), tokenize(text).alias("__t"))
    by = [group] if group else []
    main = tok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("__t")).cast("long").alias("n_tokens"),
        *([F.avg(F.col(flag).cast("double")).alias("share_flagged")] if flag else []))
    vocab = (tok.select(*by, F.explode("__t").alias("__w")).groupBy(*by, "__w").agg(F.lit(1).alias("__x"))
             .groupBy(*by).agg(F.count(F.lit(1)).alias("n_vocab")))
    return main.join(vocab, on=by, how="left") if by else main.crossJoin(vocab)


# --- ordered picks ----------------------------------------------------------

def best_checkpoint(df: DataFrame, f1: str = "f1", loss: str = "loss") -> DataFrame:
    """SRT1: highest F1, then lowest loss, compared as numbers."""
    return df.orderBy(F.col(f1).cast("double").desc(), F.col(loss).cast("double").asc()).limit(1)


def latest_version(df: DataFrame, path: str = "path") -> DataFrame:
    """SRT2: natural sort of ``version_N``; the highest N."""
    n = F.regexp_extract(F.col(path), r"version_(\d+)$", 1).cast("int")
    return df.where(n.isNotNull()).agg(F.max_by(F.col(path), n).alias("latest"), F.max(n).alias("version"))


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """SRT3: top ``k`` by ``by`` descending; ``tie`` breaks ties (TakeOrderedAndProject)."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def head(df: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """SRT4: first ``n`` rows by a known order."""
    return df.orderBy(order).limit(n)


def row_slice(df: DataFrame, a: int, b: int, order: str = "row_idx") -> DataFrame:
    """SRT5: rows ``[a, b)`` of a dense row index (a pruned filter, no sort)."""
    return df.where((F.col(order) >= a) & (F.col(order) < b))


def first_batches(df: DataFrame, size: int, n: int, order: str = "row_idx") -> DataFrame:
    """SRT6: the first ``n`` batches of ``size`` rows, with their batch number."""
    return (df.where(F.col(order) < size * n)
            .withColumn("batch", F.floor(F.col(order) / size).cast("long")))
