"""Post-table preparation: projections, filters, group means, duplicates.

IDs: PRJ1-PRJ12, FLT1-FLT7, WIN1, WIN2.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as T

# The reaction columns summed into ``reactions_sum``, the eight
# columns dropped after preparation, and the four text fields of ``Text``.
REACTION_COLUMNS = ["Likes", "Comments", "Shares", "Love", "Wow", "Haha", "Sad", "Angry", "Care"]
UNWANTED_COLUMNS = ["Page Category", "Page Admin Top Country", "Page Description", "Page Created",
                    "Post Created Date", "Post Created Time", "Is Video Owner?", "Sponsor Category"]
TEXT_COLUMNS = ["Message", "Image Text", "Link Text", "Description"]
STANCES = ["FAVOR", "AGAINST", "NONE", "UNKNOWN"]


def with_reactions_sum(df: DataFrame, cols=REACTION_COLUMNS, out: str = "reactions_sum") -> DataFrame:
    """PRJ1: row sum; any null term makes the sum null (no coalesce)."""
    return df.withColumn(out, reduce(operator.add, [F.col(c) for c in cols]))


def with_group_avg(df: DataFrame, group: str, value: str = "reactions_sum",
                   out: str = "reactions_groupavg", spread: str | bool | None = None, salts: int = 16,
                   key: str = "row_idx") -> DataFrame:
    """WIN1: mean of ``value`` over the row's group, repeated on every row.

    The means are a partial aggregate joined back by salted keys, so a group
    that holds a third of all rows is summed and joined by many tasks (a
    window would buffer it in one).  Rows are spread by the column ``spread``,
    else by ``key`` where they have one, so that a task that is run again deals
    its rows alike.  Rows without a key, or with ``spread=False``, are spread by
    position, which reads no further column: for rows straight from a scan,
    whose order is fixed, and not for rows behind a shuffle.  With ``salts=1`` the
    join is on the group alone: for posts stored in buckets of the group, which
    it then joins without any exchange.  Rows whose group is null get no mean.
    """
    from postlens.operators.skew import salted_join
    means = (df.where(F.col(group).isNotNull())
             .groupBy(group).agg(F.avg(value).alias(out)))
    if salts == 1:
        return df.join(means, on=group, how="left")
    if spread is None and key in df.columns:
        spread = key
    return salted_join(df, means, group, "left", spread or None, salts)


def with_impact_score(df: DataFrame, value: str = "reactions_sum", avg: str = "reactions_groupavg",
                      out: str = "score") -> DataFrame:
    """PRJ2: ratio to the group mean; NULL when the mean is 0 or missing."""
    return df.withColumn(out, F.try_divide(F.col(value), F.col(avg)))


def with_impact_label(df: DataFrame, score: str = "score", threshold: float = 1.0,
                      out: str = "impact") -> DataFrame:
    """PRJ3: 1 if score > threshold else 0; a missing score gives 0."""
    return df.withColumn(out, F.coalesce(F.col(score) > F.lit(threshold), F.lit(False)).cast("int"))


def impact(df: DataFrame, group: str, value: str = "reactions_sum", threshold: float = 1.0,
           salts: int = 16, spread: str | bool | None = None) -> DataFrame:
    """WIN1 + PRJ2 + PRJ3 in one call."""
    out = with_group_avg(df, group, value, spread=spread, salts=salts)
    out = with_impact_score(out, value)
    return with_impact_label(out, threshold=threshold)


def with_gold_pair(df: DataFrame, score: str = "score", party: str = "Party", out: str = "gold") -> DataFrame:
    """PRJ4: composite label ``struct(score, party)``."""
    return df.withColumn(out, F.struct(F.col(score).alias("score"), F.col(party).alias("party")))


def with_text(df: DataFrame, cols=TEXT_COLUMNS, sep: str = " ", out: str = "Text") -> DataFrame:
    """PRJ5: the model text; separators are always present."""
    return df.withColumn(out, T.concat_fields(cols, sep))


def prune_columns(df: DataFrame, names=UNWANTED_COLUMNS) -> DataFrame:
    """PRJ6: drop columns; missing names are ignored like ``errors='ignore'``
    would, since a data set may lack some of them."""
    return df.drop(*[n for n in names if n in df.columns])


def unify_name(df: DataFrame, group_col: str = "Group Name", page_col: str = "Page Name",
               created_col: str = "Post Created") -> DataFrame:
    """PRJ7: group or page name become ``Name``; ``Post Created`` -> ``Created``.
    When both name columns exist they are coalesced (group first)."""
    cols = set(df.columns)
    if group_col in cols and page_col in cols:
        df = df.withColumn("Name", F.coalesce(F.col(group_col), F.col(page_col))).drop(group_col, page_col)
    elif group_col in cols:
        df = df.withColumnRenamed(group_col, "Name")
    elif page_col in cols:
        df = df.withColumnRenamed(page_col, "Name")
    if created_col in cols:
        df = df.withColumnRenamed(created_col, "Created")
    return df


def category_features(df: DataFrame, group_id: str | None = "Facebook Id", type_col: str | None = "Type",
                      link: str | None = "Link") -> DataFrame:
    """PRJ8: category columns chosen by three switches (pass None to disable).
    The link becomes its registered domain, '' when there is no link."""
    cols = {}
    if group_id:
        cols["group_id"] = F.col(group_id).cast("string")
    if type_col:
        cols["post_type"] = F.col(type_col)
    if link:
        cols["domain"] = F.when(F.col(link).isNull(), F.lit("")).otherwise(T.registered_domain(link))
    return df.withColumns(cols)


def with_row_index(df: DataFrame, order, out: str = "row_idx", stable: bool = True) -> DataFrame:
    """PRJ9: dense 0-based index in the order of a known key.

    No single-partition window: the frame is range-partitioned and sorted on
    ``order``; each row's position inside its partition comes from
    ``monotonically_increasing_id`` and each partition's offset from a running
    sum over per-partition counts (one row per partition, so broadcasting it
    is bounded by the partition count, not the data).

    Both passes (counts and rows) must see one partition layout.  Two
    separate range shuffles would not guarantee that: range bounds come from
    a sample whose seed depends on the RDD id.  So the sorted frame is
    materialised once: ``stable=True`` writes it to the checkpoint folder
    (large tables; survives executor loss), ``stable=False`` persists it
    (small tables such as vocabularies; a lost block is recomputed from the
    same shuffle and its fixed bounds).
    """
    from postlens.session import cut_lineage

    order_cols = [order] if isinstance(order, (str, Column)) else list(order)
    s = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__mid", F.monotonically_increasing_id()))
    if stable:
        s = cut_lineage(s)
    else:
        from pyspark import StorageLevel
        s = s.persist(StorageLevel.MEMORY_AND_DISK)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (s.join(F.broadcast(offsets), "__pid")
            .withColumn(out, (F.col("__off") + pos).cast("long"))
            .drop("__pid", "__mid", "__off"))


def to_submission(df: DataFrame, id_col: str = "ID", target: str = "Target", text: str = "Tweet",
                  stance: str = "Stance") -> DataFrame:
    """PRJ10: submission layout ``ID, Target, Tweet, Stance``."""
    return df.select(F.col(id_col).alias("ID"), F.col(target).alias("Target"),
                     F.col(text).alias("Tweet"), F.col(stance).alias("Stance"))


def evaluation_frame(scored: DataFrame, prediction: str = "prediction", gold: str = "label",
                     text: str = "Text", categories=("group_id", "post_type", "domain")) -> DataFrame:
    """PRJ11: prediction, gold label, text and decoded category columns."""
    cats = [c for c in categories if c in scored.columns]
    return scored.select(F.col(prediction).alias("prediction"), F.col(gold).alias("gold"),
                         F.col(text).alias("text"), *cats)


# The reference's default run parameters.
DEFAULT_CONFIG = {
    "column_goldlabel": "score",
    "dataset_path": "../../data/USParties/USParties_preprocessed.csv",
    "category_group_id": True,
    "category_type": True,
    "category_tld": True,
    "batch_size": 128,
    "category_encoded_length": 16,
    "category_encoder_out": 16,
    "learning_rate": 1e-3,
    "vocab_min_freq": 10,
    "bilstm_hidden_dim": 150,
    "embedding_dim": 100,
}


def make_config(overrides: dict | None = None, defaults: dict | None = None) -> dict:
    """PRJ12: defaults overridden by the run's keys (a driver-side dict)."""
    cfg = dict(DEFAULT_CONFIG if defaults is None else defaults)
    cfg.update(overrides or {})
    return cfg


def merge_config_maps(defaults: Column, overrides: Column) -> Column:
    """PRJ12 as a column: ``map_concat`` keeps the override under LAST_WIN."""
    return F.map_concat(defaults, overrides)


# --- filters ----------------------------------------------------------------

def below(df: DataFrame, col: str, bound) -> DataFrame:
    """FLT1: keep ``col < bound``; nulls are dropped."""
    return df.where(F.col(col) < F.lit(bound))


def shorter_than(df: DataFrame, col: str, n: int) -> DataFrame:
    """FLT2: keep texts shorter than ``n`` characters."""
    return df.where(F.char_length(F.col(col)) < F.lit(n))


def split_on(df: DataFrame, predicate: Column, flag: str = "matched"):
    """FLT3/SET3: two disjoint outputs of one predicate (null counts as false)."""
    flagged = df.withColumn(flag, F.coalesce(predicate, F.lit(False)))
    return flagged.where(F.col(flag)).drop(flag), flagged.where(~F.col(flag)).drop(flag)


def flag_on(df: DataFrame, predicate: Column, flag: str = "matched") -> DataFrame:
    """FLT3 as a single pass: the flag column, for counting both sides at once."""
    return df.withColumn(flag, F.coalesce(predicate, F.lit(False)))


def sample_post(df: DataFrame, group_col: str, group_value, order: str = "row_idx") -> DataFrame:
    """FLT4: the first row of one group (pruned scan, top-1 by ``order``)."""
    return df.where(F.col(group_col) == F.lit(group_value)).orderBy(order).limit(1)


def label_is_valid(col: str = "Stance") -> Column:
    """FLT5: case-sensitive membership in the four stance labels."""
    return F.col(col).isin(*STANCES) & F.col(col).isNotNull()


def validate_labels(df: DataFrame, col: str = "Stance", strict: bool = False):
    """FLT5: return (valid, rejects).  ``strict`` makes the valid frame fail at
    run time with the offending label, like the scorer stopping."""
    ok = label_is_valid(col)
    rejects = df.where(~F.coalesce(ok, F.lit(False)))
    valid = df
    if strict:
        valid = df.withColumn(col, F.when(ok, F.col(col)).otherwise(
            F.raise_error(F.concat(F.lit("invalid stance label: "), F.coalesce(F.col(col), F.lit("NULL"))))))
    else:
        valid = df.where(ok)
    return valid, rejects


def token_class(token: Column | str, stop_words: DataFrame | None = None, stop_col: str = "stop",
                unicode_digits: bool = True) -> Column:
    """FLT7: stop word, punctuation, digits, syllables (sub-word ``#``) or
    content, tested in this order.  With a joined stop-word flag column pass
    ``stop_col``; otherwise membership in the fixed list is tested inline."""
    tok = F.col(token) if isinstance(token, str) else token
    is_stop = F.col(stop_col) if stop_words is not None else tok.isin(*T.STOP_WORDS)
    return (F.when(is_stop, F.lit("stop_words"))
            .when(T.in_punctuation(tok), F.lit("punctuation"))
            .when(T.is_digits(tok, unicode=unicode_digits), F.lit("digits"))
            .when(F.contains(tok, F.lit("#")), F.lit("syllables"))
            .otherwise(F.lit("content")))


# --- duplicates -------------------------------------------------------------

def dedup_first(df: DataFrame, keys, order: str = "row_idx") -> DataFrame:
    """WIN2: drop content duplicates keeping the first row by ``order``; null
    key values compare equal.

    ``order`` is a unique row key, so ``min(order)`` per key group names the
    row to keep: the groups are reduced by partial aggregation (a key with
    millions of copies is never sorted inside one task) and the rows are then
    kept by a semi join on ``order`` alone, so the long text keys cross the
    network once, in the aggregate.
    """
    keys = list(keys)
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")
