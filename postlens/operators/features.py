"""Feature building: vocabulary, token ids, one-hot categories.

IDs: FEA1-FEA6, JN5, JN6, AGG15, AGG16.

Tokens are handled in the exploded long form ``(row key, pos, token)``; the
vocabulary is a table joined on ``token``.  A vocabulary that grows with the
corpus is never broadcast by hint: AQE broadcasts it when its measured size
allows, otherwise it is a shuffle join.  Hot tokens ("the") are reduced by
partial aggregation when counting; in the join they are the build side's
single row, so skew on the probe side is split by AQE's skew-join handling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import blocks as BL
from postlens.session import cut_lineage

UNK, PAD = "<unk>", "<pad>"
UNK_ID, PAD_ID = 0, 1


def token_table(df: DataFrame, key: str, text: str, out: str = "token") -> DataFrame:
    """Exploded tokens ``(key, pos, token)`` of STR6 over the whole text."""
    return df.select(key, F.posexplode(T.tokenize(text)).alias("pos", out))


def split_stopwords(tokens: DataFrame, stop_words: DataFrame, token: str = "token"):
    """JN8/SET4: (stop-word tokens, other tokens) by semi and anti join.  The
    stop list is a fixed list of known size, so it is broadcast."""
    s = F.broadcast(stop_words.select(token))
    return tokens.join(s, token, "left_semi"), tokens.join(s, token, "left_anti")


def build_vocab(tokens: DataFrame, min_freq: int = 10, token: str = "token") -> DataFrame:
    """AGG15/FEA5: tokens seen at least ``min_freq`` times; ids from 2 by
    (frequency desc, token asc); 0 and 1 are ``<unk>`` and ``<pad>``.

    The id is assigned by a global ranking over the vocabulary only (after
    the ``min_freq`` cut), never over the token stream.
    """
    return numbered_vocab(tokens.groupBy(token).agg(F.count(F.lit(1)).alias("freq")), min_freq, token)


def numbered_vocab(counts: DataFrame, min_freq: int = 10, token: str = "token") -> DataFrame:
    """:func:`build_vocab` of tokens that are counted already (token, freq)."""
    from postlens.operators.prepare import with_row_index
    ranked = with_row_index(counts.where(F.col("freq") >= min_freq), [F.col("freq").desc(), F.col(token).asc()], "__r")
    return ranked.select(token, "freq", (F.col("__r") + 2).cast("int").alias("token_id"))


def encode_tokens(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """JN5: token to id, out-of-vocabulary to ``<unk>``."""
    v = vocab.select(token, "token_id")
    return (tokens.join(v, on=token, how="left")
            .withColumn("token_id", F.coalesce(F.col("token_id"), F.lit(UNK_ID))))


def encode_text(df: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int | None = None) -> DataFrame:
    """FEA3: text to an id sequence in token order, optionally padded.

    Tokens meet the vocabulary block by block (:mod:`postlens.operators.blocks`),
    so that no token is shuffled on its own.  ``df`` may be stored tokens.
    """
    stored = df if "toks" in df.columns else BL.stored_tokens(df, key, text)

    def run(rows, known):
        code, keys = BL.owners(rows.column(key))
        row, toks = BL.tokens_of(rows)
        there = keys.is_valid().to_numpy(zero_copy_only=False)[code[row]]  # a row without a key has none
        row, toks = row[there], toks.filter(pa.array(there))
        at = BL.places(toks, known.column("token"))
        ids = np.full(len(at), UNK_ID, np.int32)
        if known.num_rows:
            ids[at >= 0] = known.column("token_id").to_numpy()[at[at >= 0]]
        # rows of one key have their tokens together
        owner = code[row]
        order = np.lexsort((ids, BL.position(row), owner))
        lists = BL.lists_of(owner[order], len(keys), pa.array(ids[order]))
        return pa.Table.from_arrays([rows.column(key), lists.take(pa.array(code))], names=[key, "ids"])

    seq = BL.met(stored.select("block", key, "toks"), BL.exploded(stored, "block"), vocab.select("token", "token_id"), "token",
                 run, f"{BL.kind(stored, key)}, ids array<int>")
    if max_len is not None:
        from postlens.functions.arrays import pad_to
        seq = seq.withColumn("ids", pad_to("ids", max_len, PAD_ID))
    return seq


def decode_tokens(ids: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """JN6: ids back to tokens, joined by a space in position order; a row
    without ids is the empty string."""
    special = ids.sparkSession.createDataFrame([(UNK_ID, UNK), (PAD_ID, PAD)], "token_id int, token string")
    v = vocab.select(F.col("token_id").cast("int").alias("token_id"), "token").unionByName(special)
    held = cut_lineage(ids.select(key, F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids")))
    size = held.agg(F.sum(F.size("ids"))).first()[0]
    n = BL.block_count(ids.sparkSession, 4 * int(size or 0))
    rows = held.select(BL.block_of(key, n).alias("block"), key, "ids").repartition(n, "block")

    def run(rows, known):
        lists = BL._whole(rows.column("ids"))
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = BL.places(lists.flatten(), known.column("token_id"))
        toks = BL._whole(known.column("token")).take(pa.array(at, mask=at < 0))
        code, keys = BL.owners(rows.column(key))
        owner, place = code[row], BL.position(row)
        order = np.lexsort((place, owner))
        if len(code) > len(keys):  # rows of one key: tokens of one place in their order
            text = np.argsort(np.array(toks.fill_null("").to_pylist(), object), kind="stable")
            rank = np.empty(len(text), int)
            rank[text] = np.arange(len(text))
            order = np.lexsort((rank, place, owner))
        order = order[toks.is_valid().to_numpy(zero_copy_only=False)[order]]
        joined = pc.binary_join(BL.lists_of(owner[order], len(keys), toks.take(pa.array(order))), " ")
        return pa.Table.from_arrays([keys, joined], names=[key, "decoded"])

    return BL.met(rows, rows.select("block", F.explode("ids").alias("token_id")), v, "token_id", run,
                  f"{BL.kind(ids, key)}, decoded string")


def fit_onehot(train: DataFrame, cols) -> DataFrame:
    """FEA1 (fit): sorted categories of each column learned on train only.

    Returns the category table ``(feature, value, slot)`` where ``slot`` is
    the global position in the concatenated one-hot vector; blocks follow
    ``cols`` order and values sort ascending inside a block.
    """
    parts = [train.select(F.lit(c).alias("feature"), F.lit(i).alias("__blk"),
                          F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull())
             for i, c in enumerate(cols)]
    vals = parts[0]
    for p in parts[1:]:
        vals = vals.unionByName(p)
    from postlens.operators.prepare import with_row_index
    vals = vals.distinct()
    ranked = with_row_index(vals, ["__blk", "value"], "__r", stable=False)
    return ranked.select("feature", "value", F.col("__r").cast("int").alias("slot"))


def onehot_long(df: DataFrame, key: str, cols, categories: DataFrame) -> DataFrame:
    """FEA1 (apply): long form ``(key, feature, slot, 1.0)``; an unseen value
    has no row (all zeros in its block)."""
    parts = [df.select(key, F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.join(categories, on=["feature", "value"], how="inner").select(
        key, "feature", "slot", F.lit(1.0).alias("x"))


def training_frame(df: DataFrame, key: str, label: str, ids: DataFrame, slots: DataFrame, keep=()) -> DataFrame:
    """FEA4: the batch record of each row: its label, its text's ids (of
    :func:`encode_text`), its sorted category slots (of :func:`onehot_long`) and
    the raw features ``keep``.  Rows without ids or slots have empty lists."""
    codes = slots.groupBy(key).agg(F.array_sort(F.collect_list("slot")).alias("slots"))  # one row's own slots
    none = F.array().cast("array<int>")
    return (df.select(key, F.col(label).alias("label"), *keep).join(ids, key, "left").join(codes, key, "left")
            .withColumns({c: F.coalesce(c, none) for c in ("ids", "slots")}))


def onehot_ml(train: DataFrame, cols):
    """FEA1 with Spark ML: ``StringIndexer(alphabetAsc, keep)`` +
    ``OneHotEncoder(dropLast=True)``: the dropped last slot is the unseen one,
    so an unseen value gives all zeros.  Returns the fitted PipelineModel,
    which adds ``cat_vec``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep") for c in cols]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__vec" for c in cols],
                        dropLast=True)
    asm = VectorAssembler(inputCols=[f"{c}__vec" for c in cols], outputCol="cat_vec")
    return Pipeline(stages=[*idx, ohe, asm]).fit(train)


def inverse_onehot(long: DataFrame, key: str, categories: DataFrame, cols) -> DataFrame:
    """FEA2: long one-hot rows back to one named column per feature; a block
    with no 1 gives NULL."""
    named = long.join(categories.select("feature", "slot", "value"), on=["feature", "slot"], how="inner")
    return named.groupBy(key).pivot("feature", list(cols)).agg(F.first("value"))


def category_sizes(categories: DataFrame) -> DataFrame:
    """AGG16: one-hot vector length and values per block."""
    return categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"))


def token_vectors(tokens_per_row: DataFrame, tokens_col: str = "tokens", dim: int = 32, min_count: int = 5,
                  seed: int = 42, num_partitions: int | None = None):
    """FEA6: Word2Vec trained on the corpus (no pretrained vectors exist here).
    Returns ``(token, vector array<double>)``.

    Spark's Word2Vec trains in one partition unless told otherwise; the
    default here is the cluster's parallelism.  Its vocabulary (words seen at
    least ``min_count`` times) is held by the driver and broadcast, which is
    what bounds ``min_count`` from below on a large corpus."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    parts = num_partitions or tokens_per_row.sparkSession.sparkContext.defaultParallelism
    # the fit reads its input twice (vocabulary, then training): keep the
    # tokenized rows for its duration, like Spark ML estimators do
    rows = tokens_per_row.select(tokens_col).persist()
    try:
        model = Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, inputCol=tokens_col,
                         outputCol="__w2v", maxIter=1, numPartitions=max(1, parts)).fit(rows)
    finally:
        rows.unpersist()
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))
