"""Packing into length buckets of least padding.

Texts longer than ``longest`` tokens are cut into consecutive sequences.  The
histogram of sequence lengths (at most ``longest`` numbers, counted over all
rows) is cut by dynamic programming into the buckets whose padding is least.
Inside a bucket, sequences in id order fill batches of a token budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, id_text, stored, text_slices
from .numbering import number_rows
from .token_files import GATHER, KEPT_BYTES, library_encoder


def token_lengths(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """(key, length): tokens of each whole text and one for its end.  Null and
    empty texts have length 1; rows of one id and null ids have a row each;
    other columns are not read; no rows give no rows.  ``kept_bytes``: half of
    what a worker keeps of words and their ids; with less, more are worked out again."""
    def run(batches):
        encoder = library_encoder(model_path, kept_bytes)
        for keys, texts in gathered(text_slices(batches), GATHER):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(x) + 1 for x in encoder.encode(texts)], pa.int64())],
                ["key", "length"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "key long, length long")


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding:
    the sum over sequences of bucket length less own length."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[x] for x in lengths.tolist()], np.float64)
    # of the first i lengths: how many sequences, and how many tokens
    many = np.concatenate([[0.0], np.cumsum(count)])
    tokens = np.concatenate([[0.0], np.cumsum(count * lengths)])
    n = len(lengths)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choice = []
    for _ in range(min(buckets, n)):
        new, came = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            # the last bucket holds lengths i .. j - 1
            total = cost[:j] + lengths[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j])
            i = int(total.argmin())
            new[j], came[j] = total[i], i
        choice.append(came)
        cost = new
    out, j = [], n
    for came in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(came[j])
    return out[::-1]


def pack(lengths: DataFrame, longest: int = 4096, buckets: int = 16, budget: int = 65_536, id_col: str = "key",
         length_col: str = "length") -> DataFrame:
    """(id, piece, start, n_tokens, bucket, bucket_length, batch, slot), one row
    per sequence: the ``piece``-th of its row, from token ``start`` on, in slot
    ``slot`` of batch ``batch`` of its bucket; a batch holds
    ``budget // bucket_length`` sequences, at least one.

    Rows of null or no length give no sequence.  Repeated ids are packed each,
    in the order of their length; null ids come first.  Columns of other names
    are not read; no rows give no rows.
    """
    n = F.col("n")
    rows = lengths.select(F.col(id_col).cast("long").alias("id"), F.col(length_col).cast("long").alias("n")).where(n > 0)
    sequences = stored(
        rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / longest))).alias("piece"))
        .select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"),
                F.least(F.lit(longest).cast("long"), n - F.col("piece") * longest).alias("n_tokens")), "sequences")
    # at most ``longest`` rows
    histogram = {r["n_tokens"]: r["count"] for r in sequences.groupBy("n_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets)
    if not bounds:
        return sequences.select("id", "piece", "start", "n_tokens", F.lit(0).alias("bucket"),
                                F.lit(0).cast("long").alias("bucket_length"), F.lit(0).cast("long").alias("batch"),
                                F.lit(0).alias("slot")).withColumnRenamed("id", id_col)
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds)
    size = F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("bucket") + 1)
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_length")))
    placed = number_rows(sequences.withColumn("bucket", bucket), ["bucket"], ["id", "piece", "n_tokens"], "row")
    return (placed.withColumn("bucket_length", size)
            .select(F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket", "bucket_length",
                    F.floor(F.col("row") / capacity).alias("batch"), (F.col("row") % capacity).cast("int").alias("slot")))
