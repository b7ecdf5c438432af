"""The corpus pipeline: toxicity, quality, near copies, repeats, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all documents
the stage before kept; its result is written as Parquet and read again.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import packing, quality, simhash, suffix_dedup, toxicity
from postlens.llm.common import stored, table
from postlens.llm.queries import vocabulary

#: The stages train a string-kernel machine, reach covariance estimates step by
#: step and follow links to their ends, which SQL cannot express; tests hold the
#: pipeline against the brute-force forms of its stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine finds toxic go; it learns from labels that
    aren't held out, on the documents of this stage."""
    labels = table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.drop_toxic(docs, machine)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their group go."""
    return quality.drop_outliers(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, the one of least id stays."""
    return simhash.drop_near_copies(docs, shingle=3, distance=2)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier go from the texts."""
    cut = suffix_dedup.drop_repeats(docs, length=100)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in length buckets and batches."""
    # the workers of earlier stages hold memory still: a smaller store of words
    lengths = packing.token_lengths(docs, vocabulary("byte_bpe_50k.json"), kept_bytes=24 << 20)
    return packing.pack(lengths, longest=4096, buckets=16, budget=65_536).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
