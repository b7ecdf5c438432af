"""Structured Streaming forms of the preparation steps.

The reference has no streaming.  The stateless preparation of §2.2/§2.8
(text assembly, ASCII cleaning, row sums, category columns) is made of column
expressions only, so it runs unchanged on ``readStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.functions import text as T
from postlens.operators import prepare as P


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream (explicit schema)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def prepare_stream(df: DataFrame, text_cols=None, reaction_cols=None) -> DataFrame:
    """Stateless preparation on a streaming (or batch) frame."""
    if text_cols:
        df = P.with_text(df, text_cols).withColumn("Text", T.ascii_only("Text"))
    if reaction_cols:
        df = P.with_reactions_sum(df, reaction_cols)
    return df
