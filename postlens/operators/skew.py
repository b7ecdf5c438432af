"""Joins whose large side may have very many rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(rows: DataFrame, small: DataFrame, on, how: str = "left", spread: str | Column | None = None,
                salts: int = SALTS) -> DataFrame:
    """``rows`` joined with a table of one row per key, hot keys spread out.

    When the keyed side is an aggregate directly below the join, the
    optimizer's own skew handling does not apply: its partitioning is needed
    as it is.  So each row gets one of ``salts`` numbers, every keyed row is
    repeated once per number, and the join is on both: a key with a third of
    all rows is dealt over ``salts`` tasks.  ``spread`` is a column that tells
    rows of one key apart (e.g. the row key); without it the row's position
    is used, which keeps filters from moving below the join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if spread is None:
        number = F.monotonically_increasing_id()
    else:
        number = F.xxhash64(spread)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("__salt", F.pmod(number, F.lit(salts)).cast("int"))
            .join(salted, [*keys, "__salt"], how).drop("__salt"))
