"""Tokens of rows, stored once and looked up block by block.

A join of every token with a table of tokens (vocabulary, groups, weights)
shuffles the corpus token by token, twice when the row's tokens have to come
together again.  Here rows are dealt to blocks of some megabytes by the hash of
their key, and a block meets the table's entries of its own distinct tokens: the
shuffle holds a block's distinct tokens, and a frequent token is one entry of a
block.  Rows of one key are in one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.session import cut_lineage_by

#: Characters (or numbers, times 4) of a block.
BLOCK_CHARS = 8 << 20


def block_count(spark: SparkSession, chars: int, block: int = BLOCK_CHARS) -> int:
    """Blocks for so much text: one for each ``block`` characters, and on small
    inputs enough to give every core some."""
    small = min(spark.sparkContext.defaultParallelism, -(-chars // (block // 32)))
    return int(max(1, small, -(-chars // block)))


def block_of(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def stored_tokens(df: DataFrame, key: str, text: str, keep=(), chars: int | None = None) -> DataFrame:
    """(block, key, *keep, toks): the tokens of each row's text, made once and
    stored as :func:`token_text`.  ``chars``: the texts' length, if known."""
    if chars is None:
        chars = df.agg(F.sum(F.char_length(text))).first()[0]
    n = block_count(df.sparkSession, int(chars or 0))
    return cut_lineage_by(df.select(block_of(key, n).alias("block"), key, *keep, T.token_text(text).alias("toks")), "block", n)


def exploded(stored: DataFrame, *keep: str) -> DataFrame:
    """(*keep, token) of every stored token."""
    return stored.select(*keep, F.explode(T.split_tokens("toks")).alias("token"))


def met(blocks: DataFrame, wanted: DataFrame, table: DataFrame, on: str, run, schema: str) -> DataFrame:
    """``run(rows of a block, its entries of table)``; ``wanted``: (block, on)
    of each block, as often as it comes."""
    known = wanted.select(F.col("block").alias("__b"), F.col(on).alias(on)).distinct().join(table, on)
    return blocks.groupBy("block").cogroup(known.groupBy("__b")).applyInArrow(run, schema)


def _taken(table: pa.Table, column: str, take: pa.Array) -> pa.Array:
    """Entries of a column; their type may be null inside, as Spark asks."""
    out = _whole(table.column(column)).take(take)
    return out.cast(pa.list_(out.type.value_type)) if pa.types.is_list(out.type) else out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def places(values: pa.Array, known: pa.ChunkedArray) -> np.ndarray:
    """Where each value is in ``known``, -1 if nowhere."""
    known = _whole(known)
    if not len(known):
        return np.full(len(values), -1)
    return pc.fill_null(pc.index_in(values, value_set=known.cast(values.type)), -1).to_numpy(zero_copy_only=False)


def tokens_of(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(row number, token) of every token of a block, in order."""
    lists = pc.split_pattern(pc.fill_null(_whole(rows.column("toks")), ""), " ")
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    there = pc.not_equal(flat, "")  # an empty text is one empty piece
    return row[there.to_numpy(zero_copy_only=False)], flat.filter(there)


def owners(keys: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each row's key as a number, and the keys; null is a key."""
    code = _whole(keys).dictionary_encode(null_encoding="encode")
    return code.indices.to_numpy(zero_copy_only=False), code.dictionary


def position(row: np.ndarray) -> np.ndarray:
    """Places of tokens inside their rows."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))


def lists_of(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of the values, which are sorted by ``owner``; n owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def kind(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def look_up(stored: DataFrame, key: str, table: DataFrame, columns, strict: bool = False, token: str = "token") -> DataFrame:
    """(key, pos, token, *columns): every token with its entry of ``table``, at
    most one for a token; null without one, or an error if ``strict``."""
    columns = list(columns)

    def run(rows, known):
        row, toks = tokens_of(rows)
        at = places(toks, known.column(token))
        if strict and (at < 0).any():
            raise ValueError(f"token in no group: {toks[int(np.argmax(at < 0))]}")
        take = pa.array(at, mask=at < 0)
        return pa.Table.from_arrays([_whole(rows.column(key)).take(pa.array(row)), pa.array(position(row).astype(np.int32)), toks,
                                     *(_taken(known, c, take) for c in columns)], names=[key, "pos", token, *columns])

    schema = ", ".join([kind(stored, key), "pos int", f"`{token}` string", *(kind(table, c) for c in columns)])
    return met(stored.select("block", key, "toks"), exploded(stored, "block").withColumnRenamed("token", token),
               table.select(token, *columns), token, run, schema)


def look_up_lists(stored: DataFrame, key: str, table: DataFrame, columns, strict: bool = False, token: str = "token") -> DataFrame:
    """(key, items): one row for each key with tokens, its tokens' entries as an
    array of (pos, *columns) in order of place."""
    columns = list(columns)

    def run(rows, known):
        row, toks = tokens_of(rows)
        at = places(toks, known.column(token))
        if strict and (at < 0).any():
            raise ValueError(f"token in no group: {toks[int(np.argmax(at < 0))]}")
        code, keys = owners(rows.column(key))
        owner, pos = code[row], position(row).astype(np.int32)
        order = np.lexsort((pos, owner))
        at = at[order]
        take = pa.array(at, mask=at < 0)
        items = pa.StructArray.from_arrays([pa.array(pos[order]), *(_whole(known.column(c)).take(take) for c in columns)],
                                           names=["pos", *columns])
        lists = lists_of(owner[order], len(keys), items)
        there = pa.array(np.bincount(owner, minlength=len(keys)) > 0)
        return pa.Table.from_arrays([keys.filter(there), lists.filter(there)], names=[key, "items"])

    fields = ", ".join(["pos: int", *(f"`{c}`: {table.schema[c].dataType.simpleString()}" for c in columns)])
    return met(stored.select("block", key, "toks"), exploded(stored, "block").withColumnRenamed("token", token),
               table.select(token, *columns), token, run, f"{kind(stored, key)}, items array<struct<{fields}>>")
