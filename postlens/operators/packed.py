"""Tokens of rows, packed block by block, and sparse tables in packed cells.

A block is one row: the keys of its rows, its distinct words and its tokens as
places among them, each compressed, about a quarter of the text.  What looks at
all tokens (counts, pairs, term counts) works on a block's numbers at once and
hands on one packed value for each cell of a table instead of a row for each
entry.  Entries of a cell are sorted; the steps from one to the next and the
counts are stored in as few bytes as they take.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators.blocks import _whole, kind, tokens_of
from postlens.session import cut_lineage_by


def shrunk(x: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte of their places, compressed."""
    width = np.min_scalar_type(int(x.max()) if len(x) else 0)
    planes = np.ascontiguousarray(np.ascontiguousarray(x.astype(width)).view(np.uint8).reshape(len(x), width.itemsize).T)
    return struct.pack("<BQ", width.itemsize, len(x)) + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def grown(value) -> np.ndarray:
    """What :func:`shrunk` was given, in the type that it takes."""
    buffer = value.as_buffer() if isinstance(value, pa.Scalar) else pa.py_buffer(value)
    width, n = struct.unpack("<BQ", buffer.slice(0, 9).to_pybytes())
    flat = np.frombuffer(pa.Codec("zstd").decompress(buffer.slice(9), width * n), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).reshape(-1).view(f"<u{width}")


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def table_of(value) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer() if isinstance(value, pa.Scalar) else value).read_all()


def packed_tokens(df: DataFrame, key: str, text: str, keep=(), n: int = 1) -> DataFrame:
    """(block, rows, words, lengths, codes): a row for each partition of ``df``,
    which has the rows of one key in one.  ``rows``: key and ``keep`` of each
    row; ``words``: the block's distinct tokens; ``lengths``: tokens of each row;
    ``codes``: places of the tokens in ``words``."""
    names = [key, *keep]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        row, toks = tokens_of(whole)
        coded = toks.dictionary_encode()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()),
             *(pa.array([x], pa.binary()) for x in (
                 table_bytes(whole.select(names)), table_bytes(pa.table({"token": coded.dictionary})),
                 shrunk(np.bincount(row, minlength=whole.num_rows)), shrunk(coded.indices.to_numpy(zero_copy_only=False))))],
            ["block", "rows", "words", "lengths", "codes"])

    rows = df.select(*names, T.token_text(text).alias("toks"))
    packed = rows.mapInArrow(run, "block int, rows binary, words binary, lengths binary, codes binary")
    return cut_lineage_by(packed, "block", n)


class Block:
    """One row of :func:`packed_tokens`."""

    def __init__(self, table: pa.Table, at: int = 0):
        self._table, self._at = table, at
        self.block = table.column("block")[at].as_py()

    def _of(self, name: str):
        return self._table.column(name)[self._at]

    @property
    def rows(self) -> pa.Table:
        return table_of(self._of("rows"))

    @property
    def words(self) -> pa.Array:
        return _whole(table_of(self._of("words")).column("token"))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``words``) of every token, in order."""
        lengths = grown(self._of("lengths"))
        return np.repeat(np.arange(len(lengths)), lengths), grown(self._of("codes"))

    def chosen(self, column: str, value) -> np.ndarray:
        """Which rows have the value."""
        return pc.fill_null(pc.equal(_whole(self.rows.column(column)), value), False).to_numpy(zero_copy_only=False)


def each_block(packed: DataFrame, run, schema: str) -> DataFrame:
    """``run(Block)`` gives a table."""
    def task(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield from run(Block(pa.Table.from_batches([batch.slice(at, 1)]))).to_batches()

    return packed.mapInArrow(task, schema)


def word_counts(packed: DataFrame, column: str = "split", value: str = "train") -> DataFrame:
    """(block, code, token, freq): the words of each block and how often they
    come in its rows with the value, which may be 0."""
    def run(b: Block) -> pa.Table:
        row, code = b.tokens()
        words = b.words
        freq = np.bincount(code[b.chosen(column, value)[row]], minlength=len(words))
        return pa.table({"block": pa.array(np.full(len(words), b.block, np.int32)), "code": pa.array(np.arange(len(words), dtype=np.int32)),
                         "token": words.cast(pa.string()), "freq": pa.array(freq.astype(np.int64))})

    return each_block(packed, run, "block int, code int, token string, freq long")


def block_words(packed: DataFrame) -> DataFrame:
    """(block, code, token) of each block's words."""
    def run(b: Block) -> pa.Table:
        words = b.words
        return pa.table({"block": pa.array(np.full(len(words), b.block, np.int32)), "code": pa.array(np.arange(len(words), dtype=np.int32)),
                         "token": words.cast(pa.string())})

    return each_block(packed, run, "block int, code int, token string")


def block_keys(packed: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """(block, key) of each block's distinct keys; ``of`` has their type."""
    def run(b: Block) -> pa.Table:
        keys = _whole(b.rows.column(key)).unique()
        keys = keys.filter(keys.is_valid())
        return pa.table({"block": pa.array(np.full(len(keys), b.block, np.int32)), key: keys})

    return each_block(packed, run, f"block int, {kind(of, key)}")


# --- cells


def put(key: np.ndarray, n: np.ndarray, n_rows: int, n_columns: int) -> list[bytes]:
    """Entries of a cell, sorted by row times ``n_columns`` plus column, with
    their counts: entries of each row, steps, counts."""
    return [shrunk(np.bincount(key // n_columns, minlength=n_rows)), shrunk(np.diff(key, prepend=0)), shrunk(n)]


def got(lengths, steps, n, n_columns: int):
    """(first entry of each row that has some, these rows, row, column, count)
    of the entries of :func:`put`."""
    lengths = grown(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.cumsum(grown(steps), dtype=np.int64)
    column -= row * n_columns
    there = np.flatnonzero(lengths)
    return (np.cumsum(lengths, dtype=np.int64) - lengths)[there], there, row, column, grown(n)


def row_sums(x: np.ndarray, first: np.ndarray, there: np.ndarray, column: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
    """Adds x times the entries of ``v`` (width, columns) to ``out`` (width, rows)."""
    if len(x):
        for k in range(len(v)):
            out[k, there] += np.add.reduceat(x * v[k].take(column), first)


def column_sums(x: np.ndarray, row: np.ndarray, column: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
    """Adds x times the entries of ``v`` (width, rows) to ``out`` (width, columns)."""
    if len(x):
        for k in range(len(v)):
            out[k] += np.bincount(column, x * v[k].take(row), out.shape[1])
