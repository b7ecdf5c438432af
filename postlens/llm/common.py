"""Shared helpers: bounded Arrow batches, table access, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import ensure_checkpoint_dir, spread_text

#: Rows per Arrow batch handed to a Python worker; with texts of a few
#: kilobytes this keeps a batch at a few megabytes.
ARROW_ROWS = 1000
#: A worker works on slices of about this many bytes of text at a time.
SLICE_BYTES = 2 << 20


_HELD: dict = {}


def held(key: tuple, make):
    """What ``make()`` gives, kept by this Python worker for later tasks.  One
    thing is kept at a time: an operator that needs another drops it, so the
    stages of a pipeline do not add up their stores in a worker."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what this worker keeps, and give back what Arrow holds free; for
    operators that need the room.  (One Python step to a stage also matters: a
    stage of two has two workers for each task, and later tasks take turns among
    all of them.)"""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; documents are spread over tasks where a benchmark on
    files of one row group asks for it (:func:`postlens.session.spread_text`)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_text(rows) if name == "documents" else rows


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller user setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): only these two columns are read; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(keys, texts) lists of about ``slice_bytes`` each; one very long text is
    a slice of its own."""
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        start, size = 0, 0
        lengths = pc.binary_length(column).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= slice_bytes or i + 1 == len(lengths):
                yield keys[start:i + 1].to_pylist(), column[start:i + 1].to_pylist()
                start, size = i + 1, 0


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each text starts."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def arrow_slices(batches: Iterator[pa.RecordBatch], text: int, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of about ``slice_bytes`` of the text in column ``text``; one very
    long text is a part of its own."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + slice_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(slices: Iterator[tuple[list, list]], size: int) -> Iterator[tuple[list, list]]:
    """Slices put together to about ``size`` characters."""
    keys, texts, n = [], [], 0
    for some, more in slices:
        keys += some
        texts += more
        n += sum(map(len, more))
        if n >= size:
            yield keys, texts
            keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps do not
    recompute it, also when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Groups that a join may broadcast: a few hundred bytes each.
FEW_GROUPS = 20_000
SALTS = 32


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with one row per ``key`` of ``groups``.  Few groups (the
    number is counted) are broadcast; else the rows of each group are salted
    and its row repeated, so that a large group is spread over many tasks."""
    if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), key)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            .join(salted, [key, "_salt"]).drop("_salt"))


def judged_rows(docs: DataFrame, text_col: str, make_judge, columns: str = "", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with every column as it is, judged by whole texts (null: empty).

    ``make_judge()`` is called once per task and gives a function from a list
    of texts to a mask of rows to keep or, with ``columns`` ("name type, ..."),
    to lists of values that are added under these names.  ``keep``: the columns
    of ``docs`` to return, if not all.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = docs.columns if keep is None else keep
    places = [docs.columns.index(c) for c in kept]
    names = [*kept, *(c.split()[0] for c in columns.split(", ") if c)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *([columns] if columns else [])])
    kinds = {"long": pa.int64(), "double": pa.float64()}
    added = [kinds[c.split()[1]] for c in columns.split(", ") if c]

    def run(batches):
        judge = make_judge()
        for batch in batches:
            text = batch.column(at)
            start = 0
            keyless = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], ["key", "text"])
            for rows, texts in text_slices([keyless]):
                part = batch.slice(start, len(rows)).select(places)
                start += len(rows)
                said = judge([t or "" for t in texts])
                if columns:
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(said, added))], names)
                else:
                    yield part.filter(pa.array(said, pa.bool_()))

    return docs.mapInArrow(run, schema)
