"""A sparse table of numbers in cells, multiplied with tall matrices.

Rows and columns have names; names are dealt to parts by their hash and numbered
inside a part.  The entries of row part i and column part j are one cell, packed
as three arrays.  A tall matrix is a table with one packed row for each part; for
a product it is repeated for the cells of its part, so that the entries, by far
the most, are never shuffled again.  The driver sees numbers of parts only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.blocks import _whole, places
from postlens.session import cut_lineage, cut_lineage_by

#: Entries of a cell.
CELL = 1 << 20


def unpacked(value, width: int) -> np.ndarray:
    """The (names, width) numbers of a packed value."""
    return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, width)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sums over all tasks of the ``size`` numbers that ``run`` gives for the
    packed values of a part (a list, one for each column)."""
    def task(batches):
        total = np.zeros(size)
        for batch in batches:
            for values in zip(*batch.columns):
                total += run(*values).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "s"])

    out = np.zeros(size)
    for r in rows.mapInArrow(task, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out


def mapped(parts: DataFrame, run, given: list[str], made: list[str]) -> DataFrame:
    """(part, *made): packed values made of each part's ``given`` ones."""
    def task(batches):
        for batch in batches:
            for part, *values in zip(*batch.columns):
                # values that are handed on stay packed
                out = [x.as_py() if isinstance(x, pa.Scalar) else packed(x) for x in run(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in out)],
                                                 ["part", *made])

    return parts.select("part", *given).mapInArrow(task, ", ".join(["part int", *(f"`{c}` binary" for c in made)]))


def part_of(name, n: int):
    return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(n)).cast("int")


def _parts(names: DataFrame, name: str, n: int) -> DataFrame:
    """(part, names): the distinct names of each part, in order, as text."""
    def run(table: pa.Table) -> pa.Table:
        held = _whole(table.column("name"))
        held = held.take(pc.sort_indices(held))
        return pa.Table.from_arrays([table.column("part").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)],
                                    names=["part", "names"])

    return cut_lineage(names.where(F.col(name).isNotNull()).select(part_of(name, n).alias("part"), F.col(name).cast("string").alias("name"))
                       .distinct().groupBy("part").applyInArrow(run, "part int, names array<string>"))


@dataclass
class Grid:
    """``rows``, ``columns``: (part, names); ``cells``: (cell, i, j, r, c, x)."""

    rows: DataFrame
    columns: DataFrame
    cells: DataFrame
    n_rows: int
    n_columns: int

    def times(self, tall: DataFrame, width: int) -> DataFrame:
        """(part, v) of the rows: the table times ``tall`` (part, v) of the columns."""
        return self._product(tall, width, "j", "i", "c", "r", self.n_columns, self.n_rows)

    def back(self, tall: DataFrame, width: int) -> DataFrame:
        """(part, v) of the columns: the table turned over times ``tall`` of the rows."""
        return self._product(tall, width, "i", "j", "r", "c", self.n_rows, self.n_columns)

    def squares(self) -> DataFrame:
        """(part, v) of the columns: the sums of their entries' squares."""
        def run(cell: pa.Table) -> pa.Table:
            c, x = np.frombuffer(cell.column("c")[0].as_buffer(), np.int32), np.frombuffer(cell.column("x")[0].as_buffer())
            return pa.Table.from_arrays([cell.column("j").slice(0, 1), pa.array([packed(np.bincount(c, x * x, cell.column("n_c")[0].as_py()))],
                                                                                pa.binary())], names=["part", "v"])

        return _added(self.cells.groupBy("cell").applyInArrow(run, "part int, v binary"), 1)

    def _product(self, tall, width, side, other, at, to, n, n_other):
        place = {"i": F.col("part") * F.lit(self.n_columns) + F.col("__o"), "j": F.col("__o") * F.lit(self.n_columns) + F.col("part")}
        sent = tall.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).select(place[side].alias("cell"), "v")

        def run(cell, vector):
            out = []
            if cell.num_rows and vector.num_rows:
                v = unpacked(vector.column("v")[0], width)
                a, b = (np.frombuffer(cell.column(c)[0].as_buffer(), np.int32) for c in (at, to))
                short = cell.column(f"n_{at}")[0].as_py() - len(v)  # names at the end that no row has
                v = np.r_[v, np.zeros((short, width))] if short > 0 else v
                x, size = np.frombuffer(cell.column("x")[0].as_buffer()), cell.column(f"n_{to}")[0].as_py()
                out.append(packed(np.stack([np.bincount(b, x * v[:, k][a], size) for k in range(width)], 1)))
            part = cell.column(other).slice(0, len(out)) if out else pa.array([], pa.int32())
            return pa.Table.from_arrays([part, pa.array(out, pa.binary())], names=["part", "v"])

        return _added(self.cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, "part int, v binary"), width)


def _added(each: DataFrame, width: int) -> DataFrame:
    """(part, v): the packed matrices of a part added up."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(unpacked(v, width) for v in _whole(table.column("v")))
        return pa.Table.from_arrays([table.column("part").slice(0, 1), pa.array([packed(total)], pa.binary())], names=["part", "v"])

    return each.groupBy("part").applyInArrow(add, "part int, v binary")


def _pack(entries: pa.Table, index: pa.Table) -> pa.Table:
    sides = dict(zip(index.column("side").to_pylist(), _whole(index.column("names"))))
    if not entries.num_rows or len(sides) < 2:
        return pa.table({"cell": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in "rcx"},
                         "n_r": pa.array([], pa.int32()), "n_c": pa.array([], pa.int32())})
    r, c = (places(_whole(entries.column(s)), pa.chunked_array([sides[s].values])) for s in "rc")
    there = (r >= 0) & (c >= 0)
    x = entries.column("x").to_numpy()
    return pa.table({"cell": entries.column("cell").slice(0, 1), "r": pa.array([r[there].astype(np.int32).tobytes()], pa.binary()),
                     "c": pa.array([c[there].astype(np.int32).tobytes()], pa.binary()),
                     "x": pa.array([x[there].astype(np.float64).tobytes()], pa.binary()),
                     "n_r": pa.array([len(sides["r"].values)], pa.int32()), "n_c": pa.array([len(sides["c"].values)], pa.int32())})


def grid(entries: DataFrame, row: str, column: str, x: str, row_names: DataFrame | None = None,
         cell: int = CELL, square: bool = False) -> Grid:
    """The table ``entries`` (row, column, x).  ``row_names``: the rows, if more
    than ``entries`` has.  ``square``: rows and columns have the same parts."""
    spark = entries.sparkSession
    held = row_names if row_names is not None else entries
    count = entries.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(column).alias("c")).first()
    n_names = held.agg(F.approx_count_distinct(row)).first()[0]
    cells = max(-(-count["n"] // cell), min(spark.sparkContext.defaultParallelism, -(-count["n"] // max(1, cell // 32))), 1)
    # vectors are repeated for the parts of the other side
    up = int(np.ceil(np.sqrt(cells))) if square else int(np.clip(round(np.sqrt(cells * (n_names + 1) / (count["c"] + 1))), 1, cells))
    n_rows, n_columns = up, up if square else -(-cells // up)
    rows = _parts(held.select(row), row, n_rows)
    columns = rows if square else _parts(entries.select(column), column, n_columns)
    flat = entries.select((part_of(row, n_rows) * F.lit(n_columns) + part_of(column, n_columns)).alias("cell"),
                          F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c"), F.col(x).cast("double").alias("x"))
    o = F.explode(F.sequence(F.lit(0), F.lit(n_columns - 1)))
    names = rows.withColumn("__o", o).select((F.col("part") * F.lit(n_columns) + F.col("__o")).alias("cell"), F.lit("r").alias("side"), "names")
    o = F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))
    names = names.unionByName(columns.withColumn("__o", o).select(
        (F.col("__o") * F.lit(n_columns) + F.col("part")).alias("cell"), F.lit("c").alias("side"), "names"))
    table = flat.groupBy("cell").cogroup(names.groupBy("cell")).applyInArrow(
        _pack, "cell int, r binary, c binary, x binary, n_r int, n_c int")
    table = table.select("cell", F.floor(F.col("cell") / n_columns).cast("int").alias("i"), (F.col("cell") % n_columns).alias("j"),
                         "r", "c", "x", "n_r", "n_c")
    return Grid(rows, columns, cut_lineage_by(table, "cell", n_rows * n_columns), n_rows, n_columns)


def to_parts(parts: DataFrame, n: int, table: DataFrame, name: str, column: str, width: int) -> DataFrame:
    """(part, v): an array column of ``table`` packed by names; names that it
    lacks have zeros."""
    given = table.select(part_of(name, n).alias("part"), F.col(name).cast("string").alias("name"), F.col(column).alias("x"))

    def run(names, rows):
        if not names.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "v": pa.array([], pa.binary())})
        held = names.column("names")[0].values
        out = np.zeros((len(held), width))
        if rows.num_rows:
            at = places(_whole(rows.column("name")), pa.chunked_array([held]))
            x = _whole(rows.column("x")).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            out[at[at >= 0]] = x[at >= 0]
        return pa.Table.from_arrays([names.column("part").slice(0, 1), pa.array([packed(out)], pa.binary())], names=["part", "v"])

    return parts.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(run, "part int, v binary")


def from_parts(parts: DataFrame, tall: DataFrame, name: str, of_kind: str, column: str, width: int, v: str = "v") -> DataFrame:
    """(name, column): the rows of a packed matrix under their names."""
    def run(batches):
        for batch in batches:
            for names, value in zip(batch.column(0), batch.column(1)):
                x = unpacked(value, width)
                for at in range(0, len(x), 10_000):
                    some = x[at:at + 10_000]
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays([names.values.slice(at, len(some)), pa.ListArray.from_arrays(offsets, pa.array(some.ravel()))],
                                                     ["name", column])

    flat = parts.join(tall.select("part", F.col(v).alias("__v")), "part").select("names", "__v").mapInArrow(
        run, f"name string, `{column}` array<double>")
    return flat.select(F.col("name").cast(of_kind).alias(name), column)
