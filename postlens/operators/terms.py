"""Terms of rows in packed cells, made from packed tokens.

IDs: FEA4 (text as term rows), MLJ4-MLJ7.

A cell holds the rows of some blocks and one part of the terms: for each block
the counts of its rows' terms, in the form of :mod:`postlens.operators.packed`.
A term's weight idf goes to the cells beside the matrix that they are multiplied
with, so a cell holds small whole numbers alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators import packed as PK
from postlens.operators.blocks import _whole, places
from postlens.operators.gradient import TermGrid
from postlens.operators.grid import _added, _parts, packed, to_parts, unpacked
from postlens.session import cut_lineage, cut_lineage_by, stored

#: Terms of one part, and rows of one part, at most.
TERMS, ROWS = 100_000, 1 << 20


def term_idf(tokens: DataFrame, key: str, rows: DataFrame, min_rows: int = 10, column: str = "split", value: str = "train") -> DataFrame:
    """(term, idf) as of :func:`postlens.operators.gradient.term_table`, of the
    packed tokens' rows that have the value; ``rows``: these rows."""
    def run(b: PK.Block) -> pa.Table:
        row, code = b.tokens()
        words, keys = b.words, _whole(b.rows.column(key)).dictionary_encode()
        owner = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        owner = np.where(b.chosen(column, value), owner, -1)[row]
        pair = np.unique(owner[owner >= 0].astype(np.int64) * max(1, len(words)) + code[owner >= 0])
        df = np.bincount(pair % max(1, len(words)), minlength=len(words))
        return pa.table({"token": words.cast(pa.string()), "df": pa.array(df.astype(np.int64))}).filter(pa.array(df > 0))

    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    return (PK.each_block(tokens, run, "token string, df long").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= min_rows)
            .crossJoin(F.broadcast(total)).select(F.concat(F.lit("t:"), "token").alias("term"),
                                                  F.log((F.col("__total") + 1) / (F.col("df") + 1)).alias("idf")))


@dataclass
class TermCells:
    """``cells``: (cell, i, j, block, n_r, lengths, steps, n); ``columns``: (part,
    names); ``idf``: (part, v)."""

    cells: DataFrame
    columns: DataFrame
    idf: DataFrame
    n_rows: int
    n_columns: int
    sizes: dict

    def times(self, tall: DataFrame, width: int) -> DataFrame:
        """(part, v) of the rows: the table times ``tall`` (part, v) of the columns."""
        return self._product("times", width, tall, "j", "i")

    def back(self, tall: DataFrame, width: int) -> DataFrame:
        """(part, v) of the columns: the table turned over times ``tall`` of the rows."""
        return self._product("back", width, tall, "i", "j")

    def squares(self) -> DataFrame:
        """(part, v) of the columns: the sums of their entries' squares."""
        return self._product("squares", 1, None, None, "j")

    def _product(self, what: str, width: int, tall, side, other: str) -> DataFrame:
        n_rows, n_columns, sizes = self.n_rows, self.n_columns, self.sizes

        def dealt(table, side, name):
            o = F.explode(F.sequence(F.lit(0), F.lit((n_rows if side == "j" else n_columns) - 1)))
            place = F.col("o") * n_columns + F.col("part") if side == "j" else F.col("part") * n_columns + F.col("o")
            return table.select("part", "v", o.alias("o")).select(place.cast("int").alias("cell"), F.lit(name).alias("of"), "v")

        sent = dealt(self.idf, "j", "idf")
        if tall is not None:
            sent = sent.unionByName(dealt(tall, side, "v"))

        def run(cell: pa.Table, given: pa.Table) -> pa.Table:
            held = dict(zip(given.column("of").to_pylist(), _whole(given.column("v")))) if given.num_rows else {}
            if not cell.num_rows or (what != "squares" and "v" not in held):
                return pa.table({"part": pa.array([], pa.int32()), "v": pa.array([], pa.binary())})
            n_c = sizes.get(cell.column("j")[0].as_py(), 0)
            idf = unpacked(held["idf"], 1)[:, 0] if "idf" in held else np.ones(n_c)
            length = cell.column("n_r").to_numpy()
            out = np.zeros((width, int(length.sum()) if what == "times" else n_c))
            if what == "times":
                v = np.ascontiguousarray((unpacked(held["v"], width) * idf[:, None]).T)
            elif what == "back":
                v = np.ascontiguousarray(unpacked(held["v"], width).T)
            order = np.argsort(cell.column("block").to_numpy())
            start = np.zeros(len(order), int)
            start[order] = np.cumsum(length[order]) - length[order]
            for k in range(cell.num_rows if n_c else 0):
                first, there, row, column, n = PK.got(*(cell.column(c)[k] for c in ("lengths", "steps", "n")), n_c)
                x, mine = n.astype(float), slice(int(start[k]), int(start[k] + length[k]))
                if what == "times":
                    PK.row_sums(x, first, there, column, v, out[:, mine])
                elif what == "back":
                    PK.column_sums(x, row, column, np.ascontiguousarray(v[:, mine]), out)
                else:
                    out[0] += np.bincount(column, x * x, n_c)
            if what != "times":
                out = out * (idf if what == "back" else idf * idf)
            return pa.Table.from_arrays([cell.column(other).slice(0, 1), pa.array([packed(out.T)], pa.binary())], names=["part", "v"])

        return _added(self.cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, "part int, v binary"), width)


@dataclass
class PackedTerms(TermGrid):
    """``rows`` with their ``__block`` and a number ``__row`` each; inside a part
    they stand in the order of block and number."""

    def packed_rows(self, values, width: int) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("__block", "ascending"), ("__row", "ascending")])
            x = _whole(table.column("y")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return pa.Table.from_arrays([table.column("part").slice(0, 1), pa.array([packed(x)], pa.binary())], names=["part", "v"])

        return self.rows.select(_part(self.cells.n_rows).alias("part"), "__block", "__row", values.alias("y")).groupBy("part").applyInArrow(
            run, "part int, v binary")

    def by_row(self, tall: DataFrame, column: str, width: int) -> DataFrame:
        def run(rows: pa.Table, given: pa.Table) -> pa.Table:
            rows = rows.sort_by([("__block", "ascending"), ("__row", "ascending")])
            n = rows.num_rows if given.num_rows else 0
            x = unpacked(given.column("v")[0], width) if n else np.zeros((0, width))
            return pa.table({"__row": rows.column("__row").slice(0, n), column: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))})

        return self.rows.select(_part(self.cells.n_rows).alias("part"), "__block", "__row").groupBy("part").cogroup(
            tall.groupBy("part")).applyInArrow(run, f"__row long, `{column}` array<double>")


def _part(n: int):
    return F.pmod(F.col("__block"), F.lit(n)).cast("int")


def in_blocks(tokens: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``__block`` that holds their key, -1 if none does."""
    return rows.join(PK.block_keys(tokens, key, rows), key, "left").withColumn("__block", F.coalesce("block", F.lit(-1))).drop("block")


def entries_of(b: PK.Block, keys: pa.Array, key: str, number: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count): the entries of rows with these keys, in their order;
    ``number``: the column of each word, -1 if none, below ``wide``."""
    distinct = keys.dictionary_encode()
    held = distinct.indices.fill_null(-1).to_numpy(zero_copy_only=False)  # a row without a key has no terms
    owner = places(_whole(b.rows.column(key)), pa.chunked_array([distinct.dictionary]))
    owner = np.where(_whole(b.rows.column(key)).is_valid().to_numpy(zero_copy_only=False), owner, -1)
    row, code = b.tokens()
    own, column = owner[row].astype(np.int64), number[code]
    mine = (own >= 0) & (column >= 0)
    pair, n = np.unique(own[mine] * wide + column[mine], return_counts=True)
    own, column = pair // wide, pair % wide
    first = np.searchsorted(own, np.arange(len(distinct.dictionary) + 1))
    length = np.where(held >= 0, np.diff(first)[held], 0) if len(first) > 1 else np.zeros(len(held), int)
    at = np.repeat((first[held] if len(first) > 1 else 0) - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return np.repeat(np.arange(len(held)), length), column[at], n[at]


def packed_terms(tokens: DataFrame, table: DataFrame, rows: DataFrame, key: str = "row_idx") -> PackedTerms:
    """The terms of ``table`` (term, idf) of ``rows`` (key, *labels), which are
    rows of the packed ``tokens``.  Rows of one key all have its terms."""
    spark = tokens.sparkSession
    held = stored(in_blocks(tokens, rows, key).withColumn("__row", F.monotonically_increasing_id()))
    n_held, n_terms = held.count(), table.count()
    cores = 2 * spark.sparkContext.defaultParallelism
    up = int(np.clip(round(np.sqrt(cores * (n_held + 1) / (n_terms + 1))), 1, cores))
    n_rows, n_columns = max(up, -(-n_held // ROWS), 1), max(-(-min(cores, -(-n_terms // 256)) // up), -(-n_terms // TERMS), 1)
    columns = _parts(table.select("term"), "term", n_columns)
    idf = cut_lineage(to_parts(columns, n_columns, table.select("term", F.array("idf").alias("idf")), "term", "idf", 1))
    sizes = {r["part"]: r["n"] for r in columns.select("part", F.size("names").alias("n")).collect()}  # a number for each part
    wide = max([1, *sizes.values()])

    def block(given: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        mine = side.filter(side.column("__row").is_valid()).sort_by("__row") if side.num_rows else side
        if mine.num_rows:
            number = mine.column("__b")[0].as_py()
            row, column, n = (np.zeros(0, np.int64),) * 3
            if given.num_rows:
                words = side.filter(side.column("code").is_valid())
                b = PK.Block(given)
                to = np.full(len(b.words), -1, np.int64)
                to[words.column("code").to_numpy()] = words.column("column").to_numpy()
                row, column, n = entries_of(b, _whole(mine.column("__key")), key, to, wide * n_columns)
            part = column // wide
            order = np.argsort(part, kind="stable")
            row, column, n, part = row[order], column[order] % wide, n[order], part[order]
            ends = np.searchsorted(part, np.arange(n_columns + 1))
            for j in range(n_columns):
                at, n_c = slice(ends[j], ends[j + 1]), max(1, sizes.get(j, 0))
                out.append((number % n_rows * n_columns + j, number % n_rows, j, number, mine.num_rows,
                            *PK.put(row[at] * n_c + column[at], n[at], mine.num_rows, n_c)))
        kinds = [pa.int32()] * 5 + [pa.binary()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 8, kinds)],
                        names=["cell", "i", "j", "block", "n_r", "lengths", "steps", "n"])

    named = columns.select("part", F.posexplode("names").alias("c", "term")).select("term", (F.col("part") * wide + F.col("c")).cast("long").alias("column"))
    words = PK.block_words(tokens).select(F.col("block").alias("__b"), "code", F.concat(F.lit("t:"), "token").alias("term")).join(named, "term").drop("term")
    wanted = held.select(F.col("__block").alias("__b"), "__row", F.col(key).alias("__key"))
    side = words.unionByName(wanted, allowMissingColumns=True)
    made = tokens.groupBy("block").cogroup(side.groupBy("__b")).applyInArrow(
        block, "cell int, i int, j int, block int, n_r int, lengths binary, steps binary, n binary")
    return PackedTerms(held, TermCells(cut_lineage_by(made, "cell", n_rows * n_columns), columns, idf, n_rows, n_columns, sizes))


def group_sums(tokens: DataFrame, table: DataFrame, rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, items): for each distinct key of ``rows`` with a word of ``table``
    (token, fine, w) the groups ``fine`` of its words, each with sums c of the
    words' ``width`` weights."""
    held = in_blocks(tokens, rows.select(key).where(F.col(key).isNotNull()).distinct(), key)
    kinds = PK.kind(rows, key)

    def block(given: pa.Table, side: pa.Table) -> pa.Table:
        keys, items = pa.array([], side.schema.field("__key").type), []
        wanted = _whole(side.filter(side.column("__key").is_valid()).column("__key")) if side.num_rows else keys
        offsets, fine_of, sums = np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros((0, width))
        if given.num_rows and len(wanted):
            words = side.filter(side.column("code").is_valid())
            b = PK.Block(given)
            code, fine = words.column("code").to_numpy(), words.column("fine").to_numpy()
            to = np.full(len(b.words), -1, np.int64)
            to[code] = np.arange(len(code))
            row, at, n = entries_of(b, wanted, key, to, max(1, len(code)))
            w = _whole(words.column("w")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            deep = int(fine.max(initial=0)) + 1
            group = row * deep + fine[at]
            there, group = np.unique(group, return_inverse=True)
            sums = np.stack([np.bincount(group, n * w[at, k], len(there)) for k in range(width)], 1)
            fine_of = (there % deep).astype(np.int32)
            has = np.bincount(there // deep, minlength=len(wanted))
            keys = wanted.filter(pa.array(has > 0))
            offsets = np.r_[0, np.cumsum(has[has > 0])].astype(np.int32)
        sums_list = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
        items = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(fine_of), sums_list], names=["fine", "c"]))
        return pa.Table.from_arrays([keys, items], names=[key, "items"])

    words = PK.block_words(tokens).join(table, "token").select(F.col("block").alias("__b"), "code", "fine", "w")
    side = words.unionByName(held.select(F.col("__block").alias("__b"), F.col(key).alias("__key")), allowMissingColumns=True)
    return tokens.groupBy("block").cogroup(side.groupBy("__b")).applyInArrow(
        block, f"{kinds}, items array<struct<fine: int, c: array<double>>>")
