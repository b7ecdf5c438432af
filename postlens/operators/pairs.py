"""The table of token pairs in packed cells.

IDs: FEA6.

Tokens have numbers from 0; number k is place ``k // parts`` of part ``k %
parts``, so no name is looked up.  A pair is held once, in the cell of its two
parts, with its count; a cell is cut into slices of rows, so that one slice is
worked on at a time.  The association of a pair, log(n(a,b) N / (n(a) n(b))), is
worked out from the counts whenever a cell is read.  A tall matrix is one packed
value for each part and goes to the cells of its part; cells give one value for
each side, which are added up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators import packed as PK
from postlens.operators.blocks import _whole
from postlens.operators.grid import _added, packed, unpacked
from postlens.session import cut_lineage, cut_lineage_by, stored

#: Pairs of one slice of a cell, as often as blocks have them, and of one cell.
SLICE, CELL = 2 << 20, 96 << 20
#: Tokens of one part at most.
PART = 100_000
#: Associations up to this are none.
LEAST = 1e-12


def _length(part: int, size: int, parts: int) -> int:
    return max(0, -(-(size - part) // parts))


def _cell(i, j, parts: int):
    """Number of the cell of parts i <= j."""
    return i * parts - i * (i - 1) // 2 + j - i


@dataclass
class PairCells:
    """``cells``: (cell, i, j, slice, lengths, steps, n); ``logs``: (part, v) with
    the logarithm of each token's pairs, ``all`` that of all; ``each``: (part, v)
    with the number and the sum of each token's associations above 0."""

    cells: DataFrame
    size: int
    parts: int
    slices: int
    first: int = 0
    logs: DataFrame | None = None
    all: float = 0.0
    each: DataFrame | None = None

    def times(self, tall: DataFrame, width: int) -> DataFrame:
        """(part, v): the associations times ``tall`` (part, v)."""
        return self._sums("times", width, tall)

    def _sums(self, what: str, width: int, tall: DataFrame | None = None) -> DataFrame:
        parts, slices, size, total = self.parts, self.slices, self.size, self.all
        others = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o")

        def dealt(table, name):
            low, high = F.least("part", "o"), F.greatest("part", "o")
            cell = low * parts - F.floor(low * (low - 1) / 2).cast("int") + high - low
            return table.select("part", "v", others).select(cell.cast("int").alias("cell"), "part", F.lit(name).alias("of"), "v")

        sent = None
        for table, name in ((tall, "v"), (self.logs, "l")):
            if table is not None:
                sent = dealt(table, name) if sent is None else sent.unionByName(dealt(table, name))

        def run(cell: pa.Table, given: pa.Table | None = None) -> pa.Table:
            if not cell.num_rows:
                return pa.table({"part": pa.array([], pa.int32()), "v": pa.array([], pa.binary())})
            i, j = (cell.column(c)[0].as_py() for c in "ij")
            n_i, n_j = (_length(p, size, parts) for p in (i, j))
            vectors = {} if given is None else {(given.column("of")[k].as_py(), given.column("part")[k].as_py()): given.column("v")[k]
                                                for k in range(given.num_rows)}
            v = {p: np.ascontiguousarray(unpacked(x, width).T) for (of, p), x in vectors.items() if of == "v"}
            log = {p: unpacked(x, 1)[:, 0] for (of, p), x in vectors.items() if of == "l"}
            out_i = np.zeros((width, n_i))
            out_j = out_i if i == j else np.zeros((width, n_j))
            for k in range(cell.num_rows):
                s = cell.column("slice")[k].as_py()
                first, there, row, column, n = PK.got(*(cell.column(c)[k] for c in ("lengths", "steps", "n")), n_j)
                mine = np.zeros((width, len(range(s, n_i, slices))))
                x = once = n.astype(float)
                if what != "counts":
                    # a token beside itself is one entry, which counts for both sides
                    alone = row * slices + s == column if i == j else np.zeros(len(x), bool)
                    x = np.log(np.where(alone, 2 * x, x)) + total - log[i][s::slices].take(row) - log[j].take(column)
                    x[x <= LEAST] = 0.0
                    once = np.where(alone, 0.0, x)
                if what == "times":
                    PK.row_sums(x, first, there, column, v[j], mine)
                    PK.column_sums(once, row, column, np.ascontiguousarray(v[i][:, s::slices]), out_j)
                else:
                    for at, (a, b) in enumerate(((x, once),) if what == "counts" else ((x > 0, once > 0), (x, once))):
                        mine[at] += np.bincount(row, a, mine.shape[1])
                        out_j[at] += np.bincount(column, b, n_j)
                out_i[:, s::slices] += mine
            out = [(i, out_i)] if i == j else [(i, out_i), (j, out_j)]
            return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "v": pa.array([packed(x.T) for _, x in out], pa.binary())})

        by = self.cells.groupBy("cell")
        each = by.applyInArrow(lambda cell: run(cell), "part int, v binary") if sent is None else by.cogroup(sent.groupBy("cell")).applyInArrow(
            run, "part int, v binary")
        return _added(each, width)

    def start(self, width: int) -> DataFrame:
        """(part, q): numbers between -1 and 1 from a hash of token and column;
        zeros for tokens without an association."""
        parts, first = self.parts, self.first

        def run(batches):
            for batch in batches:
                for part, each in zip(*batch.columns):
                    there = unpacked(each, 2)[:, :1] > 0
                    token = np.arange(len(there), dtype=np.uint64)[:, None] * np.uint64(parts) + np.uint64(part.as_py() + first)
                    h = token * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
                    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                        h = (h ^ (h >> np.uint64(by))) * np.uint64(times)
                    q = np.where(there, h.view(np.int64) / 2.0 ** 63, 0.0)
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([packed(q)], pa.binary())], ["part", "q"])

        return self.each.select("part", "v").mapInArrow(run, "part int, q binary")

    def named(self, tall: DataFrame, name: str, column: str, width: int, v: str = "v") -> DataFrame:
        """(name, column): the rows of ``tall`` of the tokens that have an
        association, as arrays."""
        parts, first = self.parts, self.first

        def run(batches):
            for batch in batches:
                for part, each, value in zip(*batch.columns):
                    there = np.flatnonzero(unpacked(each, 2)[:, 0] > 0)
                    x = unpacked(value, width)
                    for at in range(0, len(there), 10_000):
                        some = there[at:at + 10_000]
                        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
                        yield pa.RecordBatch.from_arrays([pa.array((some * parts + part.as_py() + first).astype(np.int32)),
                                                          pa.ListArray.from_arrays(offsets, pa.array(x[some].ravel()))], [name, column])

        both = self.each.select("part", F.col("v").alias("__each")).join(tall.select("part", F.col(v).alias("__v")), "part")
        return both.select("part", "__each", "__v").mapInArrow(run, f"`{name}` int, `{column}` array<double>")

    def tall(self, table: DataFrame, name: str, column: str, width: int) -> DataFrame:
        """(part, v): an array column of ``table`` packed by its tokens."""
        parts, first, size = self.parts, self.first, self.size
        number = F.col(name) - F.lit(first)
        given = table.select((number % parts).cast("int").alias("part"), F.floor(number / parts).cast("int").alias("at"), F.col(column).alias("x"))

        def run(part: pa.Table, rows: pa.Table) -> pa.Table:
            if not part.num_rows:
                return pa.table({"part": pa.array([], pa.int32()), "v": pa.array([], pa.binary())})
            out = np.zeros((_length(part.column("part")[0].as_py(), size, parts), width))
            if rows.num_rows:
                out[rows.column("at").to_numpy()] = _whole(rows.column("x")).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            return pa.Table.from_arrays([part.column("part").slice(0, 1), pa.array([packed(out)], pa.binary())], names=["part", "v"])

        return self.each.select("part").groupBy("part").cogroup(given.groupBy("part")).applyInArrow(run, "part int, v binary")


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")  # sorted runs
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def pair_cells(tokens: DataFrame, vocab: DataFrame, window: int = 2, column: str = "split", value: str = "train",
               slice_: int = SLICE, cell: int = CELL, part: int = PART) -> PairCells:
    """How often tokens of ``vocab`` (token, token_id, freq; the ids are without
    gaps) stand at most ``window`` places apart in the rows of packed ``tokens``
    that have the value."""
    spark = tokens.sparkSession
    about = vocab.agg(F.count(F.lit(1)).alias("size"), F.sum("freq").alias("freq"), F.min("token_id").alias("first")).first()
    size, first, most = about["size"], about["first"] or 0, window * int(about["freq"] or 0)
    cores = min(2 * spark.sparkContext.defaultParallelism, -(-most // (1 << 15)))
    parts = max(1, int(np.ceil(np.sqrt(2 * max(cores, -(-most // cell)) + 0.25) - 0.5)), -(-size // part))
    n_cells = parts * (parts + 1) // 2
    slices = max(1, min(-(-most // (n_cells * slice_)), -(-size // parts)))
    wide = max(1, _length(0, size, parts))  # the places of the longest part
    deep = -(-wide // slices)

    def block(rows: pa.Table, known: pa.Table) -> pa.Table:
        out = {c: [] for c in ("cell", "slice", "k", "n")}
        if rows.num_rows and known.num_rows:
            b = PK.Block(rows)
            row, code = b.tokens()
            mine = b.chosen(column, value)[row]
            row, code = row[mine], code[mine]
            number = np.full(max(int(code.max(initial=0)), int(known.column("code").to_numpy().max())) + 1, -1, np.int64)
            number[known.column("code").to_numpy()] = known.column("token_id").to_numpy() - first
            ids = number[code]
            found = []
            for d in range(1, window + 1):
                x, y = ids[:-d], ids[d:]
                there = (row[:-d] == row[d:]) & (x >= 0) & (y >= 0)
                x, y = x[there], y[there]
                # the lesser part is the row, inside a part the lesser token
                low = (x % parts < y % parts) | ((x % parts == y % parts) & (x <= y))
                a, c = np.where(low, x, y), np.where(low, y, x)
                r = a // parts
                group = _cell(a % parts, c % parts, parts) * slices + r % slices
                found.append((group * deep + r // slices) * wide + c // parts)
            key, n = np.unique(np.concatenate(found), return_counts=True)
            group = key // (deep * wide)
            ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(key) else []
            at = 0
            for end in ends:
                g = int(group[at])
                out["cell"].append(g // slices)
                out["slice"].append(g % slices)
                out["k"].append(PK.shrunk(np.diff(key[at:end] - g * deep * wide, prepend=0)))
                out["n"].append(PK.shrunk(n[at:end]))
                at = end
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))

    words = PK.block_words(tokens).join(vocab.select("token", "token_id"), "token").select(F.col("block").alias("__b"), "code", "token_id")
    counted = tokens.groupBy("block").cogroup(words.groupBy("__b")).applyInArrow(block, "cell int, slice int, k binary, n binary")
    of_cell = [(i, j) for i in range(parts) for j in range(i, parts)]

    def merge(given: pa.Table) -> pa.Table:
        number = given.column("cell")[0].as_py()
        i, j = of_cell[number]
        n_i, n_j = (_length(p, size, parts) for p in (i, j))
        at, out = given.column("slice").to_numpy(), []
        for s in np.unique(at):
            keys, counts, held = [], [], 0
            for k in np.flatnonzero(at == s):
                keys.append(np.cumsum(PK.grown(given.column("k")[int(k)]), dtype=np.int64))
                counts.append(PK.grown(given.column("n")[int(k)]).astype(np.int64))
                held += len(keys[-1])
                if held > 2 * slice_ and held > 2 * len(keys[0]):  # what blocks share is added up before more is read
                    key, n = _merged(keys, counts)
                    keys, counts, held = [key], [n], len(key)
            key, n = _merged(keys, counts)
            key = key // wide * n_j + key % wide
            out.append((number, i, j, int(s), *PK.put(key, n, len(range(int(s), n_i, slices)), n_j)))
        kinds = [pa.int32()] * 4 + [pa.binary()] * 3
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["cell", "i", "j", "slice", "lengths", "steps", "n"])

    cells = cut_lineage_by(counted.groupBy("cell").applyInArrow(
        merge, "cell int, i int, j int, slice int, lengths binary, steps binary, n binary"), "cell", n_cells)
    found = PairCells(cells, size, parts, slices, first)
    sums = stored(found._sums("counts", 1))
    total = sums.mapInArrow(_total, "s double").agg(F.sum("s")).first()[0]
    found.all = float(np.log(total)) if total else 0.0
    found.logs = cut_lineage(sums.mapInArrow(_logs, "part int, v binary"))
    found.each = cut_lineage(found._sums("each", 2))
    return found


def _total(batches):
    for batch in batches:
        for value in batch.column("v"):
            yield pa.RecordBatch.from_arrays([pa.array([float(unpacked(value, 1).sum())])], ["s"])


def _logs(batches):
    for batch in batches:
        for part, value in zip(batch.column("part"), batch.column("v")):
            v = unpacked(value, 1)
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([packed(np.log(np.where(v > 0, v, 1.0)))], pa.binary())],
                                             ["part", "v"])
