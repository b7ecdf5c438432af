"""Linear models whose vocabulary and weights are tables.

IDs: MLJ4, MLJ5, MLJ6, MLJ7 (weights as a table), FEA4 (text as term rows).

Rows are term rows (row, term, x), packed once in the cells of a grid; weights
are a table (term, w) with one number for each output.  A step multiplies the
cells with the current direction, which gives sums per row, and with the rows'
errors, which gives sums per term; the terms are not shuffled again.  The driver
sees a
handful of numbers for each output: intercepts, step lengths, squared lengths
of gradients.  Several models (squared error, binary or several classes) are
fitted in the same passes over the terms.

The method is conjugate gradients with the squares' means as a scale per term
and a search along each direction for the place where the slope is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import tokenize
from postlens.operators.grid import Grid, from_parts, grid, mapped, summed, to_parts, unpacked
from postlens.operators.skew import salted_join
from postlens.session import forget, stored

#: Newton steps on the intercepts alone, at the end.
INTERCEPT_STEPS = 5
#: Where the slope is taken along a direction, as multiples of the first guess.
_STEPS = np.array([0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0])


@dataclass
class Head:
    """One model: ``loss`` is "squared", "binary" (labels 0 and 1) or "classes"
    (labels 0 .. n_classes - 1).  ``label`` is a column of the rows; rows whose
    label is null are not part of this model."""

    name: str
    label: str
    loss: str
    n_classes: int = 1

    def __post_init__(self):
        if self.loss not in ("squared", "binary", "classes"):
            raise ValueError(f"no loss {self.loss}")

    @property
    def outputs(self) -> int:
        return self.n_classes if self.loss == "classes" else 1


@dataclass
class Fitted:
    """``weights``: (term, w), w with an entry for each output of ``heads``, in
    order; ``intercepts``: as many numbers; ``gradient``: per head the length of
    the gradient over its length at the start, after each step."""

    heads: list[Head]
    weights: DataFrame
    intercepts: np.ndarray
    gradient: list[np.ndarray] = field(default_factory=list)

    def slots(self, name: str) -> range:
        at = 0
        for h in self.heads:
            if h.name == name:
                return range(at, at + h.outputs)
            at += h.outputs
        raise KeyError(name)


def term_rows(df: DataFrame, key: str, text: str | None, categories=()) -> DataFrame:
    """(key, term, n): token counts of each row's text and, for each category
    column, one row ``column=value`` (a null category has none)."""
    parts = []
    if text:
        tokens = df.select(key, F.explode(tokenize(text)).alias("t"))
        parts.append(tokens.groupBy(key, F.concat(F.lit("t:"), "t").alias("term")).agg(F.count(F.lit(1)).alias("n")))
    for c in categories:
        parts.append(df.where(F.col(c).isNotNull()).select(
            key, F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("term"), F.lit(1).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def term_table(counts: DataFrame, rows: DataFrame, key: str, min_rows: int = 10) -> DataFrame:
    """(term, idf): terms of at least ``min_rows`` rows; of tokens the inverse
    row frequency log((N + 1) / (rows + 1)), of categories 1."""
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    idf = F.when(F.col("term").startswith("t:"), F.log((F.col("__total") + 1) / (F.col("df") + 1))).otherwise(F.lit(1.0))
    return (counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_rows)
            .crossJoin(F.broadcast(total)).select("term", idf.alias("idf")))


def weighted(counts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, term, x) with x = n idf; terms outside the table are left out."""
    return salted_join(counts, table, "term", "inner", key).select(key, "term", (F.col("n") * F.col("idf")).alias("x"))


@dataclass
class TermGrid:
    """Rows and their terms, packed: ``rows`` with a number ``__row`` each, and
    the terms in cells.  Rows of one key all have its terms."""

    rows: DataFrame
    cells: Grid

    def scores(self, weights: DataFrame, column: str, width: int) -> DataFrame:
        """(part, v) of the rows: sums of x times the weights, terms without one left out."""
        tall = to_parts(self.cells.columns, self.cells.n_columns, weights, "term", column, width)
        return self.cells.times(tall, width)

    def packed_rows(self, values, width: int) -> DataFrame:
        """(part, v): an array for each row, packed."""
        return to_parts(self.cells.rows, self.cells.n_rows, self.rows.select("__row", values.alias("y")), "__row", "y", width)

    def by_row(self, tall: DataFrame, column: str, width: int) -> DataFrame:
        """(__row, column): the packed ``tall`` (part, v) row by row."""
        return from_parts(self.cells.rows, tall, "__row", "long", column, width)


def term_grid(terms: DataFrame, rows: DataFrame, key: str = "row_idx") -> TermGrid:
    """``terms`` (key, term, x) of ``rows`` (key, *labels) in cells."""
    held = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    mine = stored(terms.join(held.select(key, "__row"), key).select("__row", "term", F.col("x").cast("double").alias("x")))
    return TermGrid(held, grid(mine, "__row", "term", "x", held))


class _Losses:
    """Errors and slopes of all heads for a batch of rows; ``y`` has a column
    for each head, NaN where a row has no label."""

    def __init__(self, heads: list[Head]):
        self.heads = heads
        self.width = sum(h.outputs for h in heads)

    def parts(self):
        at = 0
        for i, h in enumerate(self.heads):
            yield i, h, slice(at, at + h.outputs)
            at += h.outputs

    def errors(self, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Derivatives of the loss by the outputs; 0 without a label."""
        e = np.zeros_like(q)
        for i, h, s in self.parts():
            t, there = y[:, i], ~np.isnan(y[:, i])
            if h.loss == "squared":
                e[there, s] = (q[there, s] - t[there, None])
            elif h.loss == "binary":
                e[there, s] = _sigmoid(q[there, s]) - t[there, None]
            else:
                p = _softmax(q[there, s])
                p[np.arange(len(p)), t[there].astype(int)] -= 1
                e[there, s] = p
        return e

    def curvature(self, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Second derivatives of the loss by each output; 0 without a label."""
        h = np.zeros_like(q)
        for i, head, s in self.parts():
            there = ~np.isnan(y[:, i])
            if head.loss == "squared":
                h[there, s] = 1.0
            else:
                p = _sigmoid(q[there, s]) if head.loss == "binary" else _softmax(q[there, s])
                h[there, s] = p * (1 - p)
        return h

    def slopes(self, y: np.ndarray, q: np.ndarray, z: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Per head (first derivative, second derivative) of the summed loss
        along z at each of its ``steps``."""
        out = np.zeros((len(self.heads), steps.shape[1], 2))
        for i, h, s in self.parts():
            there = ~np.isnan(y[:, i])
            t, q_, z_ = y[there, i], q[there, s], z[there, s]
            for k, a in enumerate(steps[i]):
                at = q_ + a * z_
                if h.loss == "squared":
                    out[i, k] = ((at[:, 0] - t) * z_[:, 0]).sum(), (z_ * z_).sum()
                elif h.loss == "binary":
                    p = _sigmoid(at[:, 0])
                    out[i, k] = ((p - t) * z_[:, 0]).sum(), (p * (1 - p) * z_[:, 0] ** 2).sum()
                else:
                    p = _softmax(at)
                    mean = (p * z_).sum(1)
                    out[i, k] = (mean - z_[np.arange(len(z_)), t.astype(int)]).sum(), ((p * z_ * z_).sum(1) - mean ** 2).sum()
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_heads(terms, rows: DataFrame, heads: list[Head], key: str = "row_idx", l2: float = 0.01,
              tol: float = 1e-3, max_steps: int = 60) -> Fitted:
    """Least mean loss + l2 / 2 |w|^2 for each head, with an intercept that is
    not penalised; squared loss is half the squared error.

    ``terms``: (key, term, x), at most one row per key and term, or the grid of
    the rows; ``rows``: (key, *labels); rows without terms have the intercept
    alone.  A
    head is done when its gradient is ``tol`` of what it was at the start; the
    loop ends when all are, or after ``max_steps``.
    """
    losses = _Losses(heads)
    width, n_heads = losses.width, len(heads)
    head_of = np.concatenate([[i] * h.outputs for i, h in enumerate(heads)])
    held = terms if isinstance(terms, TermGrid) else term_grid(terms, rows, key)
    cells = held.cells
    state = stored(mapped(_labels(held, heads), lambda y: (y, np.zeros((len(unpacked(y, n_heads)), width)),
                                                           np.zeros((len(unpacked(y, n_heads)), width))), ["y"], ["y", "q", "z"]))
    n = _label_counts(state, n_heads)[head_of]
    curve = np.array([1.0 if heads[i].loss == "squared" else 0.25 for i in head_of])

    def first(squares):
        none = np.zeros((len(unpacked(squares, 1)), width))
        return none, none, none, 1.0 / (unpacked(squares, 1) * (curve / n) + l2)

    # w: weights, g: gradient, d: direction, m: scale
    table = table_before = stored(mapped(cells.squares(), first, ["v"], ["w", "g", "d", "m"]))
    spark, state_before = table.sparkSession, None
    b, gb, db, move = (np.zeros(width) for _ in range(4))
    done = np.zeros(n_heads, bool)
    history, start, last = [], None, None

    def per_head(x: np.ndarray) -> np.ndarray:
        return np.bincount(head_of, x, n_heads)

    for step in range(max_steps + 1):
        # gradient at the current weights; ``move`` is the step from the stored ones
        def errors(y, q, z, move=move):
            return losses.errors(unpacked(y, n_heads), unpacked(q, width) + move * unpacked(z, width)) / n

        back = cells.back(mapped(state, lambda *x: (errors(*x),), ["y", "q", "z"], ["v"]), width)

        def gradient(xe, w, old, d, m, move=move):
            old, d, m = (unpacked(x, width) for x in (old, d, m))
            w = unpacked(w, width) + move * d
            new = unpacked(xe, width) + l2 * w
            down = m * new
            products = np.stack([(x * y).sum(0) for x, y in ((new, new), (new, down), (old, down), (w, down), (w, d), (down, down),
                                                             (down, d), (d, d))])
            return w, new, d, m, products

        table = stored(mapped(table.join(back, "part"), gradient, ["v", "w", "g", "d", "m"], ["w", "g", "d", "m", "s"]))
        forget(spark, table_before, state_before)
        table_before, state_before = table, state
        gb_new = summed(state.select("y", "q", "z"), lambda *x: errors(*x).sum(0), width)
        nn, nmn, nmo, w_down, w_d, down2, down_d, d2 = summed(
            table.select("s"), lambda s: unpacked(s, width), 8 * width).reshape(8, width)
        length = np.sqrt(per_head(nn + gb_new ** 2))
        start = length if start is None else start
        history.append(length / np.maximum(start, 1e-300))
        done |= history[-1] <= tol
        if done.all() or step == max_steps:
            break
        # Polak-Ribiere directions; a finished head stands still
        now = per_head(nmn + gb_new ** 2)
        beta = np.zeros(n_heads) if last is None else np.maximum(0.0, (now - per_head(nmo + gb_new * gb)) / np.maximum(last, 1e-300))
        last = now
        turn, still = beta[head_of], np.where(done[head_of], 0.0, 1.0)
        gb, db = gb_new, still * (-gb_new + turn * db)

        def direction(w, new, d, m, turn=turn, still=still):
            return w, new, still * (-unpacked(m, width) * unpacked(new, width) + turn * unpacked(d, width)), m

        table = mapped(table, direction, ["w", "g", "d", "m"], ["w", "g", "d", "m"])
        at_zero = np.zeros((n_heads, 1))

        def ahead(y, q, z, along, move=move, db=db):
            q = unpacked(q, width) + move * unpacked(z, width)
            z = (unpacked(along, width) if along.is_valid else 0.0) + db + np.zeros_like(q)
            return y, q, z, losses.slopes(unpacked(y, n_heads), q, z, at_zero)

        scored = cells.times(table.select("part", F.col("d").alias("v")), width)
        state = stored(mapped(state.join(scored, "part", "left"), ahead, ["y", "q", "z", "v"], ["y", "q", "z", "s"]))

        # products of the new direction, still * (turn * d - down), from those of its parts
        wd = per_head(still * (turn * w_d - w_down))
        dd = per_head(still * (turn ** 2 * d2 - 2 * turn * down_d + down2))
        rows_of = np.array([n[np.flatnonzero(head_of == i)[0]] for i in range(n_heads)])

        def slopes(raw, steps):
            raw = raw.reshape(n_heads, -1, 2) / rows_of[:, None, None]
            return raw[..., 0] + l2 * (wd[:, None] + steps * dd[:, None]), raw[..., 1] + l2 * dd[:, None]

        raw = summed(state.select("s"), lambda s: unpacked(s, 2), n_heads * 2)
        first_slope, second = (x[:, 0] for x in slopes(raw, at_zero))
        guess = np.where(second > 0, -first_slope / np.where(second > 0, second, 1), 0.0)
        steps = guess[:, None] * _STEPS
        raw = summed(state.select("y", "q", "z"), lambda y, q, z: losses.slopes(
            unpacked(y, n_heads), unpacked(q, width), unpacked(z, width), steps), n_heads * steps.shape[1] * 2)
        slope, _ = slopes(raw, steps)
        size = np.array([_zero(np.r_[0, s], np.r_[f, v]) for s, f, v in zip(steps, first_slope, slope)])
        size = np.where(done, 0.0, size)
        move = size[head_of]
        b = b + move * db
    # the intercepts alone, to the place where the errors add up to 0: passes over the rows only
    moved = np.zeros(width)
    for _ in range(INTERCEPT_STEPS):
        def at_moved(y, q, z, moved=moved, move=move):
            y, q = unpacked(y, n_heads), unpacked(q, width) + move * unpacked(z, width) + moved
            return np.stack([losses.errors(y, q).sum(0), losses.curvature(y, q).sum(0)])

        error, bend = summed(state.select("y", "q", "z"), at_moved, 2 * width).reshape(2, width)
        moved = moved - np.where(bend > 0, error / np.where(bend > 0, bend, 1), 0.0)
    weights = from_parts(cells.columns, table.select("part", "w"), "term", "string", "w", width, "w")
    return Fitted(heads, weights, b + moved, history)


def _labels(held: TermGrid, heads: list[Head]) -> DataFrame:
    """(part, y) of the rows: a label for each head, not a number where there is none."""
    labels = F.array(*(F.coalesce(F.col(h.label).cast("double"), F.lit(float("nan"))) for h in heads))
    return held.packed_rows(labels, len(heads)).withColumnRenamed("v", "y")


def _label_counts(state: DataFrame, n_heads: int) -> np.ndarray:
    return np.maximum(1.0, summed(state.select("y"), lambda y: (~np.isnan(unpacked(y, n_heads))).sum(0).astype(float), n_heads))


def _zero(steps: np.ndarray, slopes: np.ndarray) -> float:
    """The step at which the slope, which grows with it, crosses 0."""
    if slopes[-1] < 0:
        return float(steps[-1])
    k = int(np.argmax(slopes >= 0))
    if k == 0:
        return 0.0
    a, c = slopes[k - 1], slopes[k]
    return float(steps[k - 1] + (steps[k] - steps[k - 1]) * (-a / (c - a) if c > a else 0.0))


def predict(terms, rows: DataFrame, model: Fitted, key: str = "row_idx") -> DataFrame:
    """``rows`` with ``scores``: one number for each output, also for rows
    without terms; terms outside the model are left out.  ``terms``: (key, term,
    x), or the grid of these rows."""
    width = len(model.intercepts)
    held = terms if isinstance(terms, TermGrid) else term_grid(terms, rows, key)
    zeros = F.array(*(F.lit(0.0) for _ in range(width)))
    shift = F.array(*(F.lit(float(x)) for x in model.intercepts))
    scored = held.by_row(held.scores(model.weights, "w", width), "z", width)
    return held.rows.join(scored, "__row", "left").withColumn(
        "scores", F.zip_with(F.coalesce("z", zeros), shift, lambda z, s: z + s)).drop("z", "__row")


def gradient_lengths(terms, rows: DataFrame, model: Fitted, l2: float, key: str = "row_idx") -> np.ndarray:
    """Length of each head's gradient at its weights, worked out anew from the
    predictions."""
    losses = _Losses(model.heads)
    width, n_heads = losses.width, len(model.heads)
    head_of = np.concatenate([[i] * h.outputs for i, h in enumerate(model.heads)])
    held = terms if isinstance(terms, TermGrid) else term_grid(terms, rows, key)
    cells, b = held.cells, model.intercepts
    given = _labels(held, model.heads).join(held.scores(model.weights, "w", width), "part", "left")

    def errors(y, z):
        y = unpacked(y, n_heads)
        return y, losses.errors(y, (unpacked(z, width) if z.is_valid else 0.0) + b + np.zeros((len(y), width)))

    state = stored(mapped(given, errors, ["y", "v"], ["y", "e"]))
    n = _label_counts(state, n_heads)[head_of]
    back = cells.back(state.select("part", F.col("e").alias("v")), width)
    weights = to_parts(cells.columns, cells.n_columns, model.weights, "term", "w", width).withColumnRenamed("v", "w")
    square = summed(weights.join(back, "part").select("v", "w"),
                    lambda e, w: ((unpacked(e, width) / n + l2 * unpacked(w, width)) ** 2).sum(0), width)
    # a term that no row has is in the penalty alone
    there = cells.columns.select(F.explode("names").alias("term"))
    absent = model.weights.join(there, "term", "anti").select(*(F.sum(F.pow(l2 * F.get("w", F.lit(k)), 2)).alias(f"s{k}") for k in range(width)))
    square = square + np.array([x or 0.0 for x in absent.first()])
    flat = summed(state.select("e"), lambda e: unpacked(e, width).sum(0), width) / n
    return np.sqrt(np.bincount(head_of, square + flat ** 2, n_heads))
