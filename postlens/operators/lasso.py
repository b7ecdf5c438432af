"""Lasso on categories with a certificate.

IDs: MLJ2.

Rows that agree in all category columns are one cell (count, sum and sum of
squares of the label), a partial aggregate; the steps work on cells.  Weights
are a table (feature, value, w).  Each row has one value of each of the B
columns, so B times the values' counts bound the squares' curvature from above:
with these step lengths every step lowers the objective

    1/(2 n) sum (y - b - sum of w)^2 + alpha sum |w|,

whatever the number of values.  The duality gap says how far from the least
value the objective can be at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import cut_lineage


@dataclass
class Lasso:
    """``weights``: (feature, value, n, w); ``gap``: the duality gap at these
    weights, over the label's mean square about its mean."""

    weights: DataFrame
    intercept: float
    gap: float
    steps: int


def fit_lasso(rows: DataFrame, columns, label: str, alpha: float, tol: float = 1e-6, max_steps: int = 200) -> Lasso:
    """Least value of the objective above, with an intercept that is not
    penalised, to a relative duality gap of ``tol`` or for ``max_steps`` steps.

    Rows without a label are left out; a null category is a value of its own.
    No rows give no weights, the intercept 0 and the gap 0.
    """
    columns = list(columns)
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]
    y = F.col(label).cast("double")
    cells = rows.where(F.col(label).isNotNull()).select(*named, y.alias("__y")).groupBy(*columns).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("s2"))
    cells = cut_lineage(cells.withColumn("cell", F.monotonically_increasing_id()))
    total = cells.agg(F.sum("n"), F.sum("s"), F.sum("s2")).first()
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns))).alias("v")
    ones = cut_lineage(cells.select("cell", "n", "s", parts).select("cell", "n", "s", "v.feature", "v.value"))
    weights = ones.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    if not total[0]:
        return Lasso(weights.withColumn("w", F.lit(0.0)), 0.0, 0.0, 0)
    n, mean = total[0], total[1] / total[0]
    spread = max(total[2] / n - mean * mean, 1e-300)
    weights, b = cut_lineage(weights.withColumn("w", F.lit(0.0))), mean
    for step in range(max_steps + 1):
        # per cell: its fitted part; per value: the sum of its rows' residuals
        fitted = ones.join(weights.select("feature", "value", "w"), ["feature", "value"]).groupBy("cell").agg(F.sum("w").alias("f"))
        state = cut_lineage(cells.select("cell", "n", "s", "s2").join(fitted, "cell"))
        b = state.agg(F.sum(F.col("s") - F.col("n") * F.col("f"))).first()[0] / n  # residuals add up to 0
        left = F.col("s") - F.col("n") * (F.col("f") + b)
        per = ones.select("cell", "feature", "value").join(state.select("cell", left.alias("r")), "cell") \
            .groupBy("feature", "value").agg(F.sum("r").alias("r"))
        weights = cut_lineage(weights.join(per, ["feature", "value"]))
        # sum of squares of y - b - f over a cell's rows, and of y times that
        off = F.col("f") + b
        square, cross = state.agg(F.sum(F.col("s2") - 2 * off * F.col("s") + F.col("n") * off * off),
                                  F.sum(F.col("s2") - off * F.col("s"))).first()
        size, most = weights.agg(F.sum(F.abs("w")), F.max(F.abs("r"))).first()
        scale = min(1.0, alpha * n / most) if most else 1.0
        # dual point: scale times the residuals over n, which add up to 0
        dual = scale * cross / n - 0.5 * scale * scale * square / n
        gap = max(0.0, square / (2 * n) + alpha * size - dual) / spread
        step_length = F.lit(1.0) / (len(columns) * F.col("n"))
        moved = F.col("w") + F.col("r") * step_length
        weights = weights.select("feature", "value", "n", (F.signum(moved) * F.greatest(
            F.abs(moved) - alpha * n * step_length, F.lit(0.0))).alias("w"))
        if gap <= tol or step == max_steps:
            # the weights of this intercept: the step lowers the objective, so the gap bounds theirs too
            return Lasso(weights, b, gap, step)
    raise AssertionError


def lasso_weights(model: Lasso) -> DataFrame:
    """(feature, value, coefficient); the value of a null category is null."""
    value = F.when(F.col("value") != "", F.substring("value", 2, 1 << 30))
    return model.weights.select("feature", value.alias("value"), F.col("w").alias("coefficient"))
