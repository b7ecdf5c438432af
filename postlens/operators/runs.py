"""Trial-log analysis: last and best results, top checkpoints, plateau rule.

IDs: AGG22, AGG23, AGG24, WIN3, WIN4, SRT1, SRT2.

A trial table has one row per (trial, iteration).  Per-trial picks use
``max_by``/``min_by`` aggregates (partial aggregation, no sort of a group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, trial: str, order, largest: bool) -> DataFrame:
    cols = [c for c in df.columns if c != trial]
    rec = F.struct(*[F.col(c) for c in cols])
    agg = F.max_by(rec, order) if largest else F.min_by(rec, order)
    return df.groupBy(trial).agg(agg.alias("__r")).select(trial, "__r.*")


def last_results(trials: DataFrame, trial: str = "trial_id", it: str = "training_iteration") -> DataFrame:
    """AGG23: the last reported row of each trial."""
    return _pick(trials, trial, F.col(it), largest=True)


def best_rows(trials: DataFrame, metric: str = "loss", mode: str = "min", trial: str = "trial_id",
              it: str = "training_iteration") -> DataFrame:
    """AGG24: per trial, the row with the best metric (earliest iteration on ties)."""
    sign = 1 if mode == "min" else -1
    order = F.struct((F.col(metric) * sign).alias("m"), F.col(it).alias("i"))
    return _pick(trials, trial, order, largest=False)


def best_trial(trials: DataFrame, metric: str = "loss", mode: str = "min", trial: str = "trial_id",
               it: str = "training_iteration") -> DataFrame:
    """AGG22: the best trial judged on each trial's last result; one row (the
    smallest trial id of equally good ones; ids may be numbers or text)."""
    last = last_results(trials, trial, it)
    rec = F.struct(*[F.col(c) for c in last.columns])
    order = F.struct(F.col(metric) if mode == "min" else -F.col(metric), F.col(trial))
    return last.agg(F.min_by(rec, order).alias("__r")).select("__r.*")


def top_k_per_group(df: DataFrame, k: int, group: str, order) -> DataFrame:
    """WIN3: the best ``k`` rows per group.  ``row_number() <= k`` is planned
    with a partial WindowGroupLimit before the shuffle, so each map task sends
    at most ``k`` rows per group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def plateau(trials: DataFrame, loss: str = "loss", min_delta: float = 0.05, patience: int = 3,
            divergence: float = 3.0, trial: str = "trial_id", it: str = "training_iteration") -> DataFrame:
    """WIN4: replay the early-stopping rule on each trial's loss log.

    Improvement only when ``loss < best - min_delta``; stop when the waits
    reach ``patience`` or the loss exceeds ``divergence``.  The decision
    depends on earlier decisions, so it is a fold over the trial's log in
    iteration order.  A trial's log is bounded by its epoch count, which is
    what makes collecting one trial's (iteration, loss) pairs safe.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(it).alias("i"), F.col(loss).cast("double").alias("l"))))
    init = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"),
                    F.lit(None).cast("int").alias("stop_it"), F.lit(None).cast("string").alias("reason"))

    def step(s, x):
        stopped = s["stop_it"].isNotNull()
        diverged = x["l"] > F.lit(divergence)
        improved = x["l"] + F.lit(min_delta) < s["best"]
        new_wait = F.when(improved, F.lit(0)).otherwise(s["wait"] + 1)
        return (F.when(stopped, s)
                .when(diverged, F.struct(s["best"].alias("best"), s["wait"].alias("wait"),
                                         x["i"].cast("int").alias("stop_it"), F.lit("divergence").alias("reason")))
                .otherwise(F.struct(
                    F.when(improved, x["l"]).otherwise(s["best"]).alias("best"),
                    new_wait.alias("wait"),
                    F.when(new_wait >= patience, x["i"].cast("int")).alias("stop_it"),
                    F.when(new_wait >= patience, F.lit("patience")).alias("reason"))))

    folded = trials.groupBy(trial).agg(F.aggregate(pairs, init, step).alias("__s"))
    return folded.select(trial, F.col("__s.stop_it").alias("stop_iteration"), F.col("__s.reason").alias("reason"),
                         F.col("__s.best").alias("best_loss"))
