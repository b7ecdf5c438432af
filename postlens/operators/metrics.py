"""Label dictionaries, alignment and scoring.

IDs: JN1-JN4, JN10, JN11, AGG8-AGG14, AGG27, AGG28.

Every metric is an aggregate over the scored rows; nothing is collected.
Dictionaries (group names, target codes) are aggregates of the data.  They
are joined without a broadcast hint: the optimizer and AQE broadcast them
when their measured size is below the broadcast threshold and shuffle
otherwise, so a dictionary that grows with the data stays safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import arrays as A

# Fixed stance codes of the reference: AGAINST=0, FAVOR=1, NONE=2, UNKNOWN=3.
STANCE_CODES = ["AGAINST", "FAVOR", "NONE", "UNKNOWN"]
# Classes reported by the scorer, and the two that enter the macro F.
SCORER_CLASSES = ["FAVOR", "AGAINST", "NONE", "UNKNOWN"]
MACRO_CLASSES = ["FAVOR", "AGAINST"]


def _stance_map() -> Column:
    return F.create_map(*[x for i, s in enumerate(STANCE_CODES) for x in (F.lit(s), F.lit(i))])


# --- dictionaries -----------------------------------------------------------

def group_names(df: DataFrame, id_col: str = "group_id", name_col: str = "Name",
                order: str = "row_idx") -> DataFrame:
    """JN1: id -> name; when an id has several names the last one wins."""
    return (df.where(F.col(id_col).isNotNull())
            .groupBy(id_col).agg(F.max_by(F.col(name_col), F.col(order)).alias(name_col)))


def with_group_name(df: DataFrame, names: DataFrame, id_col: str = "group_id", name_col: str = "Name",
                    strict: bool = False) -> DataFrame:
    """JN1: attach the name; ``strict`` fails on an id missing from ``names``."""
    out = df.join(names, on=id_col, how="left")
    if strict:
        out = out.withColumn(name_col, F.when(F.col(name_col).isNotNull() | F.col(id_col).isNull(), F.col(name_col))
                             .otherwise(F.raise_error(F.concat(F.lit("unknown group id: "),
                                                                F.col(id_col).cast("string")))))
    return out


def encode_stance(col: str = "Stance") -> Column:
    """JN3: fixed stance code; NULL for an unknown label."""
    return F.element_at(_stance_map(), F.col(col)).cast("int")


def decode_stance(col: str = "stance_id") -> Column:
    """JN4: inverse of :func:`encode_stance`."""
    inv = A.invert_map(_stance_map())
    return F.element_at(inv, F.col(col).cast("int"))


def target_codes(df: DataFrame, target: str = "Target", order: str = "row_idx") -> DataFrame:
    """JN3: targets numbered 0.. in order of first appearance.

    One row per distinct target (partial aggregation), then the dense
    distributed row index of PRJ9 over that table; no single-partition window.
    """
    from postlens.operators.prepare import with_row_index
    firsts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.min(order).alias("__first"))
    ranked = with_row_index(firsts, "__first", "__id", stable=False)
    return ranked.select(target, F.col("__id").cast("int").alias("target_id"))


def encode_labels(df: DataFrame, codes: DataFrame, target: str = "Target", stance: str = "Stance",
                  strict: bool = True) -> DataFrame:
    """JN3: add ``stance_id`` and ``target_id``; strict mode stops on an unknown label."""
    out = df.join(codes, on=target, how="left").withColumn("stance_id", encode_stance(stance))
    if strict:
        bad = F.col("stance_id").isNull() | F.col("target_id").isNull()
        out = out.withColumn("stance_id", F.when(~bad, F.col("stance_id")).otherwise(F.raise_error(
            F.concat(F.lit("unknown label: "), F.coalesce(F.col(stance), F.lit("NULL")), F.lit(" / "),
                     F.coalesce(F.col(target), F.lit("NULL"))))))
    return out


def decode_labels(df: DataFrame, codes: DataFrame, target_id: str = "target_id", stance_id: str = "stance_id") -> DataFrame:
    """JN4: codes back to label strings."""
    inv = codes.select(F.col("target_id").alias(target_id), F.col(codes.columns[0]).alias("target_label"))
    return df.join(inv, on=target_id, how="left").withColumn("stance_label", decode_stance(stance_id))


# --- alignment --------------------------------------------------------------

def align(gold: DataFrame, guess: DataFrame, key: str = "row_idx", strict: bool = False) -> DataFrame:
    """JN2: pair line i of gold with line i of guess (or by ID with ``key="ID"``).

    The scorer requires that every line has its counterpart (AGG27).  With
    ``strict`` a row that only one side has makes the result fail at run time:
    a full outer join in one pass over each side, no separate counts."""
    g = gold.select(F.col(key), F.col("Stance").alias("gold"), *[F.col(c) for c in ("Target",) if c in gold.columns],
                    F.lit(True).alias("__g"))
    p = guess.select(F.col(key), F.col("Stance").alias("guess"), F.lit(True).alias("__p"))
    if not strict:
        return g.join(p, on=key, how="inner").drop("__g", "__p")
    out = g.join(p, on=key, how="full")
    lone = F.col("__g").isNull() | F.col("__p").isNull()
    failed = F.raise_error(F.concat(F.lit("gold and guess differ in row count or keys, at "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    return out.withColumn("gold", F.when(lone, failed).otherwise(F.col("gold"))).where(
        F.col("gold").isNotNull() | ~lone).drop("__g", "__p")


def same_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG27: both counts in one row and their equality."""
    ca = a.agg(F.count(F.lit(1)).alias("n_gold"))
    cb = b.agg(F.count(F.lit(1)).alias("n_guess"))
    return ca.crossJoin(cb).withColumn("same", F.col("n_gold") == F.col("n_guess"))


def attach_predictions(df: DataFrame, pred: DataFrame, key: str = "row_idx") -> DataFrame:
    """JN10: equi join of predictions to rows and gold labels."""
    return df.join(pred, on=key, how="inner")


# --- scorer -----------------------------------------------------------------

def label_counts(aligned: DataFrame, gold: str = "gold", guess: str = "guess", classes=SCORER_CLASSES) -> DataFrame:
    """AGG10: per class true positives, guesses and gold counts.

    One pass with conditional counts; a class absent from both sides gets
    zeros.  The result has one row per class, emitted from a one-row
    aggregate by ``stack`` (no shuffle of the scored rows).
    """
    aggs = []
    for c in classes:
        aggs += [F.count_if((F.col(guess) == c) & (F.col(gold) == c)).alias(f"tp_{c}"),
                 F.count_if(F.col(guess) == c).alias(f"guess_{c}"),
                 F.count_if(F.col(gold) == c).alias(f"gold_{c}")]
    wide = aligned.agg(*aggs)
    stack = ", ".join(f"'{c}', tp_{c}, guess_{c}, gold_{c}" for c in classes)
    return wide.selectExpr(f"stack({len(classes)}, {stack}) as (label, n_tp, n_guess, n_gold)")


def prf(counts: DataFrame) -> DataFrame:
    """AGG11: precision, recall and F per class; 0 where undefined."""
    p = F.coalesce(F.try_divide(F.col("n_tp").cast("double"), F.col("n_guess")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("n_tp").cast("double"), F.col("n_gold")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f", f)


def macro_f(scores: DataFrame, classes=MACRO_CLASSES) -> DataFrame:
    """AGG12: mean F over FAVOR and AGAINST (NONE counts only as a guess)."""
    return scores.where(F.col("label").isin(*classes)).agg(F.avg("f").alias("macro_f"))


def score_report(scores: DataFrame) -> DataFrame:
    """STR13: the scorer's printed lines as rows."""
    from postlens.functions.text import scorer_line
    return scores.where(F.col("label").isin(*MACRO_CLASSES)).select(
        "label", scorer_line("label", "precision", "recall", "f").alias("line"))


def micro_f1(df: DataFrame, pred: str, gold: str, by=()) -> DataFrame:
    """AGG13: micro F1 with one label per row equals accuracy."""
    acc = F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("micro_f1")
    return df.groupBy(*by).agg(acc) if by else df.agg(acc)


# --- errors and losses ------------------------------------------------------

def mse(df: DataFrame, pred: str = "prediction", gold: str = "score", by=(), extra=()) -> DataFrame:
    """AGG8: mean squared error (rows with a null side are skipped); ``extra``
    aggregates are computed in the same pass."""
    e = F.avg(F.pow(F.col(pred) - F.col(gold), 2)).alias("mse")
    n = F.count(F.col(pred) - F.col(gold)).alias("n")
    return df.groupBy(*by).agg(e, n, *extra) if by else df.agg(e, n, *extra)


def mse_by_group(df: DataFrame, names: DataFrame, id_col: str = "group_id", pred: str = "prediction",
                 gold: str = "score", strict: bool = True) -> DataFrame:
    """AGG9 + JN11: MSE per group with its name; groups without rows stay
    listed with NULL mse and n = 0.  ``strict`` fails when a scored group is
    missing from ``names``."""
    per = mse(df.where(F.col(id_col).isNotNull()), pred, gold, by=[id_col])
    out = names.join(per, on=id_col, how="left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    if strict:
        orphans = per.join(names, on=id_col, how="left_anti")
        check = orphans.agg(F.count(F.lit(1)).alias("__orphans"))
        # the assertion is part of an output value so that column pruning cannot drop it
        ok = F.assert_true(F.col("__orphans") == 0, F.lit("group outside the dictionary"))
        out = out.crossJoin(check).withColumn("n", F.coalesce(ok.cast("long"), F.col("n"))).drop("__orphans")
    return out


def bce(prob: Column, label: Column, eps: float = 1e-7) -> Column:
    """Binary cross-entropy of one row; probabilities are clipped."""
    p = F.least(F.greatest(prob, F.lit(eps)), F.lit(1 - eps))
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Cross-entropy over logits: log-sum-exp minus the true logit."""
    return A.log_sum_exp(logits) - F.element_at(logits, label.cast("int") + 1)


def row_loss(kind: str, pred: str, gold: str) -> Column:
    """Loss of one row, ``kind`` in {mse, bce, ce}."""
    if kind == "mse":
        return F.pow(F.col(pred) - F.col(gold), 2)
    if kind == "bce":
        return bce(F.col(pred), F.col(gold))
    if kind == "ce":
        return cross_entropy(F.col(pred), F.col(gold))
    raise ValueError(kind)


def mean_losses(df: DataFrame, kinds: dict[str, tuple[str, str]], by=()) -> DataFrame:
    """AGG14: several mean losses (kind -> (prediction, gold)) in one pass."""
    aggs = [F.avg(row_loss(kind, pred, gold)).alias(f"{kind}_loss") for kind, (pred, gold) in kinds.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def mean_loss(df: DataFrame, kind: str, pred: str, gold: str, by=()) -> DataFrame:
    """AGG14: mean loss of ``kind`` in {mse, bce, ce} over the rows."""
    return mean_losses(df, {kind: (pred, gold)}, by)


def two_head_loss(df: DataFrame, stance_logits: str, stance: str, target_logits: str, target: str,
                  unknown_stance: int = 3) -> DataFrame:
    """AGG13 + AGG14 for the two-head model: mean cross-entropy of the stance
    head over rows with a known stance plus that of the target head over all
    rows, and micro F1 (accuracy of the argmax) of each head and their mean."""
    from postlens.functions.arrays import argmax
    known = F.col(stance) != F.lit(unknown_stance)
    s_ce = F.when(known, cross_entropy(F.col(stance_logits), F.col(stance)))
    t_ce = cross_entropy(F.col(target_logits), F.col(target))
    s_hit = F.when(known, (argmax(stance_logits) == F.col(stance)).cast("double"))
    t_hit = (argmax(target_logits) == F.col(target)).cast("double")
    out = df.agg(F.avg(s_ce).alias("stance_loss"), F.avg(t_ce).alias("target_loss"),
                 F.avg(s_hit).alias("stance_f1"), F.avg(t_hit).alias("target_f1"))
    return out.select("*", (F.col("stance_loss") + F.col("target_loss")).alias("loss"),
                      ((F.col("stance_f1") + F.col("target_f1")) / 2).alias("mean_f1"))


def label_distribution(df: DataFrame, target: str = "Target", label: str = "Stance") -> DataFrame:
    """AGG28: rows per (target, label)."""
    return df.groupBy(target, label).agg(F.count(F.lit(1)).alias("n"))
