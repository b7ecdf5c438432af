"""Quality rules: base counts and robust multivariate outliers.

The statistics of a text are put on scales on which ordinary texts are close
to normal.  Per language and source, the minimum-covariance-determinant
estimate (mean and covariance of the three quarters of the texts that lie
closest together) is reached by concentration steps over all rows: distances
from the current estimate, their group-wise quantile, then sums over the rows
within it.  Each step is one aggregation with partial sums, so a group of any
size is never in one task.  A text is rejected if its Mahalanobis distance from
its group's estimate is beyond the cut.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import judged_rows, let_go, stored, with_groups

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Share of a group that an estimate rests on.
CORE = 0.75
#: Variance that a scale has at least, as a standard deviation; a statistic
#: that is the same in nearly all texts would else reject the next one.
FLOOR = (0.05, 0.25, 0.05, 0.05, 0.05)
#: Squared distance beyond which a text is rejected: the 0.9999 quantile of
#: chi-square with five degrees of freedom.
CUT = 25.74
#: Covariance of the closest three quarters of a five-dimensional normal
#: sample to that of the whole: CORE / P(chi2_7 <= q), q = chi2_5 quantile.
CONSISTENCY = 1.56
#: A group of fewer texts uses its language's estimate, and a language of
#: fewer the one of all texts.
LEAST_ROWS = 50
STEPS = 10

_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_adjacent long"
_NAMES = [x.split()[0] for x in _STATS.split(", ")]
_DIM = len(FLOOR)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]


def text_stats(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of the output columns."""
    raw = text.encode()
    words = raw.split()  # bytes are split at space and 0x09-0x0D only
    n = len(words)
    lines = list(filter(bytes.strip, raw.split(b"\n")))
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return (n, len(text) - (len(raw) - sum(map(len, words))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated, sum(map(eq, words, words[1:])))


def with_stats(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """The counts of whole texts, ``base_failed``, and ``lang``/``source`` for
    grouping; the columns ``keep`` of ``docs`` are in ``row``."""
    mark = "_"  # names that no column of the documents has
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    def judge():
        let_go()
        return lambda texts: list(zip(*map(text_stats, texts)))

    rows = judged_rows(docs, text_col, judge,
                       ", ".join(mark + x for x in _STATS.split(", ")), keep)
    group = [F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit("\0")).alias(a)
             for c, a in ((lang_col, "lang"), (source_col, "source"))]
    counted = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
                          *(F.col(mark + c).alias(c) for c in _NAMES))
    return counted.select("row", *group, *_NAMES).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def transformed() -> list:
    """The statistics on scales that damp the noise of short texts."""
    n = F.col("n_words")
    return [F.log((F.col("word_chars") + 250) / (n + 50)), F.log1p(50 * F.col("n_symbols") / (n + 20)),
            F.col("n_dup_lines") / (F.col("n_lines") + 10), F.col("n_repeat_words") / (n + 50),
            F.col("n_adjacent") / (n + 20)]


def _distance(x, mean, precision):
    """Squared Mahalanobis distance as one sum (the precision's upper half)."""
    total = None
    for k, (i, j) in enumerate(_PAIRS):
        term = (x[i] - mean[i]) * (x[j] - mean[j]) * precision[k] * (1 if i == j else 2)
        total = term if total is None else total + term
    return total


def _estimate(batches):
    """Mean and precision of each group from its sums."""
    floor = np.diag(np.square(FLOOR))
    for batch in batches:
        sums = np.array(batch.column("sums").to_pylist(), float).reshape(-1, _DIM + len(_PAIRS))
        n = np.array(batch.column("n").to_pylist(), float)
        means, precisions, dets = [], [], []
        for s, m in zip(sums, n):
            mean = s[:_DIM] / m
            cov = np.zeros((_DIM, _DIM))
            for v, (i, j) in zip(s[_DIM:] / m, _PAIRS):
                cov[i, j] = cov[j, i] = v - mean[i] * mean[j]
            cov = cov * CONSISTENCY + floor
            inverse = np.linalg.inv(cov)
            means.append(mean.tolist())
            precisions.append([inverse[i, j] for i, j in _PAIRS])
            dets.append(float(np.linalg.slogdet(cov)[1]))
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("rows"), pa.array(means, kind),
                                          pa.array(precisions, kind), pa.array(dets, pa.float64())],
                                         ["grp", "rows", "mean", "precision", "logdet"])


_MODEL = "grp string, rows long, mean array<double>, precision array<double>, logdet double"


def _groups():
    """The three groups a text counts for, most special first; lengths keep
    the names apart."""
    lang, source = F.col("lang"), F.col("source")
    return F.array(F.concat(F.lit("0:"), F.length(lang), F.lit(":"), lang, source), F.concat(F.lit("1:"), lang),
                   F.lit("2:"))


def robust_estimates(stats: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates (grp, rows, mean, precision,
    logdet) for all texts, each language, and each language and source."""
    rows = stored(stats.select(F.explode(_groups()).alias("grp"), F.array(*transformed()).alias("x")), "quality-x")
    # start: medians, and spreads around them, by mergeable quantile sketches
    start = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}")
          for i in range(_DIM)))
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2)) + FLOOR[i] ** 2 for i in range(_DIM)]
    model = stored(start.select(
        "grp", "rows", F.array(*(F.col(f"q{i}")[1] for i in range(_DIM))).alias("mean"),
        F.array(*((1 / spread[i]) if i == j else F.lit(0.0) for i, j in _PAIRS)).alias("precision"),
        F.lit(0.0).alias("logdet")), "quality-start")
    before = None
    for _ in range(STEPS):
        far = with_groups(rows, model.select("grp", "mean", "precision"), "grp").select(
            "grp", "x", _distance(F.col("x"), F.col("mean"), F.col("precision")).alias("d"))
        cut = stored(far.groupBy("grp").agg(F.percentile_approx("d", CORE, 2000).alias("cut"),
                                            F.count(F.lit(1)).alias("rows")), "quality-cut")
        x = F.col("x")
        limits = stored(model.select("grp", "mean", "precision").join(cut, "grp"), "quality-limits")
        sums = (with_groups(rows, limits, "grp")
                .where(_distance(x, F.col("mean"), F.col("precision")) <= F.col("cut"))
                .groupBy("grp").agg(F.first("rows").alias("rows"), F.count(F.lit(1)).alias("n"),
                                    *(F.sum(x[i]).alias(f"s{i}") for i in range(_DIM)),
                                    *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _PAIRS))
                .select("grp", "rows", "n", F.array(*(f"s{i}" for i in range(_DIM)),
                                                    *(f"s{i}_{j}" for i, j in _PAIRS)).alias("sums")))
        model = stored(sums.mapInArrow(_estimate, _MODEL), "quality-model")
        now = model.agg(F.sum("logdet")).first()[0]
        if now is None or before is not None and abs(now - before) < 1e-3 * max(1.0, abs(now)):
            break
        before = now
    return model


def judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, cut: float, keep: list[str]) -> DataFrame:
    """:func:`with_stats` with ``distance`` and ``kept``."""
    stats = stored(with_stats(docs, text_col, lang_col, source_col, keep), "quality-stats")
    model = robust_estimates(stats.where(~F.col("base_failed")).drop("row")).select("grp", "rows", "mean", "precision")
    # the estimate of each language and source that occurs: its own, its language's, or that of all
    pairs = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("g", _groups())
    chosen = F.lit(None).cast("struct<mean:array<double>,precision:array<double>>")
    for level in range(3):
        own = model.where((F.col("rows") >= LEAST_ROWS) | F.lit(level == 2)).select(
            F.col("grp").alias(f"grp{level}"), F.struct("mean", "precision").alias(f"m{level}"))
        pairs = pairs.withColumn(f"grp{level}", F.col("g")[level]).join(own, f"grp{level}", "left")
        chosen = F.coalesce(chosen, F.col(f"m{level}"))
    pair = F.concat(F.length("lang"), F.lit(":"), "lang", "source")
    pairs = stored(pairs.select(pair.alias("pair"), chosen.alias("m")), "quality-groups")
    distance = _distance(F.array(*transformed()), F.col("m.mean"), F.col("m.precision"))
    return with_groups(stats.withColumn("pair", pair), pairs, "pair").withColumn("distance", distance).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", cut: float = CUT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance, kept), one row per input row.

    A text without words (null, empty, white space) fails the base rules.
    Null language or source is a group of its own.  Texts that fail the base
    rules are no part of the estimates.  ``distance`` is the squared
    Mahalanobis distance from the most special estimate of at least
    ``LEAST_ROWS`` texts, null where no text at all passes the base rules (a
    text is then judged by the base rules alone).  Repeated rows count each; a
    null id stays null; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    # the texts themselves go no further than their counts
    counted = judged(slim, "text", "lang", "source", cut, ["id", "lang", "source"])
    return counted.select(F.col("row.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                          "n_repeat_words", "base_failed", "distance", "kept")


def drop_outliers(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns as
    they are."""
    return judged(docs, text_col, lang_col, source_col, cut, docs.columns).where("kept").select(
        *(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
