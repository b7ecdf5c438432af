"""Queries: trial logs (last/best results, top checkpoints, plateau rule), labelled text."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import arrays as A
from postlens.operators import runs as RU
from postlens.operators import stats as S
from postlens.plans.q_prepare import _r
from postlens.plans.registry import query
from postlens.sources import files as FI
from postlens.sources import testviews as V


@query("last_results", "AGG23", V.with_sql(V.TRIAL_LOG_SQL) + """
SELECT trial_id, arg_max(training_iteration, training_iteration) AS training_iteration,
       round(arg_max(loss, training_iteration), 6) AS loss, round(arg_max(mean_F1, training_iteration), 6) AS mean_F1
FROM trial_log GROUP BY trial_id
""")
def last_results(spark, d):
    t = RU.last_results(V.trial_log(spark, d))
    return t.select("trial_id", "training_iteration", _r("loss").alias("loss"), _r("mean_F1").alias("mean_F1"))


@query("best_rows", "AGG24", V.with_sql(V.TRIAL_LOG_SQL) + """
SELECT trial_id, arg_min(training_iteration, (loss, training_iteration)) AS training_iteration,
       round(min(loss), 6) AS loss
FROM trial_log GROUP BY trial_id
""")
def best_rows(spark, d):
    t = RU.best_rows(V.trial_log(spark, d), "loss", "min")
    return t.select("trial_id", "training_iteration", _r("loss").alias("loss"))


@query("best_trial", "AGG22", V.with_sql(V.TRIAL_LOG_SQL) + """,
last AS (SELECT trial_id, arg_max(loss, training_iteration) AS loss, max(training_iteration) AS training_iteration
         FROM trial_log GROUP BY trial_id)
SELECT trial_id, training_iteration, round(loss, 6) AS loss FROM last ORDER BY loss, trial_id LIMIT 1
""")
def best_trial(spark, d):
    t = RU.best_trial(V.trial_log(spark, d), "loss", "min")
    return t.select("trial_id", "training_iteration", _r("loss").alias("loss"))


@query("top3_checkpoints", "WIN3 SRT1", V.with_sql(V.TRIAL_LOG_SQL) + """
SELECT trial_id, training_iteration, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY mean_F1 DESC, loss ASC, training_iteration) AS rank
  FROM trial_log) WHERE rank <= 3
""")
def top3_checkpoints(spark, d):
    t = RU.top_k_per_group(V.trial_log(spark, d), 3, "trial_id",
                           [F.col("mean_F1").desc(), F.col("loss").asc(), F.col("training_iteration")])
    return t.select("trial_id", "training_iteration", F.col("rank").cast("int").alias("rank"))


@query("plateau", "WIN4", (V.with_sql(V.TRIAL_LOG_SQL) + """,
seq AS (SELECT trial_id, training_iteration AS it, loss,
               row_number() OVER (PARTITION BY trial_id ORDER BY training_iteration) AS k FROM trial_log),
RECURSIVE_PLACEHOLDER
""".replace("RECURSIVE_PLACEHOLDER", """walk AS (
  SELECT trial_id, k, 'inf'::DOUBLE AS best, 0 AS wait, NULL::INTEGER AS stop_it, NULL::VARCHAR AS reason
  FROM seq WHERE k = 1
  UNION ALL
  SELECT w.trial_id, w.k + 1,
    CASE WHEN w.stop_it IS NOT NULL OR s.loss > 3.0 THEN w.best WHEN s.loss + 0.05 < w.best THEN s.loss ELSE w.best END,
    CASE WHEN w.stop_it IS NOT NULL OR s.loss > 3.0 THEN w.wait WHEN s.loss + 0.05 < w.best THEN 0 ELSE w.wait + 1 END,
    CASE WHEN w.stop_it IS NOT NULL THEN w.stop_it WHEN s.loss > 3.0 THEN s.it
         WHEN NOT (s.loss + 0.05 < w.best) AND w.wait + 1 >= 3 THEN s.it END,
    CASE WHEN w.stop_it IS NOT NULL THEN w.reason WHEN s.loss > 3.0 THEN 'divergence'
         WHEN NOT (s.loss + 0.05 < w.best) AND w.wait + 1 >= 3 THEN 'patience' END
  FROM walk w JOIN seq s ON s.trial_id = w.trial_id AND s.k = w.k)
SELECT trial_id, stop_it AS stop_iteration, reason, round(best, 6) AS best_loss
FROM walk QUALIFY k = max(k) OVER (PARTITION BY trial_id)""")).replace("WITH ", "WITH RECURSIVE ", 1))
def plateau(spark, d):
    p = RU.plateau(V.trial_log(spark, d))
    return p.select("trial_id", "stop_iteration", "reason", _r("best_loss").alias("best_loss"))


@query("labelled_text", "SRC7", """
SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)
""")
def labelled_text(spark, d):
    return FI.read_labelled_text(spark, d).select("doc_id", "lang", "n_chars", "quality", "toxic")


_CKPT_SQL = V.with_sql(V.TRIAL_LOG_SQL) + """,
c AS (SELECT 'version_' || trial_id || '/epoch=' || training_iteration AS path, training_iteration AS epoch,
             floor(loss * 100) / 100 AS loss, floor(mean_F1 * 100) / 100 AS f1, trial_id
      FROM trial_log)
"""


def checkpoint_names(spark, d):
    """Checkpoint names as the trainer writes them, one per trial log row."""
    t = V.trial_log(spark, d)
    two = lambda c: F.format_string("%.2f", F.floor(F.col(c) * 100) / 100)
    epoch = F.col("training_iteration").cast("string")
    return t.select(
        F.concat(F.lit("version_"), F.col("trial_id").cast("string")).alias("version"),
        F.concat(F.lit("version_"), F.col("trial_id").cast("string"), F.lit("/epoch="), epoch).alias("path"),
        F.concat(F.lit("epoch="), epoch, F.lit("-val_loss="), two("loss"), F.lit("-val_F="), two("mean_F1")).alias("name"))


@query("best_checkpoint", "SRT1 STR7", _CKPT_SQL + """
SELECT round(loss, 2) AS loss, round(f1, 2) AS f1 FROM c ORDER BY f1 DESC, loss ASC LIMIT 1
""")
def best_checkpoint(spark, d):
    """Loss and F1 of the best checkpoint, read from the names as numbers."""
    best = S.best_checkpoint(FI.checkpoint_scores(checkpoint_names(spark, d)))
    return best.select(_r("loss", 2).alias("loss"), _r("f1", 2).alias("f1"))


@query("latest_version", "SRT2 STR8", _CKPT_SQL + """
SELECT 'version_' || max(trial_id) AS latest, CAST(max(trial_id) AS INTEGER) AS version FROM c
""")
def latest_version(spark, d):
    return S.latest_version(checkpoint_names(spark, d), "version")


@query("trial_stamps", "DAT1", """
SELECT event_id, date_trunc('second', ts) AS parsed, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events
""")
def trial_stamps(spark, d):
    """Event times written in the trial folders' form and as epoch seconds;
    both are read back, and must agree."""
    e = V.table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("stamp"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))
    parsed = A.parse_trial_stamp("stamp")
    same = F.assert_true(parsed == A.epoch_to_ts("seconds"), F.lit("stamp and seconds differ"))
    return e.select("event_id", F.coalesce(same.cast("timestamp_ntz"), parsed.cast("timestamp_ntz")).alias("parsed"), "seconds")


@query("concat_vectors", "ARR7 FEA4", """
SELECT vec_id, CAST(len(embedding) + 10 AS INTEGER) AS n, CAST(len(embedding) + label + 1 AS INTEGER) AS slot,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + 1, 6) AS total
FROM embeddings
""")
def concat_vectors(spark, d):
    """Text vector and one-hot category side by side, the models' input."""
    onehot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding", A.concat_vectors(
        F.transform("embedding", lambda x: x.cast("double")), onehot).alias("x"))
    tail = F.size("embedding") + F.array_position(F.slice("x", F.size("embedding") + 1, 10), 1.0)
    return e.select("vec_id", F.size("x").alias("n"), tail.cast("int").alias("slot"),
                    _r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))
