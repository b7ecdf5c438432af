"""Queries: label dictionaries, alignment, scorer metrics, errors and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import arrays as A
from postlens.operators import metrics as M
from postlens.plans.q_prepare import _LINE_IMPACT_SQL, _r, lineitem_impact_frame
from postlens.plans.registry import query
from postlens.sources import testviews as V

_ALIGNED_SQL = V.with_sql(V.STANCE_GOLD_SQL, V.STANCE_GUESS_SQL, """a AS (
  SELECT g.row_idx, g."Target", g."Stance" AS gold, p."Stance" AS guess
  FROM stance_gold g JOIN stance_guess p USING (row_idx))""")

_COUNTS_SQL = _ALIGNED_SQL + """,
labels(label) AS (VALUES ('FAVOR'), ('AGAINST'), ('NONE'), ('UNKNOWN')),
c AS (SELECT l.label,
        (SELECT count(*) FROM a WHERE a.guess = l.label AND a.gold = l.label) AS n_tp,
        (SELECT count(*) FROM a WHERE a.guess = l.label) AS n_guess,
        (SELECT count(*) FROM a WHERE a.gold = l.label) AS n_gold
      FROM labels l),
s AS (SELECT *, coalesce(n_tp / nullif(n_guess, 0), 0.0) AS precision,
             coalesce(n_tp / nullif(n_gold, 0), 0.0) AS recall FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f FROM s)
"""


def aligned(spark, d):
    return M.align(V.stance_gold(spark, d), V.stance_guess(spark, d), strict=True)


def scores(spark, d):
    return M.prf(M.label_counts(aligned(spark, d)))


@query("align_gold_guess", "JN2 JN10", _ALIGNED_SQL + "SELECT row_idx, gold, guess FROM a")
def align_gold_guess(spark, d):
    return aligned(spark, d).select("row_idx", "gold", "guess")


@query("stance_scores", "AGG10 AGG11 JN2", _COUNTS_SQL + """
SELECT label, n_tp, n_guess, n_gold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f, 6) AS f FROM f
""")
def stance_scores(spark, d):
    s = scores(spark, d)
    return s.select("label", "n_tp", "n_guess", "n_gold", _r("precision").alias("precision"),
                    _r("recall").alias("recall"), _r("f").alias("f"))


@query("macro_f", "AGG12", _COUNTS_SQL + """
SELECT round(avg(f), 6) AS macro_f FROM f WHERE label IN ('FAVOR', 'AGAINST')
""")
def macro_f(spark, d):
    return M.macro_f(scores(spark, d)).select(_r("macro_f").alias("macro_f"))


@query("score_report", "STR13 AGG11", _COUNTS_SQL + """
SELECT label, printf('%-9s precision: %.4f recall: %.4f f-score: %.4f', label, precision, recall, f) AS line
FROM f WHERE label IN ('FAVOR', 'AGAINST')
""")
def score_report(spark, d):
    return M.score_report(scores(spark, d))


@query("micro_f1", "AGG13", _ALIGNED_SQL + """
SELECT "Target", round(avg(CAST(gold = guess AS DOUBLE)), 6) AS micro_f1 FROM a GROUP BY 1
""")
def micro_f1(spark, d):
    m = M.micro_f1(aligned(spark, d), "guess", "gold", by=["Target"])
    return m.select("Target", _r("micro_f1").alias("micro_f1"))


@query("same_count", "AGG27", V.with_sql(V.STANCE_GOLD_SQL, V.STANCE_GUESS_SQL) + """
SELECT (SELECT count(*) FROM stance_gold) AS n_gold, (SELECT count(*) FROM stance_guess) AS n_guess,
       (SELECT count(*) FROM stance_gold) = (SELECT count(*) FROM stance_guess) AS same
""")
def same_count(spark, d):
    return M.same_count(V.stance_gold(spark, d), V.stance_guess(spark, d))


@query("label_distribution", "AGG28", V.with_sql(V.STANCE_GOLD_SQL, V.STANCE_GUESS_SQL) + """
SELECT 'gold' AS side, "Target", "Stance", count(*) AS n FROM stance_gold GROUP BY ALL
UNION ALL
SELECT 'guess' AS side, "Target", "Stance", count(*) AS n FROM stance_guess GROUP BY ALL
""")
def label_distribution(spark, d):
    g = M.label_distribution(V.stance_gold(spark, d)).select(F.lit("gold").alias("side"), "*")
    p = M.label_distribution(V.stance_guess(spark, d)).select(F.lit("guess").alias("side"), "*")
    return g.unionByName(p)


_CODES_SQL = V.with_sql(V.STANCE_GOLD_SQL, """codes AS (
  SELECT "Target", CAST(row_number() OVER (ORDER BY min(row_idx)) - 1 AS INTEGER) AS target_id
  FROM stance_gold WHERE "Target" IS NOT NULL GROUP BY "Target")""", """enc AS (
  SELECT g.row_idx, g."Target", g."Stance", c.target_id,
         CAST(CASE g."Stance" WHEN 'AGAINST' THEN 0 WHEN 'FAVOR' THEN 1 WHEN 'NONE' THEN 2
                              WHEN 'UNKNOWN' THEN 3 END AS INTEGER) AS stance_id
  FROM stance_gold g LEFT JOIN codes c USING ("Target"))""")


def encoded(spark, d):
    gold = V.stance_gold(spark, d)
    codes = M.target_codes(gold)
    return M.encode_labels(gold, codes), codes


@query("encode_labels", "JN3 AGG18", _CODES_SQL + "SELECT row_idx, stance_id, target_id FROM enc")
def encode_labels(spark, d):
    enc, _ = encoded(spark, d)
    return enc.select("row_idx", "stance_id", "target_id")


@query("decode_labels", "JN4 MAP1", _CODES_SQL + """
SELECT row_idx, "Stance" AS stance_label, "Target" AS target_label FROM enc
""")
def decode_labels(spark, d):
    enc, codes = encoded(spark, d)
    dec = M.decode_labels(enc.select("row_idx", "stance_id", "target_id"), codes)
    return dec.select("row_idx", "stance_label", "target_label")


_NAMES_SQL = V.with_sql(V.DOC_POSTS_SQL) + """
SELECT group_id, arg_max("Type", row_idx) AS "Name" FROM doc_posts WHERE group_id IS NOT NULL GROUP BY 1
"""


@query("group_names", "JN1 AGG19", _NAMES_SQL)
def group_names(spark, d):
    return M.group_names(V.doc_text(spark, d), "group_id", "Type").withColumnRenamed("Type", "Name")


_PRED_SQL = _LINE_IMPACT_SQL + """,
p AS (SELECT *, 1.0 + ("Love" - 0.04) * 10 AS prediction FROM s),
names AS (SELECT s_suppkey AS group_id, s_name AS "Name" FROM supplier)
"""


def lineitem_predictions(spark, d):
    s = lineitem_impact_frame(spark, d)
    return s.withColumn("prediction", F.lit(1.0) + (F.col("Love") - 0.04) * 10)


def supplier_names(spark, d):
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("group_id"), F.col("s_name").alias("Name"))


@query("mse_by_group", "AGG9 JN11 JN1 AGG8", _PRED_SQL + """
SELECT n.group_id, n."Name", round(avg(power(p.prediction - p.score, 2)), 6) AS mse,
       count(p.prediction - p.score) AS n
FROM names n LEFT JOIN p ON p.group_id = n.group_id GROUP BY ALL
""")
def mse_by_group(spark, d):
    out = M.mse_by_group(lineitem_predictions(spark, d), supplier_names(spark, d), "group_id", "prediction", "score")
    return out.select("group_id", "Name", _r("mse").alias("mse"), "n")


@query("mse_overall", "AGG8 MTH1", _PRED_SQL + """
SELECT round(avg(power(prediction - score, 2)), 6) AS mse, count(prediction - score) AS n,
       round(avg(abs(prediction - score)), 6) AS mae FROM p
""")
def mse_overall(spark, d):
    p = lineitem_predictions(spark, d)
    m = M.mse(p, "prediction", "score", extra=[F.avg(F.abs(F.col("prediction") - F.col("score"))).alias("mae")])
    return m.select(_r("mse").alias("mse"), "n", _r("mae").alias("mae"))


_EMB_SQL = """WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT vec_id, label, v AS logits, list_sum(v) / 8 AS x0 FROM e)
"""


@query("mean_loss", "AGG14 MTH2", _EMB_SQL + """,
r AS (SELECT *, list_max(logits) AS m FROM l),
z AS (SELECT *, m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) AS lse,
             least(greatest(1 / (1 + exp(-x0)), 1e-7), 1 - 1e-7) AS p FROM r)
SELECT round(avg(lse - logits[label + 1]), 6) AS ce_loss,
       round(avg(-(CAST(label >= 5 AS DOUBLE) * ln(p) + (1 - CAST(label >= 5 AS DOUBLE)) * ln(1 - p))), 6) AS bce_loss,
       round(avg(power(x0 - label / 10.0, 2)), 6) AS mse_loss
FROM z
""")
def mean_loss(spark, d):
    e = V.table(spark, d, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.select("label", F.col("v").alias("logits"),
                 (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 8).alias("x0"))
    e = (e.withColumn("prob", A.sigmoid("x0")).withColumn("bin", (F.col("label") >= 5).cast("double"))
         .withColumn("target", F.col("label") / 10.0))
    losses = M.mean_losses(e, {"ce": ("logits", "label"), "bce": ("prob", "bin"), "mse": ("x0", "target")})
    return losses.select(*[_r(c).alias(c) for c in ("ce_loss", "bce_loss", "mse_loss")])


@query("argmax_softmax", "ARR3 ARR4 MTH2", _EMB_SQL + """
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
       round(list_max(logits), 6) AS top_logit,
       round(1.0 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 6) AS top_prob,
       round(greatest(x0, 0.0), 6) AS relu0
FROM l
""")
def argmax_softmax(spark, d):
    e = V.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    x0 = F.aggregate("logits", F.lit(0.0), lambda a, x: a + x) / 8
    return e.select("vec_id", A.argmax("logits").alias("pred"), _r(A.array_max("logits")).alias("top_logit"),
                    _r(F.array_max(A.softmax("logits"))).alias("top_prob"),
                    _r(A.relu(x0)).alias("relu0"))


@query("two_head_loss", "AGG13 AGG14 ARR3", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT v[1:4] AS s, v[5:64] AS t, label % 4 AS sl, label % 5 AS tl FROM e),
z AS (SELECT *, list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) AS s_lse,
             list_max(t) + ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t))))) AS t_lse FROM l),
a AS (SELECT avg(CASE WHEN sl <> 3 THEN s_lse - s[sl + 1] END) AS stance_loss, avg(t_lse - t[tl + 1]) AS target_loss,
             avg(CASE WHEN sl <> 3 THEN CAST(list_position(s, list_max(s)) - 1 = sl AS DOUBLE) END) AS stance_f1,
             avg(CAST(list_position(t, list_max(t)) - 1 = tl AS DOUBLE)) AS target_f1 FROM z)
SELECT round(stance_loss, 6) AS stance_loss, round(target_loss, 6) AS target_loss, round(stance_f1, 6) AS stance_f1,
       round(target_f1, 6) AS target_f1, round(stance_loss + target_loss, 6) AS loss,
       round((stance_f1 + target_f1) / 2, 6) AS mean_f1
FROM a
""")
def two_head_loss(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = V.table(spark, d, "embeddings").select(
        F.slice(v, 1, 4).alias("s"), F.slice(v, 5, 60).alias("t"),
        (F.col("label") % 4).alias("sl"), (F.col("label") % 5).alias("tl"))
    out = M.two_head_loss(e, "s", "sl", "t", "tl")
    return out.select(*[_r(c).alias(c) for c in out.columns])
