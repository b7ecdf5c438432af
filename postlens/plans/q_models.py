"""Queries: Spark ML baselines for impact, party, stance and target."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import arrays as A
from postlens.functions.text import ascii_only
from postlens.operators import metrics as M
from postlens.operators import models as ML
from postlens.operators import prepare as P
from postlens.operators import splits as SP
from postlens.plans.q_prepare import _DOMAIN_SQL, _EVENT_IMPACT_SQL, _r, event_impact
from postlens.plans.q_features import SPLIT_SQL, doc_split
from postlens.plans.registry import query
from postlens.sources import testviews as V


def _event_split(spark, d):
    return SP.split_posts(event_impact(spark, d), "row_idx")


_EVENT_TRAIN_SQL = _EVENT_IMPACT_SQL + f""",
tr AS (SELECT * FROM s WHERE {SPLIT_SQL} = 'train' AND score IS NOT NULL)
"""


@query("impact_linear", "MLJ1 MLJ3 FEA1", _EVENT_TRAIN_SQL + """,
te AS (SELECT * FROM s WHERE """ + SPLIT_SQL + """ = 'test')
SELECT te.row_idx, round(m.mean_score, 4) AS prediction
FROM te JOIN (SELECT "Type", avg(score) AS mean_score FROM tr GROUP BY 1) m USING ("Type")
""")
def impact_linear(spark, d):
    sp = _event_split(spark, d)
    model = ML.fit_impact_linear(sp.where(F.col("split") == "train"), ["Type"], "score")
    pred = ML.score(sp.where(F.col("split") == "test"), model)
    return pred.select("row_idx", _r("prediction", 4).alias("prediction"))


@query("linear_coefficients", "EXP6 MLJ1", _EVENT_TRAIN_SQL + """
SELECT 'Type=' || "Type" AS feature, round(avg(score), 4) AS coefficient FROM tr GROUP BY 1
""")
def linear_coefficients(spark, d):
    sp = _event_split(spark, d)
    model = ML.fit_impact_linear(sp.where(F.col("split") == "train"), ["Type"], "score")
    return ML.coefficients(model).select("feature", _r("coefficient", 4).alias("coefficient"))


@query("impact_linear_domain", "MLJ1 MLJ3 PRJ8", V.with_sql(V.DOC_POSTS_SQL) + "," + _DOMAIN_SQL.replace(
    "\nSELECT row_idx, CAST(group_id", ",\ncf AS (SELECT row_idx, CAST(group_id").rstrip() + f"""),
s AS (SELECT cf.row_idx, cf.post_type, cf.domain, p.n_chars / nullif(avg(p.n_chars) OVER (PARTITION BY p.group_id), 0) AS score
      FROM cf JOIN doc_posts p USING (row_idx)),
tr AS (SELECT * FROM s WHERE score IS NOT NULL AND {SPLIT_SQL} = 'train')
SELECT 'post_type' AS feature, post_type AS value, count(*) AS n, CAST(0.0 AS DOUBLE) AS mean_residual,
       round(avg(score), 3) AS mean_prediction FROM tr GROUP BY ALL
UNION ALL
SELECT 'domain', domain, count(*), CAST(0.0 AS DOUBLE), round(avg(score), 3) FROM tr GROUP BY ALL
""")
def impact_linear_domain(spark, d):
    """Least squares on post type and link domain together.  That it is the
    least-squares fit shows in its residuals: over the rows of each category
    they sum to 0, so the mean prediction is the mean score."""
    posts = V.doc_posts(spark, d).withColumn("reactions_sum", F.col("n_chars").cast("double"))
    c = P.category_features(P.impact(posts, "group_id"), "group_id", "Type", "Link")
    train = SP.split_posts(c, "row_idx").where((F.col("split") == "train") & F.col("score").isNotNull())
    model = ML.fit_impact_linear(train, ["post_type", "domain"], "score")
    res = ML.score(train, model).select("post_type", "domain", "prediction", (F.col("score") - F.col("prediction")).alias("e"))
    both = res.select("e", "prediction", F.explode(F.array(
        F.struct(F.lit("post_type").alias("feature"), F.col("post_type").alias("value")),
        F.struct(F.lit("domain").alias("feature"), F.col("domain").alias("value")))).alias("c"))
    return both.groupBy("c.feature", "c.value").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.round(F.avg("e"), 3)).alias("mean_residual"),
        F.round(F.avg("prediction"), 3).alias("mean_prediction"))


@query("impact_lasso", "MLJ2")
def impact_lasso(spark, d):
    sp = _event_split(spark, d)
    model = ML.fit_impact_lasso(sp.where(F.col("split") == "train"), ["Type"], "score", 0.1)
    return ML.coefficients(model)


LASSO_ALPHA = 0.1


@query("lasso_certificate", "MLJ2", _EVENT_TRAIN_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
c AS (SELECT "Type" AS value, count(*)::DOUBLE AS n, avg(score) AS m FROM tr GROUP BY 1),
t AS (SELECT {LASSO_ALPHA} * sum(n) AS a FROM c),
it AS (SELECT 0 AS i, (SELECT min(m) FROM c) AS lo, (SELECT max(m) FROM c) AS hi
       UNION ALL
       SELECT i + 1, CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END
       FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                    (SELECT sum(n * greatest(least(m - (lo + hi) / 2, a / n), -a / n)) FROM c, t) AS f FROM it WHERE i < 60)),
b AS (SELECT lo AS b FROM it WHERE i = 60)
SELECT 'Type' AS feature, value, round(sign(m - b) * greatest(abs(m - b) - a / n, 0), 3) AS coefficient, true AS gap_small
FROM c, b, t
""")
def lasso_certificate(spark, d):
    """Lasso of the impact score on the post type.  In SQL: each type's mean,
    moved towards the intercept by alpha n / n_type, with the intercept at which
    the residuals add up to 0."""
    from postlens.operators.lasso import fit_lasso, lasso_weights
    model = fit_lasso(_event_split(spark, d).where(F.col("split") == "train"), ["Type"], "score", LASSO_ALPHA, 1e-8)
    return lasso_weights(model).select("feature", "value", _r("coefficient", 3).alias("coefficient"),
                                       F.lit(bool(model.gap <= 1e-6)).alias("gap_small"))


FIXED_W = [((i % 9) - 4) / 20.0 for i in range(64)]


@query("fixed_weight_scores", "MLJ3 MTH4 AGG8", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos
           FROM embeddings),
p AS (SELECT vec_id, label, 0.25 + sum(x * ((pos % 9) - 4) / 20.0) AS prediction FROM e GROUP BY ALL)
SELECT label, round(avg(power(prediction - label / 10.0, 2)), 6) AS mse, round(avg(prediction), 6) AS mean_pred,
       count(*) AS n
FROM p GROUP BY label
""")
def fixed_weight_scores(spark, d):
    e = V.table(spark, d, "embeddings").withColumn(
        "prediction", A.linear(F.transform("embedding", lambda x: x.cast("double")), FIXED_W, 0.25))
    e = e.withColumn("target", F.col("label") / 10.0)
    m = M.mse(e, "prediction", "target", by=["label"], extra=[F.avg("prediction").alias("mean_pred")])
    return m.select("label", _r("mse").alias("mse"), _r("mean_pred").alias("mean_pred"), "n")


def _doc_frame(spark, d):
    """Documents as posts with an impact score (length vs. its source's mean)."""
    docs = doc_split(spark, d).withColumn("reactions_sum", F.col("n_chars").cast("double"))
    docs = P.impact(docs, "group_id")
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("row_idx"), "toxic", "quality")
    docs = docs.join(labels, "row_idx", "left")
    return docs.withColumn("party", (F.col("Type") == "en").cast("double"))


@query("impact_text_model", "MLJ4")
def impact_text_model(spark, d):
    docs = _doc_frame(spark, d)
    model = ML.fit_impact_text(docs.where(F.col("split") == "train"), "Text", ["Type"], "score")
    pred = ML.score(docs.where(F.col("split") == "test"), model)
    return pred.select("row_idx", "score", F.col("prediction"))


@query("party_model", "MLJ5")
def party_model(spark, d):
    docs = _doc_frame(spark, d)
    model = ML.fit_party(docs.where(F.col("split") == "train"), "Text", (), "party")
    pred = ML.score(docs.where(F.col("split") == "test"), model)
    return pred.select("row_idx", "party", "prediction")


@query("stance_target_model", "MLJ6 AGG13")
def stance_target_model(spark, d):
    gold = V.stance_gold(spark, d).where(F.col("Stance") != "UNKNOWN")
    codes = M.target_codes(gold)
    enc = SP.split_stance(M.encode_labels(gold, codes), "row_idx")
    enc = enc.withColumn("Tweet", ascii_only("Tweet"))
    model = ML.fit_stance_target(enc.where(F.col("split") == "train"), "Tweet")
    pred = ML.score(enc.where(F.col("split") == "val"), model)
    return pred.select("row_idx", "stance_id", "target_id", F.col("stance_pred").cast("int").alias("stance_pred"),
                       F.col("target_pred").cast("int").alias("target_pred"))


@query("score_party_model", "MLJ7")
def score_party_model(spark, d):
    docs = _doc_frame(spark, d).withColumn("impact", F.col("impact").cast("double"))
    model = ML.fit_score_party(docs.where(F.col("split") == "train"), "Text")
    pred = ML.score(docs.where(F.col("split") == "test"), model)
    return pred.select("row_idx", "impact_pred", "party_pred")


@query("hyper_search", "MLJ8 SPL5 AGG22")
def hyper_search(spark, d):
    gold = V.stance_gold(spark, d).where(F.col("Stance") != "UNKNOWN")
    enc = M.encode_labels(gold, M.target_codes(gold)).withColumn("Tweet", ascii_only("Tweet"))
    return ML.search(enc, "Tweet", "stance_id", trials=4, parallelism=4)


@query("sage_text_model", "EXP3 EXP2 MLJ4 JN7")
def sage_text_model(spark, d):
    """SAGE of the fitted TF-IDF impact regression on the test split: the
    model is linear in token counts, so group contributions are sums of
    token weights and the additive estimator is exact."""
    from postlens.operators import explain as X
    from postlens.operators import stats as S
    docs = ML.with_tokens(_doc_frame(spark, d), "Text", ["row_idx", "split", "Type", "score"])
    model = ML.fit_impact_text(docs.where(F.col("split") == "train"), "Text", ["Type"], "score")
    test = docs.where((F.col("split") == "test") & F.col("score").isNotNull())
    toks = test.select("row_idx", F.posexplode("__tok").alias("pos", "token"))
    groups = X.rule_groups(S.distinct_tokens(toks.select(F.array("token").alias("tokens"))), 5, 7)
    contrib = (X.assign_groups(toks, groups).join(X.linear_token_weights(model), "token")
               .groupBy("row_idx", "group_order").agg(F.sum("weight").alias("c")))
    targets = test.select("row_idx", F.col("score").alias("y")).join(
        X.linear_row_base(model, test, "row_idx", "Text"), "row_idx")
    v = X.sage_additive(contrib, targets, X.permutations(spark, 9, 6), "row_idx", "base", "y")
    return v.select("group_order", "sage", "std_err")


@query("foreign_model_scores", "MLJ3")
def foreign_model_scores(spark, d):
    """A model trained by Spark ML, turned into a plain numpy model and
    scored outside Spark's ML API with mapInPandas.  The artifact is one
    weight per feature, so it travels in the task closure (no file on a
    machine-local path); models kept on shared storage use a loader that
    reads from there."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    emb = V.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") / 10.0).alias("y"))
    lr = LinearRegression(featuresCol="f", labelCol="y", regParam=0.1).fit(emb.withColumn("f", array_to_vector("x")))
    model = ML.ArrayLinearModel(lr.coefficients.toArray(), lr.intercept)
    return ML.score_with_pandas(emb, lambda: model, "x", keep=["vec_id", "y"])
