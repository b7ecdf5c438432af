"""Properties on the test tables (SURVEY §5 "Ours")."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from postlens.operators import explain as X
from postlens.operators import prepare as P
from postlens.operators import runs as RU
from postlens.operators import splits as SP
from postlens.plans import q_explain as QE
from postlens.plans import q_features as QF
from postlens.sources import testviews as V


def test_splits_disjoint_complete(spark):
    e = V.event_posts(spark, SF001)
    s = SP.split_posts(e, "row_idx")
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == e.count() and set(counts) == {"train", "val", "test"}
    assert abs(counts["train"] / e.count() - 0.6) < 0.05
    again = SP.split_posts(e.repartition(7), "row_idx")
    assert sorted(s.collect()) == sorted(again.collect())


def test_group_mean_of_score_is_one(spark):
    s = P.impact(V.event_posts(spark, SF001), "group_id")
    m = s.where(F.col("reactions_groupavg") > 0).groupBy("group_id").agg(F.avg("score").alias("m"))
    assert m.where(F.abs(F.col("m") - 1) > 1e-9).count() == 0


def test_rule_groups_partition_after_assignment(spark):
    a, groups = QE.doc_groups(spark, SF001)
    first = groups.groupBy("token").agg(F.min("group_order").alias("g"))
    assert first.count() == groups.select("token").distinct().count()
    assert a.where(F.col("group_order").isNull()).count() == 0


def test_w2v_groups_partition_vocabulary(spark):
    g = QE.token_groups_w2v(spark, SF001)
    vocab = QF.train_vocab(spark, SF001)
    assert g.select("token").distinct().count() == vocab.count() == g.count()
    assert g.select("group_order").distinct().count() <= QE.K + 4


def test_sage_values_sum_to_loss_gap(spark):
    d = SF001
    a, _ = QE.doc_groups(spark, d)
    contrib = a.groupBy("row_idx", "group_order").agg(F.sum(X.token_weight("token", 11) / 100.0).alias("c"))
    targets = QF.doc_split(spark, d).select("row_idx", (F.col("n_chars") / 10000.0).alias("y"))
    perms = X.permutations(spark, 9, 4)
    v = X.sage_additive(contrib, targets, perms, "row_idx", 0.5, "y")
    total = v.agg(F.sum("sage")).first()[0]
    full = contrib.groupBy("row_idx").agg(F.sum("c").alias("c"))
    t = targets.join(full, "row_idx", "left").fillna(0.0, ["c"])
    gap = t.agg(F.avg(F.pow(F.lit(0.5) - F.col("y"), 2) - F.pow(F.lit(0.5) + F.col("c") - F.col("y"), 2))).first()[0]
    assert abs(total - gap) < 1e-9


def test_permutations_are_permutations(spark):
    p = X.permutations(spark, 9, 6)
    per = p.groupBy("perm").agg(F.countDistinct("group_order").alias("n")).collect()
    assert all(r.n == 9 for r in per) and len(per) == 6


@pytest.mark.parametrize("losses,stop,reason", [
    ([3.0, 2.96, 2.0, 2.1, 2.1, 2.1], 6, "patience"),
    ([2.5, 3.2, 1.0], 2, "divergence"),
    ([2.0, 1.9, 1.8], None, None),
])
def test_plateau_rule(spark, losses, stop, reason):
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(losses)],
                               "trial_id int, training_iteration int, loss double")
    r = RU.plateau(df).first()
    assert (r.stop_iteration, r.reason) == (stop, reason)


def test_last_and_best_results(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0.1), (1, 2, 1.0, 0.3), (1, 3, 1.5, 0.2), (2, 1, 0.9, 0.5)],
                               "trial_id int, training_iteration int, loss double, mean_F1 double")
    last = {r.trial_id: r.training_iteration for r in RU.last_results(df).collect()}
    assert last == {1: 3, 2: 1}
    best = {r.trial_id: r.loss for r in RU.best_rows(df).collect()}
    assert best == {1: 1.0, 2: 0.9}
    assert RU.best_trial(df, "loss", "min").first().trial_id == 2
    top = RU.top_k_per_group(df, 2, "trial_id", [F.col("mean_F1").desc()])
    assert sorted((r.trial_id, r.training_iteration) for r in top.collect()) == [(1, 2), (1, 3), (2, 1)]


def test_top_k_uses_group_limit(spark):
    df = V.trial_log(spark, SF001)
    t = RU.top_k_per_group(df, 3, "trial_id", [F.col("mean_F1").desc()])
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sample_trials_and_config(spark):
    t = SP.sample_trials(spark, 50, 42)
    assert t.count() == 50 and t.where(F.col("learning_rate") < 0).count() == 0
    assert {r.batch_size for r in t.collect()} <= {16, 32, 64, 128}
    cfg = P.make_config({"epochs": 3})
    assert cfg["epochs"] == 3 and cfg["vocab_min_freq"] == 10 and cfg["batch_size"] == 128
    m = spark.range(1).select(P.merge_config_maps(F.create_map(F.lit("a"), F.lit("1")),
                                                  F.create_map(F.lit("a"), F.lit("2"))).alias("m")).first().m
    assert m == {"a": "2"}


def test_lasso_shrinks_towards_zero(spark):
    from postlens.operators import models as ML
    e = SP.split_posts(P.impact(V.event_posts(spark, SF001), "group_id"), "row_idx")
    lin = ML.coefficients(ML.fit_impact_linear(e, ["Type"]))
    las = ML.coefficients(ML.fit_impact_lasso(e, ["Type"], alpha=0.1))
    s_lin = sum(abs(r.coefficient) for r in lin.collect())
    s_las = sum(abs(r.coefficient) for r in las.collect())
    assert s_las < s_lin


def test_centroid_similarity_custom_metric(spark):
    from postlens.functions import arrays as A
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [3.0, 0.0]), (3, 1, [0.0, 2.0])],
                              "vec_id long, label int, embedding array<double>")
    neg_dist = lambda a, b: -F.sqrt(A.dot(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(a, b, lambda x, y: x - y)))
    out = {r.vec_id: (r.nearest_label, r.own_cos) for r in
           X.centroid_similarity(v, "vec_id", "label", "embedding", metric=neg_dist).collect()}
    assert out[1] == (0, -1.0) and out[3][0] == 1


def test_sage_of_fitted_text_model_adds_up(spark):
    from postlens.functions.text import tokenize
    from postlens.operators import models as ML
    from postlens.operators import stats as S
    from postlens.plans.q_models import _doc_frame
    docs = _doc_frame(spark, SF001)
    model = ML.fit_impact_text(docs.where(F.col("split") == "train"), "Message", ["Type"], "score")
    test = docs.where((F.col("split") == "test") & F.col("score").isNotNull())
    toks = test.select("row_idx", F.posexplode(tokenize("Message")).alias("pos", "token"))
    groups = X.rule_groups(S.distinct_tokens(toks.select(F.array("token").alias("tokens"))), 3, 7)
    contrib = (X.assign_groups(toks, groups).join(X.linear_token_weights(model), "token")
               .groupBy("row_idx", "group_order").agg(F.sum("weight").alias("c")))
    base = X.linear_row_base(model, test, "row_idx", "Message")
    targets = test.select("row_idx", F.col("score").alias("y")).join(base, "row_idx")
    v = X.sage_additive(contrib, targets, X.permutations(spark, 7, 4), "row_idx", "base", "y")
    total = v.agg(F.sum("sage")).first()[0]
    gap = targets.agg(F.avg(F.pow(F.col("base") - F.col("y"), 2) - F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
    assert abs(total - gap) < 1e-6


def _lasso_cd(X, y, lam, iters=5000):
    """Plain coordinate descent for (1/2n)||y - b - Xw||^2 + lam*||w||_1."""
    import numpy as np
    n, p = X.shape
    w = np.zeros(p)
    b = y.mean()
    for _ in range(iters):
        b = (y - X @ w).mean()
        for j in range(p):
            r = y - b - X @ w + X[:, j] * w[j]
            rho = X[:, j] @ r / n
            z = X[:, j] @ X[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - lam, 0.0) / z
    return w, b


def test_lasso_matches_coordinate_descent(spark):
    import numpy as np
    from postlens.operators import models as ML
    rows = [("a", 1.0), ("a", 1.4), ("b", 3.0), ("b", 2.6), ("b", 2.9), ("c", 0.2), ("c", 0.5), ("d", 2.0)]
    df = spark.createDataFrame(rows, "Type string, score double")
    model = ML.fit_impact_lasso(df, ["Type"], "score", alpha=0.1)
    lin = model.stages[-1]
    cats = sorted({t for t, _ in rows})  # the dropped last slot is the unseen category
    X = np.array([[1.0 if t == c else 0.0 for c in cats] for t, _ in rows])
    y = np.array([s for _, s in rows])
    w, b = _lasso_cd(X, y, 0.1)
    assert np.allclose(lin.coefficients.toArray(), w, atol=1e-4)
    assert abs(lin.intercept - b) < 1e-4


def test_vocab_ids_and_median_independent_of_partitioning(spark):
    from postlens.operators import stats as S
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            v = sorted(QF.vocab(spark, SF001).collect())
            m = sorted(S.median(V.event_posts(spark, SF001), "reactions_sum", by=["Type"]).collect())
            out.append((v, m))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out[0] == out[1]


def test_rescoring_sage_equals_additive_for_linear_model(spark):
    from postlens.functions.text import tokenize
    from postlens.operators import models as ML
    from postlens.operators import stats as S
    from postlens.plans.q_models import _doc_frame
    docs = _doc_frame(spark, SF001)
    model = ML.fit_impact_text(docs.where(F.col("split") == "train"), "Message", ["Type"], "score")
    test = docs.where((F.col("split") == "test") & F.col("score").isNotNull())
    toks = test.select("row_idx", F.posexplode(tokenize("Message")).alias("pos", "token"))
    groups = X.rule_groups(S.distinct_tokens(toks.select(F.array("token").alias("tokens"))), 3, 7)
    assigned = X.assign_groups(toks, groups)
    targets = test.select("row_idx", F.col("score").alias("y"), "Type")
    n_perm = 4
    re = X.sage_rescore(assigned, targets.select("row_idx", "y"), 7, n_perm,
                        lambda ex: model.transform(ex.join(targets.select("row_idx", "Type"), "row_idx")))
    contrib = (assigned.join(X.linear_token_weights(model), "token")
               .groupBy("row_idx", "group_order").agg(F.sum("weight").alias("c")))
    base = X.linear_row_base(model, test, "row_idx", "Message")
    add = X.sage_additive(contrib, targets.select("row_idx", "y").join(base, "row_idx"),
                          X.permutations(spark, 7, n_perm), "row_idx", "base", "y")
    a = {r.group_order: r.sage for r in add.collect()}
    b = {r.group_order: r.sage for r in re.collect()}
    for g in set(a) | set(b):
        assert abs(a.get(g, 0.0) - b.get(g, 0.0)) < 1e-6


def test_foreign_model_scored_with_pandas_matches_spark(spark):
    import os

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from postlens.functions import arrays as A
    from postlens.operators import models as ML
    from postlens.session import ensure_checkpoint_dir
    emb = V.table(spark, SF001, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") / 10.0).alias("y"))
    lr = LinearRegression(featuresCol="f", labelCol="y", regParam=0.1).fit(emb.withColumn("f", array_to_vector("x")))
    path = ML.export_linear(lr, os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), "emb_lin"))
    scored = ML.score_with_pandas(emb, lambda: ML.ArrayLinearModel.load(path), "x", keep=["vec_id"])
    ref = emb.select("vec_id", A.linear("x", lr.coefficients.toArray().tolist(), lr.intercept).alias("p"))
    got = {r.vec_id: r.prediction for r in scored.collect()}
    exp = {r.vec_id: r.p for r in ref.collect()}
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in got)
