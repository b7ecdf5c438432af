"""Models with weights as a table against Spark ML's on a small vocabulary."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from postlens.operators import gradient as GR

L2 = 0.05


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n, v = 300, 12
    x = rng.poisson(0.7, size=(n, v)) * rng.uniform(0.3, 2, size=v)
    x[::17] = 0  # rows without terms
    true = rng.normal(size=(v, 5))
    s = x @ true + rng.normal(size=(n, 5))
    y = s[:, 0] + 3
    b = (s[:, 1] > 0.4).astype(float)
    c = s[:, 2:5].argmax(1).astype(float)
    labels = [(i, float(y[i]) if i % 10 else None, float(b[i]), float(c[i]) if i % 3 else None) for i in range(n)]
    rows = spark.createDataFrame(labels, "row_idx long, y double, b double, c double").cache()
    terms = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(n) for j in range(v) if x[i, j]],
                                  "row_idx long, term string, x double").cache()
    ml = spark.createDataFrame([(*labels[i], x[i].tolist()) for i in range(n)],
                               "row_idx long, y double, b double, c double, x array<double>").withColumn("f", array_to_vector("x"))
    heads = [GR.Head("impact", "y", "squared"), GR.Head("party", "b", "binary"), GR.Head("stance", "c", "classes", 3)]
    model = GR.fit_heads(terms, rows, heads, l2=L2, tol=2e-5, max_steps=60)
    return rows, terms, ml, model, v


def weights(model, name, v):
    got = {r.term: r.w for r in model.weights.collect()}
    at = list(model.slots(name))
    return np.array([[got[f"t{j}"][k] for k in at] for j in range(v)]), model.intercepts[at]


def test_squared(data):
    rows, terms, ml, model, v = data
    # Spark divides the penalty of squares by the label's deviation
    std = ml.agg(F.stddev("y")).first()[0]
    want = LinearRegression(featuresCol="f", labelCol="y", regParam=L2 * std, elasticNetParam=0.0, standardization=False,
                            tol=1e-12, maxIter=500).fit(ml.where("y is not null"))
    w, b = weights(model, "impact", v)
    assert w[:, 0] == pytest.approx(want.coefficients.toArray(), abs=1e-3) and b[0] == pytest.approx(want.intercept, abs=2e-3)


def test_binary(data):
    rows, terms, ml, model, v = data
    want = LogisticRegression(featuresCol="f", labelCol="b", regParam=L2, standardization=False, tol=1e-12, maxIter=500).fit(ml)
    w, b = weights(model, "party", v)
    assert w[:, 0] == pytest.approx(want.coefficients.toArray(), abs=1e-3) and b[0] == pytest.approx(want.intercept, abs=2e-3)


def test_classes(data):
    rows, terms, ml, model, v = data
    want = LogisticRegression(featuresCol="f", labelCol="c", family="multinomial", regParam=L2, standardization=False,
                              tol=1e-12, maxIter=500).fit(ml.where("c is not null"))
    w, b = weights(model, "stance", v)
    assert w == pytest.approx(want.coefficientMatrix.toArray().T, abs=1e-3)
    assert b - b.mean() == pytest.approx(want.interceptVector.toArray() - want.interceptVector.toArray().mean(), abs=2e-3)


def test_gradient_lengths_fall(data):
    rows, terms, ml, model, v = data
    assert all(model.gradient[-1] <= 2e-5) and model.gradient[0].tolist() == [1.0, 1.0, 1.0]
    start = GR.Fitted(model.heads, model.weights.withColumn("w", F.transform("w", lambda x: x * 0)), model.intercepts * 0)
    ratio = GR.gradient_lengths(terms, rows, model, L2) / GR.gradient_lengths(terms, rows, start, L2)
    assert all(ratio <= 1e-4)


def test_predictions_of_rows_without_terms(data):
    rows, terms, ml, model, v = data
    got = {r.row_idx: r.scores for r in GR.predict(terms, rows, model).collect()}
    assert len(got) == 300 and got[0] == pytest.approx(model.intercepts)
    # an intercept that is not penalised makes the mean prediction the mean label
    mean = GR.predict(terms, rows, model).where("y is not null").agg(F.avg(F.col("scores")[0] - F.col("y"))).first()[0]
    assert mean == pytest.approx(0, abs=1e-3)


def test_term_tables(spark):
    df = spark.createDataFrame([(0, "a b a", "x"), (1, "b c", None), (2, None, "x"), (3, "", "y")], "row_idx long, text string, cat string")
    counts = GR.term_rows(df, "row_idx", "text", ["cat"])
    assert {(r.row_idx, r.term, r.n) for r in counts.collect()} == {
        (0, "t:a", 2), (0, "t:b", 1), (1, "t:b", 1), (1, "t:c", 1), (0, "cat=x", 1), (2, "cat=x", 1), (3, "cat=y", 1)}
    table = GR.term_table(counts, df, "row_idx", 2)
    assert {r.term: r.idf for r in table.collect()} == {"t:b": pytest.approx(np.log(5 / 3)), "cat=x": 1.0}
    assert {(r.row_idx, r.term): r.x for r in GR.weighted(counts, table, "row_idx").collect()} == {
        (0, "t:b"): pytest.approx(np.log(5 / 3)), (1, "t:b"): pytest.approx(np.log(5 / 3)), (0, "cat=x"): 1.0, (2, "cat=x"): 1.0}


def test_unknown_loss():
    with pytest.raises(ValueError, match="no loss hinge"):
        GR.Head("a", "y", "hinge")
