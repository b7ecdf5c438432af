"""Fits on packed terms: no growing estimates, and rows that repeat or have no key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import gradient as GR


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0), (2, 0.0), (None, 5.0), (3, None)], "row_idx long, y double")
    terms = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 1.0), (3, "b", 1.0), (9, "c", 1.0)],
                                  "row_idx long, term string, x double")
    return rows, terms


def test_a_fit_does_not_multiply_estimates_and_has_the_least_loss(small):
    rows, terms = small
    model = GR.fit_heads(terms, rows, [GR.Head("y", "y", "squared")], l2=0.1, tol=1e-9, max_steps=8)
    digits = model.weights._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert digits < 1000
    # repeated rows all have their key's terms, rows without a key none
    x = np.array([[1, 2, 1], [1, 2, 1], [1, 0, 1], [0, 0, 1], [0, 0, 1]], float)
    y = np.array([1, 3, 2, 0, 5], float)
    want = np.linalg.solve(x.T @ x / 5 + np.diag([0.1, 0.1, 0]), x.T @ y / 5)
    got = {r.term: r.w[0] for r in model.weights.collect()}
    assert [got["a"], got["b"], model.intercepts[0]] == pytest.approx(want, abs=1e-4) and set(got) == {"a", "b"}
    scores = GR.predict(terms, rows, model).select("row_idx", "y", F.col("scores")[0].alias("s")).collect()
    at = {(r.row_idx, r.y): r.s for r in scores}
    assert len(at) == 6 and at[(0, 1.0)] == at[(0, 3.0)] == pytest.approx(x[0] @ want, abs=1e-4)
    assert at[(None, 5.0)] == pytest.approx(want[2], abs=1e-4) and at[(3, None)] == pytest.approx(want[1] + want[2], abs=1e-4)


def test_rows_without_any_terms_fit_the_intercept(small):
    rows, terms = small
    model = GR.fit_heads(terms.where("row_idx = 77"), rows, [GR.Head("y", "y", "squared")], l2=0.1, tol=1e-6, max_steps=2)
    assert model.weights.count() == 0 and model.intercepts[0] == pytest.approx(2.2, abs=1e-6)
    assert [r.scores[0] for r in GR.predict(terms, rows, model).collect()] == [pytest.approx(2.2, abs=1e-6)] * 6
