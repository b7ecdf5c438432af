"""Lasso on categories against coordinate descent and its optimality rules."""

import numpy as np
import pytest

from postlens.operators.lasso import fit_lasso, lasso_weights


def plain(x, y, alpha, steps=4000):
    """Coordinate descent with an intercept."""
    n, w, b = len(y), np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        b = (y - x @ w).mean()
        for j in range(x.shape[1]):
            r = y - b - x @ w + x[:, j] * w[j]
            rho, z = x[:, j] @ r / n, (x[:, j] ** 2).sum() / n
            w[j] = np.sign(rho) * max(0, abs(rho) - alpha) / z
    return w, b


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(0)
    a, c = rng.integers(0, 4, 300), rng.choice(6, 300, p=[.5, .2, .1, .1, .06, .04])
    y = np.array([0, .3, -1, 2.])[a] + np.array([0, .1, 1, -2, .05, 3])[c] + 0.3 * rng.normal(size=300)
    names = lambda k, v: None if v == 1 else f"{k}{v}"  # noqa: E731  one value of each column is null
    rows = [(names("a", i), names("c", j), float(v)) for i, j, v in zip(a, c, y)] + [("a9", "c9", None)]
    return a, c, y, spark.createDataFrame(rows, "type string, domain string, score double")


@pytest.mark.parametrize("alpha", [0.1, 50.0])
def test_two_columns(posts, alpha):
    a, c, y, df = posts
    model = fit_lasso(df, ["type", "domain"], "score", alpha, tol=1e-7, max_steps=25)
    x = np.c_[np.eye(4)[a], np.eye(6)[c]]
    w, b = plain(x, y, alpha, 300)
    value = lambda w, b: ((y - b - x @ w) ** 2).sum() / (2 * len(y)) + alpha * abs(w).sum()
    got = {(r.feature, r.value): r.coefficient for r in lasso_weights(model).collect()}
    keys = [("type", None if i == 1 else f"a{i}") for i in range(4)] + [("domain", None if i == 1 else f"c{i}") for i in range(6)]
    assert set(got) == set(keys)
    mine = np.array([got[k] for k in keys])
    # the gap bounds how far the objective is from the least one
    assert 0 <= value(mine, model.intercept) - value(w, b) + 1e-9 <= model.gap * y.var() + 2e-9
    assert model.gap <= 2e-3
    if alpha == 50:
        assert (mine == 0).all() and model.intercept == pytest.approx(y.mean()) and model.steps == 0


def test_one_column_is_soft_threshold(posts):
    a, c, y, df = posts
    alpha, n = 0.1, len(y)
    model = fit_lasso(df, ["type"], "score", alpha, tol=1e-9, max_steps=12)
    got = {r.value: r.coefficient for r in lasso_weights(model).collect()}
    for i in range(4):
        mean, k = y[a == i].mean() - model.intercept, (a == i).sum()
        assert got[None if i == 1 else f"a{i}"] == pytest.approx(np.sign(mean) * max(0, abs(mean) - alpha * n / k), abs=1e-4)


def test_no_rows(spark):
    df = spark.createDataFrame([("a", None)], "type string, score double")
    model = fit_lasso(df, ["type"], "score", 0.1)
    assert model.weights.count() == 0 and (model.intercept, model.gap, model.steps) == (0.0, 0.0, 0)
