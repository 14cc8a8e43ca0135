"""The models of the comparison against their definitions in numpy."""

import numpy as np
import pytest

from tessera.ml import metrics, models


def _frame(spark, X, y):
    names = [f"f{i}" for i in range(X.shape[1])]
    rows = [(i, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in names) + ", y double"), names


def _predict(spark, X, y, model, problem, params):
    df, names = _frame(spark, X, y)
    got = {r["id"]: r["prediction"] for r in models.fit_predict(df, df, names, "y", model, problem, params).collect()}
    return np.array([got[i] for i in range(len(y))])


@pytest.mark.parametrize("alpha", [0.05, 0.4, 5.0])
def test_lasso_equals_coordinate_descent(spark, alpha):
    rng = np.random.default_rng(4)
    X = rng.normal(0, 1, (120, 4)) * [1.0, 2.0, 0.5, 1.5]
    y = X @ np.array([2.0, 0.0, -1.0, 0.1]) + 3 + rng.normal(0, 0.2, 120)
    Xm, ym, w = X - X.mean(0), y - y.mean(), np.zeros(4)
    for _ in range(3000):                                     # minimises |y - Xw|^2 / 2n + alpha |w|_1
        for j in range(4):
            r = ym - Xm @ w + Xm[:, j] * w[j]
            rho = Xm[:, j] @ r / 120
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (Xm[:, j] @ Xm[:, j] / 120)
    want = X @ w + y.mean() - X.mean(0) @ w
    assert _predict(spark, X, y, "Lasso", "regression", {"alpha": alpha}) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("c", [0.1, 1.0, 50.0])
def test_logistic_equals_newton(spark, c):
    rng = np.random.default_rng(9)
    X = rng.normal(0, 1, (150, 3))
    y = (X @ np.array([1.0, -2.0, 0.5]) + 0.3 + rng.logistic(0, 1, 150) > 0).astype(float)
    A, w = np.c_[np.ones(150), X], np.zeros(4)
    ridge = np.diag([0.0, 1, 1, 1]) / c                       # C times the loss plus |w|^2 / 2, intercept free
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ w))
        w -= np.linalg.solve((A.T * (p * (1 - p))) @ A + ridge, A.T @ (p - y) + ridge @ w)
    margin = A @ w
    got = _predict(spark, X, y, "Logistic Regression", "classification", {"C": c})
    sure = np.abs(margin) > 1e-3
    assert (got[sure] == (margin[sure] > 0)).all()


def test_trees_learn_a_step_function(spark):
    rng = np.random.default_rng(1)
    X = rng.uniform(0, 1, (200, 2))
    y = np.where(X[:, 0] > 0.5, 3.0, 1.0) + np.where(X[:, 1] > 0.3, 10.0, 0.0)
    for model, params in (("Decision Tree Regressor", {}), ("Decision Tree Regressor", {"max_depth": 4})):
        err = np.abs(_predict(spark, X, y, model, "regression", params) - y)
        assert (err > 1e-9).mean() < 0.08                     # only points between two candidate splits
    one = _predict(spark, X, y, "Decision Tree Regressor", "regression", {"max_depth": 1})
    assert len(np.unique(one)) == 2                           # one split, leaf means
    for v in np.unique(one):
        assert y[one == v].mean() == pytest.approx(v)
    forest = _predict(spark, X, y, "Random Forest", "regression", {"n_estimators": 20})
    assert 1 - ((forest - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.95


def test_classifiers_learn_rings_or_blobs(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 0.5, (80, 2)), rng.normal(4, 0.5, (80, 2)), rng.normal([0, 5], 0.5, (80, 2))])
    y = np.repeat([0.0, 1.0, 2.0], 80)
    for model in ("Decision Tree Classifier", "Random Forest", "Naive Bayes", "SVM Classifier", "Logistic Regression"):
        assert (_predict(spark, X, y, model, "classification", {}) == y).mean() > 0.97, model
    r = np.r_[rng.uniform(0, 1, 100), rng.uniform(2, 3, 100)]
    t = rng.uniform(0, 2 * np.pi, 200)
    rings, inner = np.c_[r * np.cos(t), r * np.sin(t)], np.repeat([0.0, 1.0], 100)
    assert (_predict(spark, rings, inner, "SVM Classifier", "classification", {"kernel": "rbf", "C": 10.0}) == inner).mean() > 0.95


def test_naive_bayes_equals_gaussian_densities(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (70, 2)), rng.normal(1.2, 2, (50, 2))])
    y = np.repeat([0.0, 1.0], [70, 50])
    score = np.stack([np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * X[y == c].var(0)) + (X - X[y == c].mean(0)) ** 2 / X[y == c].var(0)).sum(1)
                      for c in (0, 1)])
    sure = np.abs(score[0] - score[1]) > 1e-3
    got = _predict(spark, X, y, "Naive Bayes", "classification", {})
    assert (got[sure] == score.argmax(0)[sure]).all()


def test_boosting_and_kernel_regression_fit_a_curve(spark):
    x = np.linspace(-3, 3, 150)
    y = np.sin(x) * 2 + 0.1 * x
    for model, params, least in (("AdaBoost", {"n_estimators": 10}, 0.97), ("SVM Regressor", {"kernel": "rbf", "C": 100.0}, 0.9)):
        df, names = _frame(spark, x[:, None], y)
        pred = models.fit_predict(df, df, names, "y", model, "regression", params)
        assert metrics.regression_metrics(pred, "y", "prediction").first().r2 > least, model
