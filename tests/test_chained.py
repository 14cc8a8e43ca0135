"""Chained imputation against a plain numpy copy of the definition."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import chained


def _ols(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(a, y, rcond=None)[0]


def _bayes(x, y):
    """Evidence maximisation with n x n and p x p matrices of the data itself."""
    mx, my = x.mean(0), y.mean()
    x, y = x - mx, y - my
    n, p = x.shape
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        beta = np.linalg.solve(x.T @ x + lam / alpha * np.eye(p), x.T @ y)
        cover = np.linalg.inv(alpha * x.T @ x + lam * np.eye(p))
        gamma = p - lam * np.trace(cover)
        lam = (gamma + 2e-6) / (beta @ beta + 2e-6)
        alpha = (n - gamma + 2e-6) / (((y - x @ beta) ** 2).sum() + 2e-6)
        if old is not None and np.abs(old - beta).sum() < 1e-3:
            break
        old = beta
    beta = np.linalg.solve(x.T @ x + lam / alpha * np.eye(p), x.T @ y)
    return np.concatenate([[my - mx @ beta], beta])


def _plain(x, fit, max_rounds, tol=1e-3):
    miss = np.isnan(x)
    bound = tol * np.nanmax(np.abs(x))
    cur = np.where(miss, np.nanmean(x, 0), x)
    rounds = 0
    for rounds in range(1, max_rounds + 1):
        before = cur.copy()
        for c in sorted(np.where(miss.any(0))[0], key=lambda c: (miss[:, c].sum(), c)):
            rest = [i for i in range(x.shape[1]) if i != c]
            w = fit(cur[~miss[:, c]][:, rest], cur[~miss[:, c], c])
            cur[miss[:, c], c] = w[0] + cur[miss[:, c]][:, rest] @ w[1:]
        if np.abs(cur - before).max() < bound:
            break
    return cur, rounds


def _data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=(n, 2))
    x = f @ rng.normal(size=(2, 4)) + rng.normal(0, 0.4, (n, 4)) + [5, 0, -20, 100]
    x[rng.random((n, 4)) < [0.3, 0.1, 0.2, 0.05]] = np.nan
    return x


def _frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double")


@pytest.mark.parametrize("model,fit", [("linear", _ols), ("bayes", _bayes)])
@pytest.mark.parametrize("max_rounds,tol", [(1, 1e-3), (4, 0.0), (10, 1e-3), (50, 1e-6)])
def test_equals_the_definition(spark, model, fit, max_rounds, tol):
    x = _data()
    want, _ = _plain(x, fit, max_rounds, tol)
    got = chained.impute_linear(_frame(spark, x), ["a", "b", "c", "d"], model, max_rounds, tol).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], want, atol=1e-7)


def test_stops_in_the_same_round(spark):
    x = _data()
    want, rounds = _plain(x, _ols, 50, 1e-3)
    assert 1 < rounds < 50
    got = chained.impute_linear(_frame(spark, x), ["a", "b", "c", "d"], "linear", 50, 1e-3).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], want, atol=1e-7)


def test_many_patterns_take_scans(spark):
    x = _data(120)
    want, _ = _plain(x, _bayes, 3, 1e-3)
    got = chained.impute_linear(_frame(spark, x), ["a", "b", "c", "d"], "bayes", 3, max_cells=1).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], want, atol=1e-7)


def test_edge_cases(spark):
    schema = "id long, k string, z double, a double, e double"
    rows = [(1, "x", 1.0, None, None), (1, "x", 1.0, None, None), (2, None, float("nan"), 4.0, None), (3, "y", 3.0, 6.0, None)]
    got = chained.impute_linear(spark.createDataFrame(rows, schema), ["z", "a", "e"]).collect()
    assert len(got) == 4 and all(r["z"] is not None and r["a"] is not None and r["e"] is None for r in got)
    # columns named like the operator's own, one column, constant columns, no rows
    assert chained.impute_linear(spark.createDataFrame([], schema), ["z", "a"]).count() == 0
    assert [r["a"] for r in chained.impute_linear(spark.createDataFrame(rows, schema), ["a"]).collect()] == [5.0, 5.0, 4.0, 6.0]
    same = spark.createDataFrame([(1, 2.0), (1, None), (None, 2.0)], "r int, k double")
    assert all(r["r"] == 1.0 and r["k"] == 2.0 for r in chained.impute_linear(same).collect())


@pytest.mark.parametrize("query,cols,fit", [("na_regression_converged", ["value", "k"], _ols),
                                            ("na_bayes", ["value", "k", "minute", "log_value"], _bayes)])
def test_registered_queries(spark, query, cols, fit):
    from conftest import SF001
    from tessera.plans.all import QUERIES
    from tessera.plans.prep import events_features
    rows = events_features(spark, SF001).orderBy("event_id").collect()
    x = np.array([[np.nan if r[c] is None else float(r[c]) for c in cols] for r in rows])
    want, _ = _plain(x, fit, 10)
    got = QUERIES[query](spark, SF001).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [r["event_id"] for r in rows]
    assert np.allclose([[r["value"], r["k"]] for r in got], want[:, :2], atol=2e-6)
