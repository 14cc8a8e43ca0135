"""Forecasting against numpy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forecast as fc
from tessera.operators import series as ser
from tessera.operators import smoothing
from tessera.plans import forecast as plans

SF = "/root/testdata/sf0.001"
LAGS = 4


def _data():
    rng = np.random.default_rng(6)
    out = {}
    for s, n in ((1, 60), (2, 45), (3, 9)):
        x = [0.3, 0.5, 0.2, 0.4]
        for _ in range(n - 4):
            x.append(0.1 + 0.5 * x[-1] - 0.3 * x[-2] + 0.2 * x[-4] + rng.normal(0, 0.05))
        out[s] = x
    return out


def _samples(spark, data):
    df = spark.createDataFrame([(s, t, float(v)) for s, x in data.items() for t, v in enumerate(x)], "s long, t long, x double")
    return fc.split_samples(smoothing.lag_windows(df, ["s"], ["t"], "x", LAGS), ["s"])


def _split(data):
    """``{series: (train, test)}`` of (history, target), the first 80 percent train."""
    out = {}
    for s, x in data.items():
        w = [(x[i - LAGS:i], x[i]) for i in range(LAGS, len(x))]
        cut = int(len(w) * 0.8)
        out[s] = w[:cut], w[cut:]
    return out


def _coefficients(data):
    train = [w for a, _ in _split(data).values() for w in a]
    A = np.array([[1.0, *h] for h, _ in train])
    got = np.linalg.lstsq(A, np.array([y for _, y in train]), rcond=None)[0]
    return got[0], got[1:]


def test_fit_one_step_and_quality(spark):
    data = _data()
    samples = _samples(spark, data).cache()
    b, w = fc.fit_linear(samples.where("split = 'train'"), LAGS)
    b0, w0 = _coefficients(data)
    assert b == pytest.approx(b0, abs=1e-8) and w == pytest.approx(list(w0), abs=1e-8)
    pred = fc.one_step(samples.where("split = 'test'"), b, w)
    got = {(r["s"], r["position"]): r["prediction"] for r in pred.collect()}
    want = {}
    for s, (train, test) in _split(data).items():
        for i, (h, _) in enumerate(test):
            want[s, LAGS + len(train) + i + 1] = b0 + float(np.dot(w0, h))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    quality = {r["s"]: r for r in fc.quality(pred, ["s"]).collect()}
    for s, (train, test) in _split(data).items():
        y, p = np.array([t for _, t in test]), np.array([b0 + float(np.dot(w0, h)) for h, _ in test])
        assert quality[s]["mae"] == pytest.approx(np.abs(y - p).mean())
        r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() if len(y) > 1 else None
        assert quality[s]["r2"] == (pytest.approx(r2) if r2 is not None else None)
        assert quality[s]["below_bar"] == (r2 is None or r2 < fc.R2_WARNING)


def test_recursive_equals_a_loop(spark):
    windows = {1: [0.1, 0.5, 0.2, 0.9], 2: [0.0, 0.0, 0.0, 1.0]}
    b, w = 0.05, [0.1, -0.2, 0.3, 0.7]
    got = fc.recursive(spark.createDataFrame(list(windows.items()), "s long, window array<double>"), b, w, 6)
    for r in got.collect():
        x = list(windows[r["s"]])
        for _ in range(6):
            x.append(b + sum(c * v for c, v in zip(w, x[-4:])))
        assert r["forecast"] == pytest.approx(x[4:])


def test_scaling_and_its_inverse(spark):
    rows = [(1, 3.0), (1, None), (1, 11.0), (1, 5.0), (2, 7.0), (2, 7.0)]
    df = spark.createDataFrame(rows, "s long, x double")
    scaled = ser.minmax_scale(df, ["s"], ["x"])
    assert sorted((r["s"], r["x_scaled"]) for r in scaled.where("x is not null").collect()) == [(1, 0.0), (1, 0.25), (1, 1.0), (2, 0.0), (2, 0.0)]
    assert scaled.where("x is null and x_scaled is null").count() == 1
    stats = ser.minmax_stats(df, ["s"], ["x"])
    back = ser.minmax_inverse(scaled, ["s"], stats, "x", "x_scaled").collect()
    assert all(r["x_scaled_inv"] == r["x"] for r in back)
    many = scaled.where("x is not null").groupBy("s").agg(F.array_sort(F.collect_list("x_scaled")).alias("f"))
    assert {r["s"]: r["f_inv"] for r in ser.minmax_inverse(many, ["s"], stats, "x", "f").collect()} == {1: [3.0, 5.0, 11.0], 2: [7.0, 7.0]}


def test_queries(spark):
    fit = {r["lag"]: r["weight"] for r in plans.forecast_fit(spark, SF).collect()}
    assert sorted(fit) == list(range(plans.LAGS + 1))
    values = plans.forecast_values(spark, "/root/testdata/sf0.01").collect()
    assert all(len(r["forecast"]) == plans.HORIZON == len(r["dates"]) for r in values)
    eligible = plans.series_eligible(spark, "/root/testdata/sf0.01").where("eligible").count()
    assert len(values) == eligible
