import pytest
from pyspark.sql import functions as F

from tessera.operators import smoothing

X = [1.0, 2.0, 4.0, 8.0, 16.0]


def _series(spark, xs, sid=1):
    return spark.createDataFrame([(sid, i, x) for i, x in enumerate(xs)], "sid long, t long, x double")


def _vals(df):
    return [r["x_smoothed"] for r in df.orderBy("sid", "t").collect()]


def test_moving_average_fixture(spark):
    out = _vals(smoothing.moving_average(_series(spark, X), ["sid"], ["t"], ["x"], 3))
    assert out == pytest.approx([1, 1.5, 2.333333, 4.666667, 9.333333], abs=1e-6)


def test_ewm_fixture(spark):
    out = _vals(smoothing.ewm_mean(_series(spark, X), ["sid"], ["t"], ["x"], 3))
    assert out == pytest.approx([1, 1.666667, 3, 5.666667, 11], abs=1e-6)


def test_gaussian_fixture(spark):
    out = _vals(smoothing.gaussian_smooth(_series(spark, X), ["sid"], ["t"], ["x"], 3))
    assert out == pytest.approx([1.505199, 2.576114, 5.010017, 9.043373, 12.865296], abs=1e-6)


@pytest.mark.parametrize("op", ["moving_average", "ewm_mean", "gaussian_smooth"])
def test_blocked_equals_unblocked(spark, op):
    """Tiny blocks force halo copies across many block borders."""
    rows = [(s, t, float((t * 37 + s * 11) % 23)) for s in (1, 2, 3) for t in range(60 + 13 * s)]
    df = spark.createDataFrame(rows, "sid long, t long, x double")
    fn = getattr(smoothing, op)
    big = {(r.sid, r.t): r.x_smoothed for r in fn(df, ["sid"], ["t"], ["x"], 5).collect()}
    small = {(r.sid, r.t): r.x_smoothed for r in fn(df, ["sid"], ["t"], ["x"], 5, block_rows=16).collect()}
    assert big.keys() == small.keys() and len(big) == len(rows)
    for k in big:
        assert small[k] == pytest.approx(big[k], abs=1e-9)


def test_series_positions_skewed(spark):
    """One series holding most rows still gets 1..n positions."""
    rows = [(1, t) for t in range(500)] + [(2, t) for t in range(7)]
    df = spark.createDataFrame(rows, "sid long, t long")
    pos = smoothing.series_positions(df, ["sid"], ["t"], num_partitions=8)
    got = {(r.sid, r.t): (r._rn, r._n) for r in pos.collect()}
    assert all(got[(1, t)] == (t + 1, 500) for t in range(500))
    assert all(got[(2, t)] == (t + 1, 7) for t in range(7))


def test_lag_windows(spark):
    df = _series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0])
    out = smoothing.lag_windows(df, ["sid"], ["t"], "x", 2).orderBy("position").collect()
    assert [(r.position, r.history, r.target) for r in out] == [
        (6, [4.0, 5.0], 6.0), (7, [5.0, 6.0], 7.0)]


def test_series_change(spark):
    out = smoothing.series_change(_series(spark, X), ["sid"], "t", "x").first()
    assert (out.first_value, out.last_value, out.delta, out.pct_change) == (1.0, 16.0, 15.0, 1500.0)


def _lowess_ref(y, k, iterations):
    """Plain-python LOWESS on positions 0..n-1 (Cleveland's local linear
    fit, tricube weights, bisquare robustness) for cross-checking."""
    import numpy as np
    y = np.asarray(y, dtype=float)
    n = len(y)
    rw = np.ones(n)
    fit = y.copy()
    for it in range(iterations + 1):
        for i in range(n):
            left = min(max(i - k // 2, 0), max(n - k, 0))
            right = min(left + k, n)
            xs = np.arange(left, right, dtype=float)
            radius = max(i - left, right - 1 - i)
            d = np.abs(xs - i) / radius
            w = np.where(d < 1, (1 - d ** 3) ** 3, 0.0) * rw[left:right]
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            xb = (w * xs).sum() / w.sum()
            var = (w * xs * xs).sum() / w.sum() - xb * xb
            yb = (w * y[left:right]).sum() / w.sum()
            slope = ((w * xs * y[left:right]).sum() / w.sum() - xb * yb) / var if var > 1e-12 else 0.0
            fit[i] = yb + slope * (i - xb)
        if it == iterations:
            break
        res = y - fit
        s = np.median(np.abs(res))
        u = res / (6 * s) if s > 0 else np.where(res == 0, 0.0, np.inf)
        rw = np.where(np.abs(u) < 1, (1 - u ** 2) ** 2, 0.0)
    return fit


@pytest.mark.parametrize("iterations", [0, 3])
def test_loess_matches_reference(spark, iterations):
    ys = [float(((t * 37) % 23) + (50 if t == 17 else 0)) for t in range(40)]
    df = spark.createDataFrame([(1, t, y) for t, y in enumerate(ys)], "sid long, t long, x double")
    got = [r.x_smoothed for r in smoothing.loess(df, ["sid"], ["t"], "x", 5, iterations, block_rows=11)
           .orderBy("t").collect()]
    assert got == pytest.approx(list(_lowess_ref(ys, 5, iterations)), abs=1e-9)


def test_series_prefix_sum_skewed(spark):
    rows = [(1, t, t % 3) for t in range(400)] + [(2, t, 1) for t in range(5)]
    df = spark.createDataFrame(rows, "sid long, t long, v long")
    out = {(r.sid, r.t): r._cum for r in
           smoothing.series_prefix_sum(df, ["sid"], ["t"], F.col("v"), num_partitions=8).collect()}
    run = 0
    for t in range(400):
        run += t % 3
        assert out[(1, t)] == run
    assert [out[(2, t)] for t in range(5)] == [1, 2, 3, 4, 5]


def _plain_ewm(xs, span):
    """The definition, term by term; gaps repeat the last value."""
    decay, out, last = 1 - 2 / (span + 1), [], None
    for t, x in enumerate(xs):
        if x is not None and x == x:
            terms = [(decay ** (t - i), y) for i, y in enumerate(xs[:t + 1]) if y is not None and y == y]
            last = sum(w * y for w, y in terms) / sum(w for w, _ in terms)
        out.append(last)
    return out


@pytest.mark.parametrize("span,block", [(1, 100_000), (2, 100_000), (5, 7), (5, 100_000), (60, 16), (200, 50), (200, 100_000)])
def test_ewm_scan_equals_the_definition(spark, span, block):
    """Short and long spans, blocks shorter than the span's reach, gaps longer than a block."""
    import math
    import random
    rnd = random.Random(span)
    xs = [rnd.uniform(-50, 1e6) if rnd.random() < 0.7 else rnd.choice([None, math.nan]) for _ in range(260)]
    xs[100:180] = [None] * 80
    xs[:3] = [None, math.nan, 5.0]
    got = _vals(smoothing.ewm_mean(_series(spark, xs), ["sid"], ["t"], ["x"], span, block_rows=block))
    want = _plain_ewm(xs, span)
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-11)


def test_ewm_plan_does_not_grow_with_the_span(spark):
    df = _series(spark, [float(i) for i in range(50)])
    plans = [smoothing.ewm_mean(df, ["sid"], ["t"], ["x"], span)._jdf.queryExecution().optimizedPlan().toString() for span in (5, 200)]
    assert all("collect_list" not in p for p in plans)
    assert plans[0].count("Window") == plans[1].count("Window")
