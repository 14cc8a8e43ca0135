"""Huber regression on random Fourier features by Newton steps.

Minimises what Spark's ``LinearRegression(loss="huber")`` minimises without
standardisation, over coefficients w, intercept b and scale s > 0::

    mean(s + s H(r / s)) / 2 + reg / 2 |w|^2,   H(z) = z^2 if |z| <= 1.35 else 2.7 |z| - 1.35^2

A step is one pass over the stored points: the features of a batch are made from the
points where they are used, so no wide row is stored, and a task returns sums of the size of the
Hessian.  The loss is convex and quadratic between the rows that change sides, so few steps
reach the optimum where first-order iterations take hundreds.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

EPSILON = 1.35          # Spark's default
MAX_PASSES = 200        # an error beyond, no silent stop
ROWS_A_TASK = 25_000


def dealt(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows stored in even parts for many passes: a stored table of few
    blocks would leave most cores idle in each."""
    tasks = max(1, min(math.ceil(n / ROWS_A_TASK), 4 * df.sparkSession.sparkContext.defaultParallelism))
    return materialize(df.repartition(tasks), "points")


def fourier(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return math.sqrt(2.0 / len(b)) * np.cos(x @ w.T + b)


def _sums(points: DataFrame, w, b, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over the rows of loss, gradient and Hessian in ``theta`` = (coefficients, intercept, scale)."""
    m = len(b) + 2
    s = float(theta[-1])

    def part(batches):
        import pandas as pd
        loss, g, h = 0.0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for at in range(0, len(batch), 10_000):
                a = batch.iloc[at:at + 10_000].to_numpy(dtype=float)
                x = np.c_[fourier(a[:, :-1], w, b), np.ones(len(a))]
                r = a[:, -1] - x @ theta[:-1]
                near = np.abs(r) <= EPSILON * s
                far = r[~near]
                loss += len(a) * s + (r[near] @ r[near]) / s + (2 * EPSILON * np.abs(far) - EPSILON ** 2 * s).sum()
                g[:-1] -= 2 * (np.clip(r / s, -EPSILON, EPSILON) @ x)
                xi = np.c_[x[near], r[near] / s]                  # the Hessian of r^2 / s is 2 / s xi'xi
                h += xi.T @ xi
                g[-1] += len(a) - xi[:, -1] @ xi[:, -1] - EPSILON ** 2 * len(far)
        yield pd.DataFrame({"v": [np.concatenate([[loss], g, h.ravel()])]})

    parts = points.mapInPandas(part, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    v = np.zeros(1 + m + m * m)
    for i, x in parts.groupBy("i").agg(F.sum("v")).collect():
        v[i] = x
    return v[0], v[1:1 + m], 2 / s * v[1 + m:].reshape(m, m)


def fit(train: DataFrame, n: int, features: list[str], label: str, w: np.ndarray, b: np.ndarray, reg: float) -> np.ndarray:
    """``theta`` at the optimum; ``w`` and ``b``: the feature map, ``n``: rows of ``train``."""
    cols = [*features, label]
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols]
    first = train.agg(F.avg(F.col(label).cast("double")).alias("m"), F.stddev_pop(F.col(label).cast("double")).alias("s"),
                      *[F.count(F.when(x, 1)).alias(f"bad{i}") for i, x in enumerate(bad)]).first()
    if any(first[f"bad{i}"] for i in range(len(cols))):
        raise ValueError("null or NaN feature or label")
    theta = np.r_[np.zeros(len(b)), first["m"], first["s"]]
    if not first["s"]:
        return theta
    points = dealt(train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]), n)
    ridge = np.r_[np.full(len(b), 2 * reg), 0.0, 0.0]         # all is kept at twice the objective
    floor = 1e-9 * first["s"]

    def at(t):
        loss, g, h = _sums(points, w, b, t)
        return loss / n + 0.5 * (ridge * t) @ t, g / n + ridge * t, h / n + np.diag(ridge)

    loss, g, h = at(theta)
    passes = 1
    while theta[-1] > floor:
        d = -np.linalg.solve(h + np.diag(1e-13 * np.maximum(np.diag(h), np.diag(h).max() * 1e-3)), g)
        step = 1.0 if theta[-1] + d[-1] > 0.2 * theta[-1] else 0.8 * theta[-1] / -d[-1]
        if -(g @ d) <= 1e-12 * abs(loss):
            return theta + step * d
        while True:
            if passes >= MAX_PASSES:
                raise RuntimeError(f"Huber regression has not converged in {passes} passes")
            new = theta + step * d
            there = at(new)
            passes += 1
            if there[0] <= loss + 1e-4 * step * (g @ d) + 1e-13 * abs(loss):
                break
            step /= 2
        theta, (loss, g, h) = new, there
    return theta


def predict(test: DataFrame, features: list[str], theta: np.ndarray, w: np.ndarray, b: np.ndarray) -> DataFrame:
    import pandas as pd
    coef, const = theta[:-2], float(theta[-2])

    @F.pandas_udf("double")
    def value(x: pd.DataFrame) -> pd.Series:
        a = x.to_numpy(dtype=float)
        if np.isnan(a).any():
            raise ValueError("null or NaN feature")
        return pd.Series(np.concatenate([fourier(a[i:i + 10_000], w, b) @ coef + const for i in range(0, len(a), 10_000)] or [np.zeros(0)]))

    return test.withColumn("prediction", value(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))
