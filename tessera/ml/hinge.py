"""Support vector classification on random Fourier features by an interior point method.

Minimises what Spark's ``LinearSVC`` minimises without standardisation, over coefficients w
and intercept b::

    sum(max(0, r)) + lam / 2 |w|^2,   r = 1 - y (w x + b),  y = 1 or -1,  lam = n reg

The hinge has no curvature, so it is followed through smooth losses: its slack v >= 0,
v >= r gets a log barrier of weight mu, which leaves for each row, with q = sqrt(r^2 + 4 mu^2)::

    v - mu log(2 mu + q),   v = (r + 2 mu + q) / 2,   weight of the row a = mu / (v - r) in (0, 1)

At the optimum of the smooth loss the weights are feasible in the dual, so its hinge loss is within
sum(max(0, r) - a r) of the least; mu is lowered until that and the Newton step's gain are ``GAP`` of the loss.  A Newton step is two
passes over the stored points, one for the sums of gradient and Hessian and one for the length
of the step.  Features are made where they are used; a row has no state between passes.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.ml.huber import dealt, fourier

GAP = 1e-3              # of the loss: the usual stopping rule of a support vector machine
MAX_PASSES = 400        # an error beyond, no silent stop
SHRINK = 0.1            # of mu at most, once a Newton step gains less than smoothing costs
STEPS = np.r_[0.5 ** np.arange(-1, 14), 0.0]
BATCH = 512             # rows whose features are made at once, in buffers of the task
SINE = [(-1) ** j * (2 * math.pi) ** (2 * j + 1) / math.factorial(2 * j + 1) for j in range(11)]


def _cosines(z: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """cos(2 pi z) in place of ``z`` to 1e-14 by the series of the sine within a quarter turn: a
    third of the time of ``np.cos``, most of a pass.  ``p`` and ``q``: buffers of the same shape."""
    np.rint(z, out=p)
    z -= p
    np.abs(z, out=z)
    np.subtract(0.25, z, out=z)
    np.multiply(z, z, out=q)
    p[:] = SINE[-1]
    for a in SINE[-2::-1]:
        p *= q
        p += a
    z *= p


def _summed(points: DataFrame, size: int, w, b, sums) -> np.ndarray:
    """Sum over all rows of ``sums(features, labels, buffer)``, an array of ``size`` a batch;
    features are cosines without their factor, the last one is 1."""
    turn = np.vstack([np.c_[w.T, np.zeros(w.shape[1])], np.r_[b, 0.0]]) / (2 * math.pi)

    def part(batches):
        import pandas as pd
        total, (f, p, q) = np.zeros(size), np.empty((3, BATCH, turn.shape[1]))
        for batch in batches:
            a = batch.to_numpy(dtype=float)
            x, y = np.c_[a[:, :-1], np.ones(len(a))], a[:, -1]
            for at in range(0, len(a), BATCH):
                k = len(y[at:at + BATCH])
                np.matmul(x[at:at + k], turn, out=f[:k])
                _cosines(f[:k], p[:k], q[:k])
                total += sums(f[:k], y[at:at + k], p[:k])
        yield pd.DataFrame({"v": [total]})

    parts = points.mapInPandas(part, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    out = np.zeros(size)
    for i, v in parts.groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def _factors(b) -> np.ndarray:
    return np.r_[np.full(len(b), math.sqrt(2.0 / len(b))), 1.0]


def _newton(points: DataFrame, c: float, w, b, theta: np.ndarray, mu: float):
    """Sums over the rows of hinge loss, cost of smoothing, gradient and Hessian in ``theta``."""
    m, by = len(theta), _factors(b)
    upper, t = np.triu_indices(m), theta * by

    def sums(f, y, half):
        s = np.where(y == c, 1.0, -1.0)
        r = 1.0 - s * (f @ t)
        q = np.sqrt(r * r + 4 * mu * mu)
        far = q + np.abs(r)
        a = mu / np.where(r < 0, mu + far / 2, mu + 2 * mu * mu / far)      # q - |r| = 4 mu^2 / (q + |r|)
        bend = a * a / (2 * mu) * np.where(r < 0, far, 4 * mu * mu / far) / q
        hinge = np.maximum(r, 0)
        np.multiply(f, np.sqrt(bend)[:, None], out=half)
        return np.concatenate([[hinge.sum(), (hinge - a * r).sum()], -(a * s) @ f, (half.T @ half)[upper]])

    v = _summed(points, 2 + m + len(upper[0]), w, b, sums)
    h = np.zeros((m, m))
    h[upper] = v[2 + m:]
    return v[0], v[1], v[2:2 + m] * by, (h + np.triu(h, 1).T) * np.outer(by, by)


def _along(points: DataFrame, c: float, w, b, theta: np.ndarray, d: np.ndarray, mu: float) -> np.ndarray:
    """Sums of the smooth loss after each of ``STEPS`` along ``d``, up to a constant."""
    both = np.c_[theta, d] * _factors(b)[:, None]

    def sums(f, y, _):
        z = f @ both * np.where(y == c, -1.0, 1.0)[:, None]
        r = 1.0 + z[:, 0] + STEPS[:, None] * z[:, 1]
        q = np.sqrt(r * r + 4 * mu * mu)
        return (np.maximum(r, 0) + 2 * mu * mu / (q + np.abs(r)) - mu * np.log(2 + q / mu)).sum(1)

    return _summed(points, len(STEPS), w, b, sums)


def _one(points: DataFrame, c: float, w, b, lam: float) -> np.ndarray:
    """Coefficients and intercept of class ``c`` against the others."""
    theta, mu = np.zeros(len(b) + 1), 0.5
    ridge = np.r_[np.full(len(b), lam), 0.0]
    for _ in range(MAX_PASSES // 2):
        hinge, cost, g, h = _newton(points, c, w, b, theta, mu)
        loss, g, h = hinge + 0.5 * (ridge * theta) @ theta, g + ridge * theta, h + np.diag(ridge)
        d = -np.linalg.solve(h + 1e-14 * np.diag(np.diag(h)), g)
        gain = -(g @ d)
        if cost + gain <= GAP * loss:
            return theta
        if gain > cost:
            at = theta + STEPS[:, None] * d
            step = STEPS[np.argmin(_along(points, c, w, b, theta, d, mu) + 0.5 * (at * at) @ ridge)]
            if step:
                theta = theta + step * d
                continue
        mu *= min(0.5, max(SHRINK, 0.5 * GAP * loss / cost))
    raise RuntimeError(f"support vector machine has not converged in {MAX_PASSES} passes")


def fit(train: DataFrame, n: int, features: list[str], label: str, w: np.ndarray, b: np.ndarray, reg: float) -> np.ndarray:
    """Coefficients and intercept at the optimum: one row for two classes (labels 0 and 1),
    else one a class against all others.  ``w`` and ``b``: the feature map, ``n``: rows of ``train``."""
    y = F.col(label).cast("double")
    x = [F.col(f).cast("double") for f in features]
    odd = [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in [*x, y]]
    first = train.agg(*[F.count(F.when(o, 1)).alias(f"bad{i}") for i, o in enumerate(odd)],
                      F.count(F.when((y < 0) | (y != F.floor(y)), 1)).alias("bad_label")).first()
    if any(first):
        raise ValueError("null, NaN or infinite feature or label, or a label that is no class number")
    found = sorted(r[0] for r in train.select(y.alias("y")).distinct().collect())
    if len(found) <= 2 and not set(found) <= {0.0, 1.0}:
        raise ValueError(f"labels of two classes are 0 and 1, not {found}")
    points = dealt(train.select(*[v.alias(f"x{i}") for i, v in enumerate([*x, y])]), n)
    out = []
    for c in [1.0] if len(found) <= 2 else np.arange(found[-1] + 1):
        if c in found and len(found) > 1:
            out.append(_one(points, c, w, b, reg * n))
        else:                                                 # all rows or none: the intercept alone has no loss
            out.append(np.r_[np.zeros(len(b)), 1.0 if c in found else -1.0])
    return np.array(out)


def predict(test: DataFrame, features: list[str], theta: np.ndarray, w: np.ndarray, b: np.ndarray) -> DataFrame:
    import pandas as pd

    @F.pandas_udf("double")
    def value(x: pd.DataFrame) -> pd.Series:
        a = x.to_numpy(dtype=float)
        if not np.isfinite(a).all():
            raise ValueError("null, NaN or infinite feature")
        out = np.zeros(len(a))
        for at in range(0, len(a), BATCH):
            raw = fourier(a[at:at + BATCH], w, b) @ theta[:, :-1].T + theta[:, -1]
            out[at:at + BATCH] = raw.argmax(1) if len(theta) > 1 else raw[:, 0] > 0
        return pd.Series(out)

    return test.withColumn("prediction", value(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))
