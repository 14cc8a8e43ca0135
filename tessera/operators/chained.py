"""Chained-equation imputation from moments: rounds without scans.

Every imputed cell starts as the column's mean and is replaced by a linear
prediction from the row's other cells.  So at any time the cells of a row are
affine in its observed cells, with one map for all rows of the same missing
pattern.  The moments of the observed cells by pattern (one scan) therefore hold
all that the fits of all rounds need: rounds are algebra on small matrices.
A second scan finds the largest change of each round (the stopping rule), and
the last one writes the predictions.

With more patterns than ``MAX_CELLS`` allows, every fit sums its moments over
the current table instead, and lineage is cut after each round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import nan_to_null, numeric_columns, require_columns
from tessera.session import materialize

MAX_CELLS = 1_000_000     # numbers of all patterns' matrices and maps of one round held on the driver


def least_squares(g: np.ndarray, y: int, others: list[int]) -> np.ndarray:
    """``[intercept, coefficients]`` by least squares from the moment matrix of
    ``[1, columns]``; directions without variance get no weight."""
    n, mx, my, xx, xy, _ = _centred(g, y, others)
    if n == 0:
        return np.zeros(len(others) + 1)
    size = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    beta = np.linalg.pinv(xx / size[:, None] / size[None], rcond=1e-12, hermitian=True) @ (xy / size) / size
    return np.concatenate([[my - mx @ beta], beta])


def bayesian_ridge(g: np.ndarray, y: int, others: list[int], max_iter: int = 300, tol: float = 1e-3) -> np.ndarray:
    """``[intercept, coefficients]`` of Bayesian ridge regression: the precisions of noise
    and weights maximise the evidence (gamma priors of 1e-6), all from the moment matrix."""
    n, mx, my, xx, xy, yy = _centred(g, y, others)
    if n == 0:
        return np.zeros(len(others) + 1)
    prior = 1e-6                                              # fixed value: both parameters of both priors
    val, vec = np.linalg.eigh(xx)
    val, q = np.maximum(val, 0.0), vec.T @ xy
    alpha, lam, old = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None

    def weights():
        return vec @ (q / (val + lam / alpha))

    for _ in range(max_iter):
        beta = weights()
        rss = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        gamma = float(np.sum(alpha * val / (lam + alpha * val)))
        lam = (gamma + 2 * prior) / (beta @ beta + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (rss + 2 * prior)
        if old is not None and np.abs(old - beta).sum() < tol:
            break
        old = beta
    beta = weights()
    return np.concatenate([[my - mx @ beta], beta])


def _centred(g, y, others):
    n = g[0, 0]
    o = [i + 1 for i in others]
    mx, my = (g[0, o] / n, g[0, y + 1] / n) if n else (np.zeros(len(o)), 0.0)
    return (n, mx, my, g[np.ix_(o, o)] - n * np.outer(mx, mx), g[o, y + 1] - n * mx * my,
            max(g[y + 1, y + 1] - n * my * my, 0.0))


MODELS = {"linear": least_squares, "bayes": bayesian_ridge}


def _moments(p: int) -> list[Column]:
    z = [F.lit(1.0), *[F.col("z")[i] for i in range(p)]]
    return [F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]


def _matrix(row, p: int) -> np.ndarray:
    g = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            g[i, j] = g[j, i] = row[f"m{i}_{j}"] or 0.0
    return g


def _dot(coef: Column) -> Column:
    """Value of an affine map ``[constant, coefficients]`` at the cells ``z``."""
    return F.aggregate(F.zip_with(coef, F.concat(F.array(F.lit(1.0)), "z"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _rounds(grams: dict[str, np.ndarray], order: list[int], p: int, fit, max_rounds: int) -> list[dict[str, np.ndarray]]:
    """Affine maps by pattern: at the start, then after each round."""
    maps = {k: np.diag([1.0] + [0.0 if f == "1" else 1.0 for f in k]) for k in grams}
    out = [{k: b.copy() for k, b in maps.items()}]
    for _ in range(max_rounds):
        for c in order:
            others = [i for i in range(p) if i != c]
            total = reduce(np.add, [maps[k] @ g @ maps[k].T for k, g in grams.items() if k[c] == "0"], np.zeros((p + 1, p + 1)))
            w = fit(total, c, others)
            for k, b in maps.items():
                if k[c] == "1":
                    b[c + 1] = w[0] * b[0] + w[1:] @ b[[i + 1 for i in others]]
        out.append({k: b.copy() for k, b in maps.items()})
    return out


def impute_linear(df: DataFrame, columns: list[str] | None = None, model: str = "linear", max_rounds: int = 10,
                  tol: float = 1e-3, max_cells: int = MAX_CELLS) -> DataFrame:
    """Impute the numeric columns with nulls (or ``columns``) by chained regressions.

    Start: means.  A round takes the columns by ascending number of nulls; a
    column's model (``linear`` least squares, ``bayes`` Bayesian ridge) is fitted on
    the rows where it was observed, with the other columns' current values.  Rounds
    end after ``max_rounds`` or once no cell moves by ``tol * max|observed value|``.

    NaN counts as missing.  Imputed columns become double, other columns and repeated
    rows stay as they are.  A column without any value stays null and predicts
    nothing; a single column gets its mean; an empty table comes back empty."""
    fit = MODELS[model]
    cols = columns if columns is not None else numeric_columns(df)
    require_columns(df, cols)
    df = nan_to_null(df, cols)
    if not cols:
        return df
    stats = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                   *[F.max(F.abs(F.col(c).cast("double"))).alias(f"x{i}") for i, c in enumerate(cols)]).first()
    used = [i for i in range(len(cols)) if stats[f"a{i}"] is not None and (columns is not None or stats[f"n{i}"])]
    if not used:
        return df
    cols, mean = [cols[i] for i in used], [stats[f"a{i}"] for i in used]
    order = sorted((j for j, i in enumerate(used) if stats[f"n{i}"]), key=lambda j: (stats[f"n{used[j]}"], j))
    scale, p = max(stats[f"x{i}"] for i in used), len(cols)
    value = [F.col(c).cast("double") for c in cols]
    base = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("r"),
                     F.array(*[F.coalesce(v - F.lit(m), F.lit(0.0)) for v, m in zip(value, mean)]).alias("z"),
                     F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in value]).alias("k"))

    def finish(cells: list[Column], frame: DataFrame) -> DataFrame:
        at = {c: i for i, c in enumerate(cols)}
        return frame.select(*[(F.coalesce(F.col("r")[c].cast("double"), cells[at[c]] + F.lit(mean[at[c]])) if c in at else F.col("r")[c]).alias(c)
                              for c in df.columns])

    if p == 1 or not order:
        return finish([F.lit(0.0)] * p, base)
    limit = max(1, max_cells // (p + 1) ** 2)
    rows = base.groupBy("k").agg(*_moments(p)).limit(limit + 1).collect()
    if len(rows) > limit:
        return _by_scans(base, order, p, fit, max_rounds, tol * scale, finish)
    grams = {r["k"]: _matrix(r, p) for r in rows}
    maps = _rounds(grams, order, p, fit, max_rounds)
    moving = [k for k in grams if "1" in k]
    schema = "k string, d array<array<array<double>>>"
    # one row a pattern, bounded by max_cells a round: broadcast
    steps = [(k, [[(b[k] - a[k])[i + 1].tolist() for i in range(p) if k[i] == "1"] for a, b in zip(maps, maps[1:])]) for k in moving]
    steps = F.broadcast(df.sparkSession.createDataFrame(steps, schema))
    moved = base.join(steps, "k").agg(
        *[F.max(F.array_max(F.transform(F.col("d")[r], lambda c: F.abs(_dot(c))))).alias(f"r{r}") for r in range(max_rounds)]).first()
    last = next((r for r in range(max_rounds) if moved[f"r{r}"] < tol * scale), max_rounds - 1)
    final = F.broadcast(df.sparkSession.createDataFrame([(k, [maps[last + 1][k][1:].tolist()]) for k in moving], schema))
    return finish([_dot(F.col("d")[0][i]) for i in range(p)], base.join(final, "k", "left"))


def _by_scans(base: DataFrame, order: list[int], p: int, fit, max_rounds: int, least: float, finish) -> DataFrame:
    """The same rounds with the moments of every fit summed over the current cells."""
    cur = base
    for _ in range(max_rounds):
        cur = cur.withColumn("before", F.col("z"))
        for c in order:
            others = [i for i in range(p) if i != c]
            w = fit(_matrix(cur.where(F.substring("k", c + 1, 1) == "0").agg(*_moments(p)).first(), p), c, others)
            guess = sum((F.lit(float(b)) * F.col("z")[i] for b, i in zip(w[1:], others)), F.lit(float(w[0])))
            missing = F.substring("k", c + 1, 1) == "1"
            cur = cur.withColumn("z", F.array(*[F.when(missing, guess).otherwise(F.col("z")[i]) if i == c else F.col("z")[i] for i in range(p)]))
        cur = materialize(cur, "chained-round")
        moved = cur.agg(F.max(F.array_max(F.zip_with("z", "before", lambda a, b: F.abs(a - b))))).first()[0]
        cur = cur.drop("before")
        if moved is None or moved < least:
            break
    return finish([F.col("z")[i] for i in range(p)], cur)
