"""Per-series forecasting on lag windows (the recurrent network is re-aimed
as a lag-feature regression).

Samples come from :func:`tessera.operators.smoothing.lag_windows`
(``series, position, history[L], target``).  A pooled linear model is fitted
on the training samples of all series (distributed normal equations); one-step
forecasts use the true history (teacher forcing, no loop); the recursive
h-step forecast feeds predictions back inside one Column ``aggregate`` with the
fitted coefficients as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import business_days_after
from tessera.operators.smoothing import series_positions

R2_WARNING = 0.85  # fixed value: quality bar under which a forecast is flagged


def split_samples(samples: DataFrame, series: list[str], train_fraction: float = 0.8) -> DataFrame:
    """Chronological split per series: first ``floor(fraction * n)`` samples
    train, the rest test (``n`` = samples of the series)."""
    ranked = series_positions(samples, series, ["position"])     # positions have gaps where nulls were
    return ranked.select(*samples.columns,
                         F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(train_fraction)), "train")
                         .otherwise("test").alias("split"))


def fit_linear(train: DataFrame, lags: int):
    """Least squares of ``target`` on the ``lags`` history values; returns
    ``(intercept, [w_1..w_L])`` (w_1 weighs the oldest value)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    data = train.select(array_to_vector("history").alias("features"), F.col("target").alias("label"))
    model = LinearRegression(solver="normal", regParam=0.0).fit(data)
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()][:lags]


def _dot(history, coef: list[float], intercept: float):
    terms = [F.element_at(history, i + 1) * F.lit(w) for i, w in enumerate(coef)]
    return sum(terms[1:], terms[0]) + F.lit(intercept)


def one_step(samples: DataFrame, intercept: float, coef: list[float]) -> DataFrame:
    """Teacher-forced one-step predictions for every sample."""
    return samples.withColumn("prediction", _dot(F.col("history"), coef, intercept))


def recursive(last_window: DataFrame, intercept: float, coef: list[float], horizon: int) -> DataFrame:
    """h-step forecasts feeding predictions back: the input has a ``window``
    array of the last L values per series; adds ``forecast`` (array of h)."""
    init = F.struct(F.col("window").alias("w"), F.array().cast("array<double>").alias("out"))

    def step(state, _):
        nxt = _dot(state["w"], coef, intercept)
        return F.struct(F.concat(F.slice(state["w"], 2, len(coef) - 1), F.array(nxt)).alias("w"),
                        F.concat(state["out"], F.array(nxt)).alias("out"))

    res = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)
    return last_window.withColumn("forecast", res["out"])


def quality(pred: DataFrame, series: list[str], label: str = "target",
            prediction: str = "prediction") -> DataFrame:
    """Per-series R^2 and MAE with the below-bar flag."""
    err = F.col(prediction) - F.col(label)
    g = pred.groupBy(*series).agg(F.avg(F.abs(err)).alias("mae"), F.sum(err * err).alias("_ss"),
                                  F.var_pop(label).alias("_v"), F.count(F.lit(1)).alias("_n"))
    r2 = F.when(F.col("_v") > 0, 1 - F.col("_ss") / (F.col("_v") * F.col("_n")))
    return g.select(*series, "mae", r2.alias("r2"),
                    F.coalesce(r2 < F.lit(R2_WARNING), F.lit(True)).alias("below_bar"))


def forecast_dates(last: DataFrame, date_col: str, horizon: int) -> DataFrame:
    return last.withColumn("dates", business_days_after(date_col, horizon))
