"""Forecast queries (T2-T7, W5 samples): per-user event value series,
min-max scaled per user, 10 lags, 5-step horizon."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import forecast as fc
from tessera.operators import series as ser
from tessera.operators import smoothing
from tessera.plans.registry import register
from tessera.sources.tables import load_table

LAGS = 10
HORIZON = 5


def _scaled(spark, sf):
    e = load_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return ser.minmax_scale(e, ["user_id"], ["value"])


def _samples(spark, sf):
    s = smoothing.lag_windows(_scaled(spark, sf), ["user_id"], ["ts", "event_id"], "value_scaled", LAGS)
    return fc.split_samples(s, ["user_id"])


@register("series_eligible", f"""
SELECT user_id, COUNT(*) AS n_rows,
       COUNT(*) >= 150 AND COUNT(*) - {LAGS} >= 10 AND COUNT(*) >= {LAGS + HORIZON} AS eligible
FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def series_eligible(spark, sf):
    e = load_table(spark, sf, "events")
    return ser.eligible_series(e, ["user_id"], ["value"], 150, LAGS, HORIZON)


@register("chrono_split", f"""
WITH w AS (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events),
s AS (SELECT user_id, position FROM w WHERE position > {LAGS}),
c AS (SELECT user_id, COUNT(*) AS n, MIN(position) AS p0 FROM s GROUP BY user_id)
SELECT s.user_id, s.position,
       CASE WHEN s.position - c.p0 + 1 <= floor(c.n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM s JOIN c ON s.user_id = c.user_id""")
def chrono_split(spark, sf):
    return _samples(spark, sf).select("user_id", "position", "split")


def _model(spark, sf):
    s = _samples(spark, sf)
    b, w = fc.fit_linear(s.where("split = 'train'"), LAGS)
    return s, b, w


@register("forecast_fit")
def forecast_fit(spark, sf):
    """Pooled lag regression: intercept and one weight per lag (lag 1 = newest)."""
    _, b, w = _model(spark, sf)
    rows = [(0, b)] + [(LAGS - i, x) for i, x in enumerate(w)]   # L + 1 fitted numbers
    return spark.createDataFrame(rows, "lag int, weight double")


@register("forecast_rolling")
def forecast_rolling(spark, sf):
    """One-step forecasts with the true history for the test samples."""
    s, b, w = _model(spark, sf)
    return fc.one_step(s.where("split = 'test'"), b, w).select("user_id", "position", "target", "prediction")


@register("forecast_quality")
def forecast_quality(spark, sf):
    s, b, w = _model(spark, sf)
    return fc.quality(fc.one_step(s.where("split = 'test'"), b, w), ["user_id"])


@register("forecast_recursive")
def forecast_recursive(spark, sf):
    """Recursive 5-step forecast from each user's last 10 values, with the
    next business days as dates."""
    s, b, w = _model(spark, sf)
    last = s.groupBy("user_id").agg(F.max_by(F.struct("history", "target"), "position").alias("l"))
    win = last.select("user_id", F.slice(F.concat("l.history", F.array("l.target")), 2, LAGS).alias("window"))
    out = fc.recursive(win, b, w, HORIZON)
    days = load_table(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last_day"))
    return fc.forecast_dates(out.join(days, "user_id"), "last_day", HORIZON).select(
        "user_id", "forecast", "dates")


@register("forecast_values")
def forecast_values(spark, sf):
    """Recursive 5-step forecasts in the unit of the series (scaling inverted), of
    the users with enough complete rows only."""
    scaled = forecast_recursive(spark, sf)
    e = load_table(spark, sf, "events")
    ok = ser.eligible_series(e, ["user_id"], ["value"], 150, LAGS, HORIZON).where("eligible").select("user_id")
    stats = ser.minmax_stats(e, ["user_id"], ["value"])
    got = ser.minmax_inverse(scaled.join(ok, "user_id", "left_semi"), ["user_id"], stats, "value", "forecast")
    return got.select("user_id", F.col("forecast_inv").alias("forecast"), "dates")
