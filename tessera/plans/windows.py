"""Ordered-window queries over per-user event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import smoothing
from tessera.plans.registry import register
from tessera.sources.tables import load_table

WINDOW = 5
LAGS = 10
SERIES = ["user_id"]
ORDER = ["ts", "event_id"]


def _events(spark, sf):
    return load_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


def _out(df):
    return df.select("event_id", "user_id", "value",
                     F.round("value_smoothed", 6).alias("value_smoothed"))


_RN_SQL = """
WITH e AS (SELECT event_id, user_id, ts, value,
                  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                  COUNT(*) OVER (PARTITION BY user_id) AS n
           FROM events)
"""


@register("smooth_ma", f"""
SELECT event_id, user_id, value,
       ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS value_smoothed
FROM events""")
def smooth_ma(spark, sf):
    return _out(smoothing.moving_average(_events(spark, sf), SERIES, ORDER, ["value"], WINDOW))


@register("smooth_ewm", _RN_SQL + f"""
SELECT a.event_id, a.user_id, a.value,
       ROUND(SUM(b.value * pow(1 - 2.0 / ({WINDOW} + 1), a.rn - b.rn))
             / SUM(pow(1 - 2.0 / ({WINDOW} + 1), a.rn - b.rn)), 6) AS value_smoothed
FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.value IS NOT NULL
GROUP BY a.event_id, a.user_id, a.value""")
def smooth_ewm(spark, sf):
    return _out(smoothing.ewm_mean(_events(spark, sf), SERIES, ORDER, ["value"], WINDOW))


LONG_SPAN = 200


@register("smooth_ewm_long", _RN_SQL + f"""
SELECT a.event_id, a.user_id, a.value,
       ROUND(SUM(b.value * pow(1 - 2.0 / ({LONG_SPAN} + 1), a.rn - b.rn))
             / SUM(pow(1 - 2.0 / ({LONG_SPAN} + 1), a.rn - b.rn)), 6) AS value_smoothed
FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.value IS NOT NULL
GROUP BY a.event_id, a.user_id, a.value""")
def smooth_ewm_long(spark, sf):
    """EWMA with a long span: same plan and cost a row as the short one."""
    return _out(smoothing.ewm_mean(_events(spark, sf), SERIES, ORDER, ["value"], LONG_SPAN))


def _gauss_sql() -> str:
    _, r = smoothing.gaussian_kernel(WINDOW)
    sigma = f"({WINDOW} / 3.0)"
    return _RN_SQL + f"""
, k AS (SELECT range AS j, exp(-0.5 * pow(range / {sigma}, 2)) AS w FROM range(-{r}, {r + 1})),
kn AS (SELECT j, w / (SELECT SUM(w) FROM k) AS w FROM k),
t AS (SELECT a.event_id, a.user_id, a.value, kn.w,
             CASE WHEN ((a.rn - 1 + kn.j) % (2 * a.n) + 2 * a.n) % (2 * a.n) >= a.n
                  THEN 2 * a.n - 1 - ((a.rn - 1 + kn.j) % (2 * a.n) + 2 * a.n) % (2 * a.n)
                  ELSE ((a.rn - 1 + kn.j) % (2 * a.n) + 2 * a.n) % (2 * a.n) END AS q
      FROM e a, kn)
SELECT t.event_id, t.user_id, t.value, ROUND(SUM(t.w * b.value), 6) AS value_smoothed
FROM t JOIN e b ON b.user_id = t.user_id AND b.rn = t.q + 1
GROUP BY t.event_id, t.user_id, t.value"""


@register("smooth_gauss", _gauss_sql())
def smooth_gauss(spark, sf):
    return _out(smoothing.gaussian_smooth(_events(spark, sf), SERIES, ORDER, ["value"], WINDOW))


@register("lag_windows", f"""
WITH w AS (
  SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
         LIST(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS BETWEEN {LAGS} PRECEDING AND 1 PRECEDING) AS history,
         value AS target
  FROM events)
SELECT user_id, position, history, target FROM w
WHERE len(history) = {LAGS} AND target IS NOT NULL""")
def lag_windows(spark, sf):
    return smoothing.lag_windows(_events(spark, sf), SERIES, ORDER, "value", LAGS)


@register("series_change", """
SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value,
       ROUND(arg_max(value, ts) - arg_min(value, ts), 6) AS delta,
       ROUND((arg_max(value, ts) - arg_min(value, ts)) / NULLIF(arg_min(value, ts), 0) * 100, 6) AS pct_change
FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def series_change(spark, sf):
    out = smoothing.series_change(_events(spark, sf), SERIES, "ts", "value")
    return out.select("user_id", "first_value", "last_value", F.round("delta", 6).alias("delta"),
                      F.round("pct_change", 6).alias("pct_change"))


_LOESS_K = WINDOW

_LOESS_SQL = f"""
, b AS (SELECT e.*, least(greatest(rn - {_LOESS_K // 2}, 1), greatest(n - {_LOESS_K} + 1, 1)) AS lft FROM e),
w AS (SELECT a.event_id, a.user_id, a.value, a.rn, y.rn AS xj, y.value AS yj,
             CAST(greatest(a.rn - a.lft, least(a.lft + {_LOESS_K} - 1, a.n) - a.rn) AS DOUBLE) AS radius
      FROM b a JOIN e y ON y.user_id = a.user_id AND y.rn BETWEEN a.lft AND least(a.lft + {_LOESS_K} - 1, a.n)),
t AS (SELECT *, CASE WHEN abs(xj - rn) < radius THEN pow(1 - pow(abs(xj - rn) / radius, 3), 3) ELSE 0 END AS wt
      FROM w),
s AS (SELECT event_id, user_id, value, rn, SUM(wt) AS sw, SUM(wt * xj) AS sx, SUM(wt * yj) AS sy,
             SUM(wt * xj * xj) AS sxx, SUM(wt * xj * yj) AS sxy FROM t GROUP BY event_id, user_id, value, rn),
f AS (SELECT *, sx / sw AS xbar, sxx / sw - (sx / sw) * (sx / sw) AS var FROM s)
SELECT event_id, user_id, value,
       ROUND(CASE WHEN sw > 0 THEN sy / sw + (CASE WHEN var > 1e-12 THEN (sxy / sw - xbar * (sy / sw)) / var
                                                   ELSE 0 END) * (rn - xbar)
                  ELSE value END, 6) AS value_smoothed
FROM f"""


@register("smooth_loess_pass1", _RN_SQL + _LOESS_SQL)
def smooth_loess_pass1(spark, sf):
    """First (non-robust) LOWESS pass over the 5 nearest positions."""
    return _out(smoothing.loess(_events(spark, sf), SERIES, ORDER, "value", WINDOW, iterations=0))


@register("smooth_loess")
def smooth_loess(spark, sf):
    """LOWESS with 3 bisquare robustness passes."""
    return _out(smoothing.loess(_events(spark, sf), SERIES, ORDER, "value", WINDOW, iterations=3))


# ---------------------------------------------------------------- series with nulls
# every seventh value is missing, and every tenth user's from the fourth day of the month on
def _gappy_events(spark, sf):
    e = _events(spark, sf)
    gap = (F.col("event_id") % 7 == 3) | ((F.col("user_id") % 10 == 0) & (F.dayofmonth("ts") >= 4))
    return e.withColumn("value", F.when(~gap, F.col("value")))


_GAPPY_SQL = """
WITH g AS (SELECT event_id, user_id, ts,
                  CASE WHEN event_id % 7 = 3 OR (user_id % 10 = 0 AND day(ts) >= 4) THEN NULL ELSE value END AS value
           FROM events),
"""
_NUMBERED = """e AS (SELECT event_id, user_id, ts, value,
                  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                  COUNT(*) OVER (PARTITION BY user_id) AS n FROM g {where})
"""


@register("smooth_ewm_nulls", _GAPPY_SQL + _NUMBERED.format(where="") + f"""
SELECT a.event_id, a.user_id, a.value,
       ROUND(SUM(b.value * pow(1 - 2.0 / ({WINDOW} + 1), a.rn - b.rn))
             / SUM(pow(1 - 2.0 / ({WINDOW} + 1), a.rn - b.rn)), 6) AS value_smoothed
FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.rn <= a.rn AND b.value IS NOT NULL
GROUP BY a.event_id, a.user_id, a.value""")
def smooth_ewm_nulls(spark, sf):
    """EWMA over series with gaps: a null row repeats the last value."""
    return _out(smoothing.ewm_mean(_gappy_events(spark, sf), SERIES, ORDER, ["value"], WINDOW))


@register("smooth_gauss_nulls", _GAPPY_SQL + _NUMBERED.format(where="")
          + _gauss_sql().split("FROM events)\n", 1)[1].replace(
              "ROUND(SUM(t.w * b.value), 6)", "CASE WHEN COUNT(b.value) = COUNT(*) THEN ROUND(SUM(t.w * b.value), 6) END"))
def smooth_gauss_nulls(spark, sf):
    """Gaussian filter over series with gaps: NULL where the window holds one."""
    return _out(smoothing.gaussian_smooth(_gappy_events(spark, sf), SERIES, ORDER, ["value"], WINDOW))


@register("smooth_loess_nulls", _GAPPY_SQL + f"""
a0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM g),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY x) AS rn, COUNT(*) OVER (PARTITION BY user_id) AS n
      FROM a0 WHERE value IS NOT NULL),
l AS (SELECT a.event_id, MIN(c.rn) AS lft
      FROM e a JOIN e c ON c.user_id = a.user_id AND c.rn BETWEEN a.rn - {_LOESS_K} + 1 AND a.rn
      LEFT JOIN e d ON d.user_id = c.user_id AND d.rn = c.rn + {_LOESS_K}
      WHERE d.rn IS NULL OR a.x <= (c.x + d.x) / 2.0 GROUP BY a.event_id),
w AS (SELECT a.event_id, a.user_id, a.value, a.x, y.x AS xj, y.value AS yj,
             MAX(abs(y.x - a.x)) OVER (PARTITION BY a.event_id) AS radius
      FROM e a JOIN l USING (event_id)
      JOIN e y ON y.user_id = a.user_id AND y.rn BETWEEN l.lft AND l.lft + {_LOESS_K} - 1),
t AS (SELECT *, CASE WHEN abs(xj - x) < radius THEN pow(1 - pow(abs(xj - x) / radius, 3), 3) ELSE 0 END AS wt FROM w),
s AS (SELECT event_id, user_id, value, x, SUM(wt) AS sw, SUM(wt * xj) AS sx, SUM(wt * yj) AS sy,
             SUM(wt * xj * xj) AS sxx, SUM(wt * xj * yj) AS sxy FROM t GROUP BY event_id, user_id, value, x),
f AS (SELECT *, sx / sw AS xbar, sxx / sw - (sx / sw) * (sx / sw) AS var FROM s)
SELECT event_id, user_id, value,
       ROUND(CASE WHEN sw > 0 THEN sy / sw + (CASE WHEN var > 1e-12 THEN (sxy / sw - xbar * (sy / sw)) / var
                                                   ELSE 0 END) * (x - xbar)
                  ELSE value END, 6) AS value_smoothed
FROM f""")
def smooth_loess_nulls(spark, sf):
    """First LOWESS pass over series with gaps: null rows are dropped, the
    others keep their place."""
    return _out(smoothing.loess(_gappy_events(spark, sf), SERIES, ORDER, "value", WINDOW, iterations=0))
