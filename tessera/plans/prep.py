"""Preprocessing queries: profile (P1, P2, P7, P8), missing values (M1-M7),
outliers (O1-O8), variance / correlation / feature selection (V1-V6).

Input: ``events`` with nulls derived from the data itself (no row is
dropped): ``value`` is missing for error events, ``k`` in the first hour of a
day, ``event_type`` when the value exceeds 300.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import missing, outliers, profile, variance
from tessera.plans.registry import register
from tessera.sources.tables import load_table

FEATURES = ["value", "k", "minute", "log_value"]


def events_features(spark, sf) -> DataFrame:
    e = load_table(spark, sf, "events")
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(minute < 60, F.lit(None)).otherwise(k).alias("k"),
        minute.alias("minute"),
        F.round(F.log(F.col("value") + 1.0), 6).alias("log_value"),
        F.when(F.col("value") > 300, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"))


EF_SQL = """
WITH ef AS (
  SELECT event_id, user_id,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
         CASE WHEN CAST(hour(ts) * 60 + minute(ts) AS INTEGER) < 60 THEN NULL
              ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
         CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute,
         ROUND(ln(value + 1.0), 6) AS log_value,
         CASE WHEN value > 300 THEN NULL ELSE event_type END AS event_type
  FROM events)
"""


def _r(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------------ profile
_PROFILE_COLS = [("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"),
                 ("k", "int"), ("minute", "int"), ("log_value", "double"),
                 ("event_type", "string")]


def _profile_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(_PROFILE_COLS):
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if t == "double" else "")
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS column_type, "
            f"COUNT(*) FILTER (WHERE {miss}) AS n_missing, COUNT(DISTINCT {c}) AS n_unique, "
            f"arg_min(COALESCE(CAST({c} AS VARCHAR), 'nan'), event_id) AS example FROM ef")
    return EF_SQL + "\nUNION ALL\n".join(parts)


@register("profile_columns", _profile_sql())
def profile_columns(spark, sf):
    p = profile.column_profile(events_features(spark, sf), order_key="event_id")
    return p.select("position", F.col("column").alias("column_name"),
                    F.col("type").alias("column_type"), F.col("missing").alias("n_missing"),
                    F.col("unique").alias("n_unique"), "example")


@register("profile_totals", EF_SQL + """
SELECT COUNT(*) AS n_rows, 7 AS n_columns,
       CAST(SUM((event_id IS NULL)::INT + (user_id IS NULL)::INT + (value IS NULL)::INT + (k IS NULL)::INT
           + (minute IS NULL)::INT + (log_value IS NULL)::INT + (event_type IS NULL)::INT) AS BIGINT) AS missing_cells,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM ef)) AS duplicate_rows
FROM ef""")
def profile_totals(spark, sf):
    return profile.dataset_totals(events_features(spark, sf))


@register("profile_totals_types", EF_SQL + """
SELECT COUNT(*) AS n_rows, 3 AS n_columns, CAST(SUM((event_type IS NULL)::INT) AS BIGINT) AS missing_cells,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT user_id, event_type, minute FROM ef)) AS duplicate_rows
FROM ef""")
def profile_totals_types(spark, sf):
    """Totals of a projection that has real duplicate rows."""
    return profile.dataset_totals(events_features(spark, sf).select("user_id", "event_type", "minute"))


@register("preview", EF_SQL + "SELECT * FROM ef ORDER BY event_id LIMIT 5")
def preview(spark, sf):
    return events_features(spark, sf).orderBy("event_id").limit(5)


SAMPLE_N = 1000
SAMPLE_SEED = 42


def sample_order(key: str, seed: int = SAMPLE_SEED):
    """A deterministic pseudo-random order: md5 of key and seed (same in SQL)."""
    return (F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(key))


@register("sample_n", EF_SQL + f"""
SELECT * FROM ef ORDER BY md5(CAST(event_id AS VARCHAR) || ':{SAMPLE_SEED}'), event_id LIMIT {SAMPLE_N}""")
def sample_n(spark, sf):
    """Exactly n rows in a seeded pseudo-random order (distributed top-n)."""
    return events_features(spark, sf).orderBy(*sample_order("event_id")).limit(SAMPLE_N)


# ------------------------------------------------------------------ missing values
@register("na_drop", EF_SQL + """
SELECT * FROM ef WHERE value IS NOT NULL AND k IS NOT NULL AND event_type IS NOT NULL""")
def na_drop(spark, sf):
    return missing.drop_missing(events_features(spark, sf))


def _fill_query(spark, sf, strategy):
    df, _ = missing.fill_statistic(events_features(spark, sf), strategy, ["value", "k"])
    return _r(df, ["value", "k"])


_FILL_SELECT = """
SELECT event_id, user_id, ROUND(COALESCE(value, {v}), 6) AS value,
       ROUND(COALESCE(CAST(k AS DOUBLE), {k}), 6) AS k, minute, log_value, event_type FROM ef"""


@register("na_mean", EF_SQL + _FILL_SELECT.format(
    v="(SELECT AVG(value) FROM ef)", k="(SELECT AVG(k) FROM ef)"))
def na_mean(spark, sf):
    return _fill_query(spark, sf, "mean")


@register("na_median", EF_SQL + _FILL_SELECT.format(
    v="(SELECT quantile_cont(value, 0.5) FROM ef)", k="(SELECT quantile_cont(k, 0.5) FROM ef)"))
def na_median(spark, sf):
    return _fill_query(spark, sf, "median")


# adaptive rule: discrete (distinct / non-null < 0.15 at >= 1000 rows) -> mode, else median
def _adaptive(c: str) -> str:
    return (f"(SELECT CASE WHEN COUNT(DISTINCT {c}) / COUNT({c}) < "
            f"(CASE WHEN COUNT(*) < 100 THEN 0.05 WHEN COUNT(*) < 1000 THEN 0.10 ELSE 0.15 END) "
            f"THEN (SELECT {c} FROM ef WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) "
            f"ELSE quantile_cont({c}, 0.5) END FROM ef)")


@register("na_mode_adaptive", EF_SQL + _FILL_SELECT.format(v=_adaptive("value"), k=_adaptive("k")))
def na_mode_adaptive(spark, sf):
    return _fill_query(spark, sf, "mode")


@register("na_mode_cat", EF_SQL + """
SELECT event_id, user_id, value, k, minute, log_value,
       COALESCE(event_type, (SELECT COALESCE((SELECT event_type FROM ef WHERE event_type IS NOT NULL
                GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 1), ''))) AS event_type
FROM ef""")
def na_mode_cat(spark, sf):
    df, _ = missing.fill_categorical_mode(events_features(spark, sf), ["event_type"])
    return df


@register("na_regression", EF_SQL + """
, s0 AS (SELECT *, k IS NULL AS mk, value IS NULL AS mv,
         COALESCE(CAST(k AS DOUBLE), (SELECT AVG(k) FROM ef)) AS k0,
         COALESCE(value, (SELECT AVG(value) FROM ef)) AS v0 FROM ef),
fk AS (SELECT regr_slope(k0, v0) AS b, regr_intercept(k0, v0) AS a FROM s0 WHERE NOT mk),
s1 AS (SELECT s0.*, CASE WHEN mk THEN fk.a + fk.b * v0 ELSE k0 END AS k1 FROM s0, fk),
fv AS (SELECT regr_slope(v0, k1) AS b, regr_intercept(v0, k1) AS a FROM s1 WHERE NOT mv),
s2 AS (SELECT s1.*, CASE WHEN mv THEN fv.a + fv.b * k1 ELSE v0 END AS v1 FROM s1, fv)
SELECT event_id, user_id, ROUND(v1, 6) AS value, ROUND(k1, 6) AS k, minute, log_value, event_type
FROM s2""")
def na_regression(spark, sf):
    """One round of chained linear imputation between ``value`` and ``k``
    (k has fewer nulls, so it is imputed first)."""
    df = missing.impute_chained(events_features(spark, sf), ["value", "k"], "linear", max_rounds=1)
    return _r(df, ["value", "k"])


@register("na_regression_converged")
def na_regression_converged(spark, sf):
    df = missing.impute_chained(events_features(spark, sf), ["value", "k"], "linear", max_rounds=10)
    return _r(df, ["value", "k"])


@register("na_bayes")
def na_bayes(spark, sf):
    """Chained Bayesian ridge imputation of every numeric column with nulls, 10 rounds at most;
    ``minute`` and ``log_value`` take part as complete columns."""
    df = missing.impute_chained(events_features(spark, sf), ["value", "k", "minute", "log_value"], "bayes", max_rounds=10)
    return _r(df, ["value", "k"])


@register("na_tree")
def na_tree(spark, sf):
    df = missing.impute_chained(events_features(spark, sf), ["value", "k"], "tree", max_rounds=10)
    return _r(df, ["value", "k"])


# ------------------------------------------------------------------ outliers
OUT_COLS = ["value", "log_value"]


def _bounds_table(spark, sf, method, **params):
    df = events_features(spark, sf)
    rows = []
    thr = params.get("threshold", 3.0)
    for c in OUT_COLS:
        b = outliers.bounds(df, c, method, **params)
        rows.append((c, b, outliers.is_outlier(c, b, thr)))
    agg = df.agg(*[F.count_if(f).alias(f"n{i}") for i, (_, _, f) in enumerate(rows)])
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.round(F.lit(b.lower).cast("double"), 6).alias("lower"),
                        F.round(F.lit(b.upper).cast("double"), 6).alias("upper"),
                        F.col(f"n{i}").alias("n_outliers"))
               for i, (c, b, _) in enumerate(rows)]
    return agg.select(F.inline(F.array(*structs)))


def _bounds_sql(lower: str, upper: str, test: str) -> str:
    parts = []
    for c in OUT_COLS:
        lo, hi, t = (x.replace("{c}", c) for x in (lower, upper, test))
        parts.append(f"SELECT '{c}' AS column_name, ROUND({lo}, 6) AS lower, ROUND({hi}, 6) AS upper, "
                     f"(SELECT COUNT(*) FROM ef WHERE {t}) AS n_outliers FROM ef LIMIT 1")
    return EF_SQL + "\nUNION ALL\n".join(f"({p})" for p in parts)


_Q1 = "(SELECT quantile_cont({c}, 0.25) FROM ef)"
_Q3 = "(SELECT quantile_cont({c}, 0.75) FROM ef)"
_IQR_LO = f"({_Q1} - 1.5 * ({_Q3} - {_Q1}))"
_IQR_HI = f"({_Q3} + 1.5 * ({_Q3} - {_Q1}))"


@register("outlier_iqr", _bounds_sql(_IQR_LO, _IQR_HI, f"{{c}} < {_IQR_LO} OR {{c}} > {_IQR_HI}"))
def outlier_iqr(spark, sf):
    return _bounds_table(spark, sf, "iqr", k=1.5)


_MEAN = "(SELECT AVG({c}) FROM ef)"
_STD = "(SELECT STDDEV_SAMP({c}) FROM ef)"


@register("outlier_z", _bounds_sql(f"({_MEAN} - 3 * {_STD})", f"({_MEAN} + 3 * {_STD})",
                                   f"abs(({{c}} - {_MEAN}) / {_STD}) > 3"))
def outlier_z(spark, sf):
    return _bounds_table(spark, sf, "zscore", threshold=3.0)


_MED = "(SELECT quantile_cont({c}, 0.5) FROM ef)"
_MAD = "(SELECT quantile_cont(abs({c} - " + _MED + "), 0.5) FROM ef)"


@register("outlier_mad", _bounds_sql(f"({_MED} - 3 * {_MAD} / 0.6745)", f"({_MED} + 3 * {_MAD} / 0.6745)",
                                     f"abs(0.6745 * ({{c}} - {_MED}) / {_MAD}) > 3"))
def outlier_mad(spark, sf):
    return _bounds_table(spark, sf, "modified_zscore", threshold=3.0)


_P1 = "(SELECT quantile_cont({c}, 0.01) FROM ef)"
_P99 = "(SELECT quantile_cont({c}, 0.99) FROM ef)"


@register("outlier_pct", _bounds_sql(_P1, _P99, f"{{c}} < {_P1} OR {{c}} > {_P99}"))
def outlier_pct(spark, sf):
    return _bounds_table(spark, sf, "percentile", lower_pct=1.0, upper_pct=99.0)


def _treated(spark, sf, method, treatment, **params):
    df = events_features(spark, sf).select("event_id", *OUT_COLS)
    out, _ = outliers.treat(df, OUT_COLS, method, treatment, **params)
    return _r(out, OUT_COLS)


@register("outlier_remove", EF_SQL + """
, b1 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ef),
r1 AS (SELECT ef.* FROM ef, b1
       WHERE NOT COALESCE(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE)),
b2 AS (SELECT quantile_cont(log_value, 0.25) AS q1, quantile_cont(log_value, 0.75) AS q3 FROM r1),
r2 AS (SELECT r1.* FROM r1, b2
       WHERE NOT COALESCE(log_value < q1 - 1.5 * (q3 - q1) OR log_value > q3 + 1.5 * (q3 - q1), FALSE))
SELECT event_id, ROUND(value, 6) AS value, ROUND(log_value, 6) AS log_value FROM r2""")
def outlier_remove(spark, sf):
    return _treated(spark, sf, "iqr", "remove", k=1.5)


@register("outlier_cap", EF_SQL + """
, b1 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                quantile_cont(log_value, 0.25) AS p1, quantile_cont(log_value, 0.75) AS p3 FROM ef)
SELECT event_id,
       CASE WHEN value IS NOT NULL
            THEN ROUND(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) END AS value,
       CASE WHEN log_value IS NOT NULL
            THEN ROUND(least(greatest(log_value, p1 - 1.5 * (p3 - p1)), p3 + 1.5 * (p3 - p1)), 6) END AS log_value
FROM ef, b1""")
def outlier_cap(spark, sf):
    return _treated(spark, sf, "iqr", "cap", k=1.5)


@register("outlier_median", EF_SQL + """
, b AS (SELECT AVG(value) AS mv, STDDEV_SAMP(value) AS sv, quantile_cont(value, 0.5) AS medv,
               AVG(log_value) AS ml, STDDEV_SAMP(log_value) AS sl, quantile_cont(log_value, 0.5) AS medl
        FROM ef)
SELECT event_id,
       ROUND(CASE WHEN abs((value - mv) / sv) > 3 THEN medv ELSE value END, 6) AS value,
       ROUND(CASE WHEN abs((log_value - ml) / sl) > 3 THEN medl ELSE log_value END, 6) AS log_value
FROM ef, b""")
def outlier_median(spark, sf):
    return _treated(spark, sf, "zscore", "median", threshold=3.0)


@register("outlier_counts", EF_SQL + f"""
, c AS (SELECT (SELECT COUNT(*) FROM ef WHERE value < {_IQR_LO.replace('{c}', 'value')}
                 OR value > {_IQR_HI.replace('{c}', 'value')}) AS a,
               (SELECT COUNT(*) FROM ef WHERE log_value < {_IQR_LO.replace('{c}', 'log_value')}
                 OR log_value > {_IQR_HI.replace('{c}', 'log_value')}) AS b)
SELECT 'value' AS column_name, a AS n_outliers FROM c
UNION ALL SELECT 'log_value', b FROM c
UNION ALL SELECT 'TOTAL', a + b FROM c""")
def outlier_counts(spark, sf):
    out = outliers.outlier_counts(events_features(spark, sf), OUT_COLS, "iqr", k=1.5)
    return out.select(F.col("column").alias("column_name"), "n_outliers")


# ------------------------------------------------------------------ variance / correlation
def _var_sql(where: str = "", order_limit: str = "") -> str:
    parts = [f"SELECT '{c}' AS feature, var_samp({c}) AS variance, stddev_samp({c}) AS std, "
             f"CASE WHEN AVG({c}) <> 0 THEN stddev_samp({c}) / AVG({c}) END AS cv FROM ef"
             for c in FEATURES]
    body = "\nUNION ALL\n".join(parts)
    return (EF_SQL + f", v AS ({body})\nSELECT feature, ROUND(variance, 6) AS variance, "
            f"ROUND(std, 6) AS std, ROUND(cv, 6) AS cv FROM v {where} {order_limit}")


def _var_out(df):
    return _r(df, ["variance", "std", "cv"])


@register("variance_summary", _var_sql())
def variance_summary(spark, sf):
    return _var_out(variance.variance_summary(events_features(spark, sf), FEATURES))


@register("select_variance", _var_sql("WHERE variance >= 1.0"))
def select_variance(spark, sf):
    s = variance.variance_summary(events_features(spark, sf), FEATURES)
    return _var_out(variance.select_by_variance(s, 1.0))


@register("select_top_n", _var_sql("", "ORDER BY variance DESC, feature LIMIT 2"))
def select_top_n(spark, sf):
    s = variance.variance_summary(events_features(spark, sf), FEATURES)
    return _var_out(variance.select_top_n(s, 2))


@register("select_manual", EF_SQL + "SELECT value, minute, event_type FROM ef")
def select_manual(spark, sf):
    ef = events_features(spark, sf).select("value", "minute", "event_type", "k")
    return variance.select_features(ef, ["value", "minute"], keep_non_numeric=True)


def _corr_sql(where: str = "") -> str:
    parts = []
    for a in FEATURES:
        for b in FEATURES:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            if a == b:
                parts.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                             f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END AS correlation FROM ef")
                continue
            parts.append(
                f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                f"covar_samp({a}, {b}) FILTER (WHERE {both}) / NULLIF(stddev_samp({a}) FILTER (WHERE {both}) "
                f"* stddev_samp({b}) FILTER (WHERE {both}), 0) AS correlation FROM ef")
    body = "\nUNION ALL\n".join(parts)
    return EF_SQL + f", m AS ({body})\nSELECT feature_1, feature_2, ROUND(correlation, 6) AS correlation FROM m {where}"


@register("corr_matrix", _corr_sql())
def corr_matrix(spark, sf):
    return _r(variance.correlation_matrix(events_features(spark, sf), FEATURES), ["correlation"])


@register("corr_pairs", _corr_sql("WHERE abs(correlation) > 0.5 AND abs(correlation) < 1.0"))
def corr_pairs(spark, sf):
    m = variance.correlation_matrix(events_features(spark, sf), FEATURES)
    return _r(variance.high_correlation_pairs(m, 0.5), ["correlation"])


# ------------------------------------------------------------------ ties, integers, null groups
@register("outlier_cap_int", """
WITH e AS (SELECT event_id, CAST(floor(value) AS INTEGER) AS x FROM events),
b AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM e)
SELECT event_id, CAST(least(greatest(x, q1 - 0.5 * (q3 - q1)), q3 + 0.5 * (q3 - q1)) AS DOUBLE) AS x FROM e, b""")
def outlier_cap_int(spark, sf):
    """Capping an integer column: the bounds keep their fractions."""
    e = load_table(spark, sf, "events").select("event_id", F.floor("value").cast("int").alias("x"))
    return outliers.treat(e, ["x"], "iqr", "cap", k=0.5)[0]


@register("na_median_ties", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END AS x FROM events)
SELECT event_id, COALESCE(x, (SELECT quantile_cont(x, 0.5) FROM e)) AS x FROM e""")
def na_median_ties(spark, sf):
    """Median fill of a column of two values, about half each."""
    x = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 2).cast("double"))
    return missing.fill_statistic(load_table(spark, sf, "events").select("event_id", x.alias("x")), "median", ["x"])[0]


@register("na_mean_nan", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS x FROM events)
SELECT event_id, ROUND(COALESCE(x, (SELECT AVG(x) FROM e)), 6) AS x FROM e""")
def na_mean_nan(spark, sf):
    """Mean fill where NaN stands for a missing value."""
    x = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    got, _ = missing.fill_statistic(load_table(spark, sf, "events").select("event_id", x.alias("x")), "mean", ["x"])
    return got.select("event_id", F.round("x", 6).alias("x"))
