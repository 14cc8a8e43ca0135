"""Scalar-function and source/sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.columns import business_days_after, coerce_double
from tessera.operators import series as ser
from tessera.plans.registry import register
from tessera.session import ensure_checkpoint_dir
from tessera.sources import files
from tessera.sources.tables import load_table


@register("minmax_scale", """
WITH b AS (SELECT user_id, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id,
       ROUND(COALESCE((e.value - b.lo) / NULLIF(b.hi - b.lo, 0), 0), 6) AS value_scaled
FROM events e JOIN b ON e.user_id = b.user_id""")
def minmax_scale(spark, sf):
    e = load_table(spark, sf, "events").select("event_id", "user_id", "value")
    out = ser.minmax_scale(e, ["user_id"], ["value"])
    return out.select("event_id", "user_id", F.round("value_scaled", 6).alias("value_scaled"))


@register("minmax_scale_nulls", """
WITH g AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
                  CASE WHEN event_id % 7 = 0 OR user_id % 13 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 3.5 ELSE value END AS value FROM events),
b AS (SELECT user_id, MIN(value) AS lo, MAX(value) AS hi FROM g GROUP BY user_id)
SELECT g.event_id, g.user_id,
       CASE WHEN g.value IS NULL THEN NULL WHEN b.hi = b.lo THEN 0 ELSE ROUND((g.value - b.lo) / (b.hi - b.lo), 6) END AS value_scaled
FROM g LEFT JOIN b ON g.user_id = b.user_id WHERE g.user_id IS NOT NULL""")
def minmax_scale_nulls(spark, sf):
    """Scaling with null values (stay null), constant series (0) and null series (dropped)."""
    user, at = F.col("user_id"), F.col("event_id")
    value = F.when((at % 7 != 0) & (user % 13 != 0), F.when(user % 5 == 0, F.lit(3.5)).otherwise(F.col("value")))
    e = load_table(spark, sf, "events").select("event_id", value.alias("value"), F.when(at % 11 != 0, user).alias("user_id"))
    out = ser.minmax_scale(e, ["user_id"], ["value"])
    return out.select("event_id", "user_id", F.round("value_scaled", 6).alias("value_scaled"))


@register("business_days", """
WITH l AS (SELECT user_id, CAST(MAX(ts) AS DATE) AS last_day FROM events GROUP BY user_id)
SELECT user_id, last_day,
       list_transform(list_filter(generate_series(last_day + 1, last_day + 14, INTERVAL 1 DAY),
                                  lambda x: dayofweek(x) NOT IN (0, 6))[1:5], lambda x: CAST(x AS DATE))
         AS next_days
FROM l""")
def business_days(spark, sf):
    """The next 5 business days after each user's last event day."""
    e = load_table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last_day"))
    return last.select("user_id", "last_day", business_days_after("last_day", 5).alias("next_days"))


_OHLC_SQL = """
SELECT user_id, {key} AS period, arg_min(value, ts) AS open, MAX(value) AS high, MIN(value) AS low,
       arg_max(value, ts) AS close, COUNT(*) AS volume
FROM events GROUP BY user_id, {key}"""


@register("ohlc_resample", _OHLC_SQL.format(key="CAST(ts AS DATE)"))
def ohlc_resample(spark, sf):
    """Daily open/high/low/close/volume bars per user."""
    e = load_table(spark, sf, "events")
    return ser.ohlc(e, ["user_id"], "ts", "value", "day")


@register("ohlc_weekly", _OHLC_SQL.format(key="CAST(date_trunc('week', ts) AS DATE)"))
def ohlc_weekly(spark, sf):
    e = load_table(spark, sf, "events")
    return ser.ohlc(e, ["user_id"], "ts", "value", "week")


@register("series_clean", """
SELECT user_id AS stock, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, MAX(value) AS high,
       MIN(value) AS low, arg_max(value, ts) AS close, CAST(COUNT(*) AS DOUBLE) AS volume
FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def series_clean(spark, sf):
    """Stock-table cleaning on text input: daily bars rendered as the text a
    CSV holds (``dd-MM-yyyy`` dates, numbers as strings, padded headers), then
    parsed back with coercing parsers, bad rows dropped, sorted by date."""
    e = load_table(spark, sf, "events")
    bars = ser.ohlc(e, ["user_id"], "ts", "value", "day")
    text = bars.select(F.col("user_id").cast("string").alias(" Stock Name "),
                       F.date_format("period", "dd-MM-yyyy").alias("Date "),
                       *[F.col(c).cast("string").alias(c.capitalize())
                         for c in ["open", "high", "low", "close", "volume"]])
    clean = ser.clean_stock_table(text)
    return clean.select(F.col("Stock Name").cast("long").alias("stock"),
                        F.to_date("Date").alias("date"),
                        *[F.col(c.capitalize()).alias(c) for c in ["open", "high", "low", "close", "volume"]])


@register("src_csv_roundtrip", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def src_csv_roundtrip(spark, sf):
    """CSV sink then CSV source (header, inferred types) into the shared
    checkpoint folder; the read-back table equals the original."""
    c = load_table(spark, sf, "customer")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-csv/{uuid.uuid4().hex}"
    files.write_csv(c, path)
    back = files.read_csv(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                       F.col("c_nationkey").cast("int").alias("c_nationkey"),
                       coerce_double("c_acctbal").alias("c_acctbal"), "c_mktsegment")

