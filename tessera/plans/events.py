"""Event feature queries (P10-P13, Z3 batch form, L2/S10) over ``events``.

Shopping view of the events table: ``purchase`` events are add-to-cart
interactions; session duration (minutes) is ``1 + value / 25``; the product
category is the props key ``k`` in bands of 20; a user's purchase history is
the number of that user's purchase events before the current one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators.smoothing import series_prefix_sum
from tessera.plans.registry import register
from tessera.sources.tables import load_table

# codes for the driver table's two extra event types extend the fixed three
SHOP_CODES = {**ev.EVENT_CODES, "signup": 3, "error": 4}


def shopping_events(spark, sf):
    e = load_table(spark, sf, "events")
    flag = (F.col("event_type") == "purchase").cast("long")
    cum = series_prefix_sum(e, ["user_id"], ["ts", "event_id"], flag)
    k = F.get_json_object("props", "$.k").cast("int")
    cats = F.array(*[F.lit(c) for c in ev.PRODUCT_CATEGORIES])
    return cum.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_type") == "purchase", "add_to_cart").otherwise(F.col("event_type"))
        .alias("event_type"),
        F.round(F.lit(1.0) + F.col("value") / 25.0, 2).alias("session_duration"),
        F.element_at(cats, (F.floor(k / 20) + 1).cast("int")).alias("product_category"),
        (F.col("_cum") - flag).alias("user_total_purchases"))


SHOP_SQL = """
WITH s AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type = 'purchase' THEN 'add_to_cart' ELSE event_type END AS event_type,
         ROUND(1.0 + value / 25.0, 2) AS session_duration,
         (['electronics', 'fashion', 'home', 'books', 'toys'])[
             CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 20) AS INTEGER) + 1]
           AS product_category,
         CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
             PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS user_total_purchases
  FROM events)
"""

_RULE_SQL = """CASE WHEN (event_type = 'view' AND session_duration > 12 AND user_total_purchases > 10)
       OR (event_type = 'add_to_cart' AND session_duration > 5 AND user_total_purchases > 4)
       OR (event_type = 'click' AND session_duration > 7 AND user_total_purchases > 6)
       THEN 1 ELSE 0 END"""


@register("event_rule_label", SHOP_SQL + f"""
SELECT event_id, user_id, event_type, session_duration, user_total_purchases,
       {_RULE_SQL} AS purchase FROM s""")
def event_rule_label(spark, sf):
    s = shopping_events(spark, sf)
    return s.select("event_id", "user_id", "event_type", "session_duration", "user_total_purchases",
                    ev.purchase_rule(F.col("event_type"), F.col("session_duration"),
                                     F.col("user_total_purchases")).alias("purchase"))


_BUCKETS_SQL = """CASE WHEN session_duration <= 6 THEN 'low' WHEN session_duration <= 10 THEN 'medium'
            ELSE 'high' END AS duration_band,
       CASE WHEN user_total_purchases <= 5 THEN 'very few' WHEN user_total_purchases <= 10 THEN 'few'
            WHEN user_total_purchases <= 20 THEN 'medium' ELSE 'high' END AS purchases_band"""


@register("event_buckets", SHOP_SQL + f"""
SELECT event_id, session_duration, user_total_purchases, {_BUCKETS_SQL} FROM s""")
def event_buckets(spark, sf):
    s = shopping_events(spark, sf)
    return s.select("event_id", "session_duration", "user_total_purchases",
                    ev.duration_bucket(F.col("session_duration")).alias("duration_band"),
                    ev.purchases_bucket(F.col("user_total_purchases")).alias("purchases_band"))


@register("event_features", SHOP_SQL + f"""
SELECT event_id,
       CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'add_to_cart' THEN 2
                       WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS event_code,
       CASE product_category WHEN 'electronics' THEN 0 WHEN 'fashion' THEN 1 WHEN 'home' THEN 2
                             WHEN 'books' THEN 3 WHEN 'toys' THEN 4 END AS category_code,
       {_BUCKETS_SQL}, {_RULE_SQL} AS purchase
FROM s""")
def event_features(spark, sf):
    """Model features of an event: ordinal codes and bucket labels + label."""
    s = shopping_events(spark, sf)
    return s.select("event_id",
                    ev.code_of(F.col("event_type"), SHOP_CODES).alias("event_code"),
                    ev.category_code(F.col("product_category")).alias("category_code"),
                    ev.duration_bucket(F.col("session_duration")).alias("duration_band"),
                    ev.purchases_bucket(F.col("user_total_purchases")).alias("purchases_band"),
                    ev.purchase_rule(F.col("event_type"), F.col("session_duration"),
                                     F.col("user_total_purchases")).alias("purchase"))


@register("event_dayparts", """
SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute,
       CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 420 AND 600 THEN 'morning'
            WHEN hour(ts) * 60 + minute(ts) BETWEEN 720 AND 900 THEN 'midday'
            WHEN hour(ts) * 60 + minute(ts) BETWEEN 1080 AND 1320 THEN 'evening'
            ELSE 'off_peak' END AS daypart,
       CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 420 AND 600 THEN 70
            WHEN hour(ts) * 60 + minute(ts) BETWEEN 720 AND 900 THEN 85
            WHEN hour(ts) * 60 + minute(ts) BETWEEN 1080 AND 1320 THEN 40 ELSE 5 END AS occupancy_low,
       CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 420 AND 600 THEN 90
            WHEN hour(ts) * 60 + minute(ts) BETWEEN 720 AND 900 THEN 100
            WHEN hour(ts) * 60 + minute(ts) BETWEEN 1080 AND 1320 THEN 60 ELSE 30 END AS occupancy_high
FROM events""")
def event_dayparts(spark, sf):
    e = load_table(spark, sf, "events")
    m = ev.minute_of_day(F.col("ts"))
    name, lo, hi = ev.daypart(m)
    return e.select("event_id", m.alias("minute"), name.alias("daypart"),
                    lo.alias("occupancy_low"), hi.alias("occupancy_high"))


@register("recent_events", SHOP_SQL + f"""
SELECT event_id, user_id, event_type, product_category,
       CASE WHEN {_RULE_SQL} = 1 THEN 'Yes' ELSE 'No' END AS purchase
FROM s ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_events(spark, sf):
    """The last 100 enriched events (ordered top-k: each partition keeps 100)."""
    s = shopping_events(spark, sf)
    label = ev.purchase_rule(F.col("event_type"), F.col("session_duration"), F.col("user_total_purchases"))
    return (s.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
            .select("event_id", "user_id", "event_type", "product_category",
                    F.when(label == 1, "Yes").otherwise("No").alias("purchase")))
