"""Event feature rules: ordinal codes, the purchase rule label, duration /
history buckets and time-of-day bands (all Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ordinal codes of the shopping event types
EVENT_CODES = {"view": 0, "click": 1, "add_to_cart": 2}
# fixed values: product categories in code order
PRODUCT_CATEGORIES = ["electronics", "fashion", "home", "books", "toys"]
# fixed values: time-of-day bands (minutes of day, inclusive) and their occupancy range
DAYPARTS = [("morning", 420, 600, 70, 90), ("midday", 720, 900, 85, 100),
            ("evening", 1080, 1320, 40, 60)]
OFF_PEAK = ("off_peak", 5, 30)


def code_of(col: Column, codes: dict[str, int]) -> Column:
    """Ordinal code from a literal map (NULL for an unknown value)."""
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return m[col]


def category_code(col: Column, categories: list[str] = PRODUCT_CATEGORIES) -> Column:
    return code_of(col, {c: i for i, c in enumerate(categories)})


def purchase_rule(event_type: Column, duration: Column, purchases: Column) -> Column:
    """1 when (view, > 12 min, > 10 purchases) or (add_to_cart, > 5, > 4) or
    (click, > 7, > 6), else 0."""
    # fixed values: the rule's thresholds
    hit = (((event_type == "view") & (duration > 12) & (purchases > 10))
           | ((event_type == "add_to_cart") & (duration > 5) & (purchases > 4))
           | ((event_type == "click") & (duration > 7) & (purchases > 6)))
    return F.coalesce(hit, F.lit(False)).cast("int")


def duration_bucket(duration: Column) -> Column:
    """<= 6 low, <= 10 medium, else high (right-closed)."""
    return F.when(duration <= 6, "low").when(duration <= 10, "medium").otherwise("high")


def purchases_bucket(purchases: Column) -> Column:
    """<= 5 very few, <= 10 few, <= 20 medium, else high."""
    return (F.when(purchases <= 5, "very few").when(purchases <= 10, "few")
            .when(purchases <= 20, "medium").otherwise("high"))


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def daypart(minute: Column) -> tuple[Column, Column, Column]:
    """(band name, occupancy low, occupancy high) of a minute of the day."""
    name, lo, hi = F.lit(OFF_PEAK[0]), F.lit(OFF_PEAK[1]), F.lit(OFF_PEAK[2])
    for band, start, end, olo, ohi in reversed(DAYPARTS):
        cond = (minute >= start) & (minute <= end)
        name = F.when(cond, band).otherwise(name)
        lo = F.when(cond, olo).otherwise(lo)
        hi = F.when(cond, ohi).otherwise(hi)
    return name, lo, hi
