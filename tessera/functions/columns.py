"""Scalar Column helpers.  Everything here returns a Column expression that
stays inside whole-stage codegen (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ----------------------------------------------------------------- schema helpers
def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise (never return empty) when required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of numeric type (pandas ``select_dtypes('number')``)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of string type (pandas ``select_dtypes('object')``)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into NULL once at load (pandas treats both as missing)."""
    cols = set(columns) if columns is not None else None
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ----------------------------------------------------------------- arithmetic
def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero denominator under ANSI mode."""
    return F.try_divide(num, den)


def exact_sum(col: Column | str, scale: int | None = None) -> Column:
    """SUM that is independent of summation order; 0 for a group without values.

    With ``scale`` the values are summed as DECIMAL(28, scale) and the result
    cast back to double, so partial aggregation across any partitioning gives
    bit-identical results (money columns have two decimals)."""
    c = F.col(col) if isinstance(col, str) else col
    if scale is None:
        return F.coalesce(F.sum(c), F.lit(0))
    return F.coalesce(F.sum(c.cast(T.DecimalType(28, scale))).cast("double"), F.lit(0.0))


# ----------------------------------------------------------------- parsing
def parse_timestamp(col: Column | str, fmt: str) -> Column:
    """Coercing date parse: unparsable -> NULL (pandas ``errors='coerce'``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.trim(c.cast("string")), F.lit(fmt))


def coerce_double(col: Column | str) -> Column:
    """Coercing numeric parse (``pd.to_numeric(errors='coerce')``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string")).try_cast("double")


def split_trim(col: Column | str, sep: str = ",") -> Column:
    """Split a multi-item cell on ``sep`` and trim each item; empty items dropped."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(c, sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


# ----------------------------------------------------------------- formatting
def join_sorted(items: Column | str, sep: str = ", ") -> Column:
    """Sorted join of an item array (itemset display)."""
    c = F.col(items) if isinstance(items, str) else items
    return F.array_join(F.array_sort(c), sep)


def format_itemset(items: Column) -> Column:
    """``{a, b}`` for an item array."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(items), ", "), F.lit("}"))


def format_element(items: Column) -> Column:
    """A sequence element: a single item bare, several items in braces."""
    return F.when(F.size(items) == 1, items[0]).otherwise(format_itemset(items))


def format_sequence(elements: Column) -> Column:
    """``<a -> {b, c}>`` for an array of item arrays; a single element is
    shown as an itemset ``{a}`` / ``{a, b}``."""
    body = F.array_join(F.transform(elements, format_element), " -> ")
    return F.when(F.size(elements) == 1, format_itemset(elements[0])) \
        .otherwise(F.concat(F.lit("<"), body, F.lit(">")))


def sequence_length(elements: Column) -> Column:
    """Number of items over all elements of a sequence."""
    return F.aggregate(elements, F.lit(0), lambda acc, e: acc + F.size(e))


# ----------------------------------------------------------------- text
def strip_non_word(col: Column | str) -> Column:
    """Strip leading and trailing non-word characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"^\W+|\W+$", "")


def clean_token(col: Column | str) -> Column:
    """Remove all non-word characters and lower-case (token comparison)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"\W+", ""))


# ----------------------------------------------------------------- dates
def business_days_after(date_col: Column | str, n: int) -> Column:
    """Array of the next ``n`` Monday-Friday dates strictly after ``date_col``."""
    c = F.col(date_col) if isinstance(date_col, str) else col_or(date_col)
    d = F.to_date(c)
    # n business days fit in ceil(n/5)*7 + 7 calendar days
    span = ((n + 4) // 5) * 7 + 7
    days = F.sequence(F.date_add(d, 1), F.date_add(d, span))
    weekdays = F.filter(days, lambda x: ~F.dayofweek(x).isin(1, 7))
    return F.slice(weekdays, 1, n)


def col_or(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
