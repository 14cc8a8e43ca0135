"""Per-series table operators: cleaning a stock table, min-max scaling,
OHLC resampling, eligibility and chronological split.

Per-series statistics are group-by aggregates (partial aggregation, no
per-series task) joined back to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import coerce_double, parse_timestamp, require_columns
from tessera.functions.joins import broadcast_if_bounded

STOCK_NUMERIC = ["Open", "High", "Low", "Close", "Volume"]


def clean_stock_table(df: DataFrame, date_fmt: str = "dd-MM-yyyy") -> DataFrame:
    """Trim header names, parse ``Date`` (day first, unparsable -> dropped),
    coerce OHLCV to numbers (rows with a non-number dropped), sort by date and
    keep ``Stock Name, Date`` + OHLCV."""
    df = df.toDF(*[c.strip() for c in df.columns])
    require_columns(df, ["Stock Name", "Date", *STOCK_NUMERIC])
    out = df.select(F.col("Stock Name"), parse_timestamp("Date", date_fmt).alias("Date"),
                    *[coerce_double(c).alias(c) for c in STOCK_NUMERIC])
    return out.dropna(subset=["Date", *STOCK_NUMERIC]).orderBy("Date")


def minmax_stats(df: DataFrame, series: list[str], columns: list[str]) -> DataFrame:
    """``_lo_<col>``, ``_hi_<col>`` of every column per series."""
    return df.groupBy(*series).agg(*[F.min(c).alias(f"_lo_{c}") for c in columns],
                                   *[F.max(c).alias(f"_hi_{c}") for c in columns])


def minmax_scale(df: DataFrame, series: list[str], columns: list[str],
                 suffix: str = "_scaled") -> DataFrame:
    """``(x - min) / (max - min)`` per series; a constant column gives 0, a null
    value stays null."""
    j = df.join(broadcast_if_bounded(minmax_stats(df, series, columns)), series)
    return j.select(*df.columns, *[
        F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")),
                                                F.lit(0.0))).alias(f"{c}{suffix}") for c in columns])


def minmax_inverse(df: DataFrame, series: list[str], stats: DataFrame, column: str,
                   scaled: str) -> DataFrame:
    """``<scaled>_inv``: a scaled value, or array of values, back in the unit of
    ``column`` (``stats`` from :func:`minmax_stats`; a constant series gives its value)."""
    j = df.join(stats, series)
    lo, hi = F.col(f"_lo_{column}"), F.col(f"_hi_{column}")
    back = lambda x: x * (hi - lo) + lo
    value = F.transform(scaled, back) if dict(df.dtypes)[scaled].startswith("array") else back(F.col(scaled))
    return j.select(*df.columns, value.alias(f"{scaled}_inv"))


def ohlc(df: DataFrame, series: list[str], ts: str, value: str, period: str = "day") -> DataFrame:
    """Open / high / low / close / volume bars per series and ``period``
    (``day``, ``week`` starting Monday, ``month``)."""
    key = F.to_date(F.date_trunc(period, F.col(ts)))
    return (df.where(F.col(value).isNotNull())
            .groupBy(*series, key.alias("period"))
            .agg(F.min_by(value, ts).alias("open"), F.max(value).alias("high"),
                 F.min(value).alias("low"), F.max_by(value, ts).alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def eligible_series(df: DataFrame, series: list[str], columns: list[str], min_rows: int = 150,
                    lags: int | None = None, horizon: int = 0, min_samples: int = 10) -> DataFrame:
    """Series with at least ``min_rows`` complete rows (and, with ``lags``, at
    least ``min_samples`` lag windows and ``lags + horizon`` rows)."""
    complete = df.dropna(subset=columns)
    counts = complete.groupBy(*series).agg(F.count(F.lit(1)).alias("n_rows"))
    ok = F.col("n_rows") >= min_rows
    if lags is not None:
        ok = ok & ((F.col("n_rows") - lags) >= min_samples) & (F.col("n_rows") >= lags + horizon)
    return counts.select(*series, "n_rows", ok.alias("eligible"))
