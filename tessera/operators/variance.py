"""Variance summary, variance-based feature selection and pairwise-complete
Pearson correlation (all in single aggregate passes)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import nan_to_null, numeric_columns, require_columns


def variance_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``feature, variance, std, cv`` (sample statistics; cv NULL when the mean
    is 0), sorted by variance descending."""
    cols = columns if columns is not None else numeric_columns(df)
    require_columns(df, cols)
    df = nan_to_null(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.var_samp(c).alias(f"v{i}"), F.stddev_samp(c).alias(f"s{i}"), F.avg(c).alias(f"m{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"),
                        F.col(f"s{i}").alias("std"),
                        F.when(F.col(f"m{i}") != 0, F.try_divide(F.col(f"s{i}"), F.col(f"m{i}")))
                        .alias("cv"))
               for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*structs))).orderBy(F.desc_nulls_last("variance"))


def select_by_variance(summary: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Features whose variance is at least ``threshold``."""
    return summary.where(F.col("variance") >= threshold)


def select_top_n(summary: DataFrame, n: int) -> DataFrame:
    """The ``n`` features of largest variance (ties by name)."""
    return summary.orderBy(F.desc_nulls_last("variance"), F.asc("feature")).limit(n)


def select_features(df: DataFrame, features: list[str], keep_non_numeric: bool = False) -> DataFrame:
    """Project the chosen features, optionally passing non-numeric columns through."""
    require_columns(df, features)
    num = set(numeric_columns(df))
    extra = [c for c in df.columns if keep_non_numeric and c not in num and c not in features]
    return df.select(*features, *extra)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long Pearson matrix ``feature_1, feature_2, correlation`` over the rows
    where both are non-null (pairwise complete).  A constant column gives NULL
    (pandas NaN) instead of an ANSI divide-by-zero."""
    require_columns(df, columns)
    df = nan_to_null(df, columns)
    aggs = []
    pairs = [(a, b) for a, b in product(columns, columns)]
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa = F.when(both, F.col(a).cast("double"))
        xb = F.when(both, F.col(b).cast("double"))
        aggs += [F.covar_samp(xa, xb).alias(f"c{i}"), F.stddev_samp(xa).alias(f"sa{i}"),
                 F.stddev_samp(xb).alias(f"sb{i}")]
    row = df.agg(*aggs)
    def corr(i, a, b):
        if a == b:  # the diagonal is exactly 1 (NULL for a constant column)
            return F.when(F.col(f"sa{i}") > 0, F.lit(1.0))
        return F.try_divide(F.col(f"c{i}"), F.col(f"sa{i}") * F.col(f"sb{i}"))

    structs = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                        corr(i, a, b).alias("correlation"))
               for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*structs)))


def high_correlation_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with ``threshold < |r| < 1`` in both directions, sorted descending."""
    r = F.abs(F.col("correlation"))
    return matrix.where((r > threshold) & (r < 1.0)).orderBy(F.desc("correlation"))
