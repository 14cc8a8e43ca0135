"""Outlier detection (IQR, Z-score, modified Z-score, percentile) and
treatment (remove, cap, replace with median), folded over the columns in
order: a later column's statistics see the rows an earlier ``remove`` kept.

Bounds are scalars computed by Spark aggregates; the row-level test is a
Column expression, so detection and treatment are a single narrow stage.
Nulls are never outliers and survive every treatment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import nan_to_null, numeric_columns, require_columns
from tessera.functions.quantiles import medians, quantiles_of

MAD_SCALE = 0.6745  # fixed value: consistency constant of the modified Z-score


@dataclass
class Bounds:
    column: str
    method: str
    lower: float | None
    upper: float | None
    center: float | None = None   # mean (Z) or median (modified Z)
    spread: float | None = None   # std (Z) or MAD (modified Z)


def bounds(df: DataFrame, col: str, method: str = "iqr", **params) -> Bounds:
    """Detection bounds of one column (see :func:`bounds_of`)."""
    return bounds_of(df, [col], method, **params)[col]


def bounds_of(df: DataFrame, cols: list[str], method: str = "iqr", k: float = 1.5, threshold: float = 3.0,
              lower_pct: float = 1.0, upper_pct: float = 99.0, approx: bool = False) -> dict[str, Bounds]:
    """Detection bounds of several columns from the same scans.  For the Z methods
    ``lower/upper`` are the equivalent value bounds (used by ``cap``)."""
    out = {}
    if method in ("iqr", "percentile"):
        probs = [0.25, 0.75] if method == "iqr" else [lower_pct / 100.0, upper_pct / 100.0]
        for c, (lo, hi) in quantiles_of(df, {c: probs for c in cols}, approx=approx).items():
            more = k * (hi - lo) if method == "iqr" and lo is not None else 0.0
            out[c] = Bounds(c, method, None, None) if lo is None else Bounds(c, method, lo - more, hi + more)
        return out
    if method == "zscore":
        row = df.agg(*[x for c in cols for x in (F.avg(c), F.stddev_samp(c))]).first() if cols else []
        for i, c in enumerate(cols):
            m, s = row[2 * i], row[2 * i + 1]
            known = m is not None and s is not None
            out[c] = Bounds(c, method, m - threshold * s if known else None, m + threshold * s if known else None, m, s)
        return out
    if method == "modified_zscore":
        med = medians(df, cols, approx=approx)
        known = [c for c in cols if med[c] is not None]
        dev = df.select(*[F.abs(F.col(c) - F.lit(med[c])).alias(c) for c in known])
        mad = medians(dev, known, approx=approx)
        for c in cols:
            if med[c] is None:
                out[c] = Bounds(c, method, None, None)
            else:
                half = threshold * mad[c] / MAD_SCALE
                out[c] = Bounds(c, method, med[c] - half, med[c] + half, med[c], mad[c])
        return out
    raise ValueError(f"unknown method {method!r}")


def is_outlier(col: str, b: Bounds, threshold: float = 3.0) -> Column:
    """Row-level test; NULL values and undefined bounds give False."""
    x = F.col(col)
    if b.method == "zscore":
        if b.center is None or not b.spread:
            # std undefined or 0: z is NaN/inf-free only when x == mean -> no outliers with NaN z
            return F.lit(False)
        test = F.abs((x - F.lit(b.center)) / F.lit(b.spread)) > F.lit(threshold)
    elif b.method == "modified_zscore":
        if b.center is None:
            return F.lit(False)
        if b.spread == 0:
            # MAD = 0: any value off the median has infinite score
            test = x != F.lit(b.center)
        else:
            test = F.abs(F.lit(MAD_SCALE) * (x - F.lit(b.center)) / F.lit(b.spread)) > F.lit(threshold)
    else:
        if b.lower is None:
            return F.lit(False)
        test = (x < F.lit(b.lower)) | (x > F.lit(b.upper))
    return F.coalesce(test, F.lit(False))


def treat(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
          treatment: str = "remove", approx: bool = False, **params) -> tuple[DataFrame, list[dict]]:
    """Detect and treat outliers column by column.  Returns the treated frame
    and per-column ``{column, lower, upper, n_outliers}`` records."""
    cols = columns if columns is not None else numeric_columns(df)
    require_columns(df, cols)
    if treatment not in ("remove", "cap", "median"):
        raise ValueError(f"unknown treatment {treatment!r}")
    threshold = params.get("threshold", 3.0)
    cur = nan_to_null(df, cols)
    report = []
    if treatment == "remove":                                 # rows removed for one column are gone for the next
        for c in cols:
            b = bounds(cur, c, method, approx=approx, **params)
            flag = is_outlier(c, b, threshold)
            n = cur.agg(F.count_if(flag)).first()[0]
            report.append({"column": c, "lower": b.lower, "upper": b.upper, "n_outliers": n})
            cur = cur.where(~flag) if n else cur
        return cur, report
    # treated values of one column do not touch the others: all columns at once
    found = bounds_of(cur, cols, method, approx=approx, **params)
    flags = {c: is_outlier(c, found[c], threshold) for c in cols}
    counts = dict(zip(cols, cur.agg(*[F.count_if(flags[c]) for c in cols]).first())) if cols else {}
    report = [{"column": c, "lower": found[c].lower, "upper": found[c].upper, "n_outliers": counts[c]} for c in cols]
    hit = [c for c in cols if counts[c] and found[c].lower is not None]
    if treatment == "median":
        med = medians(cur, hit, approx=approx)
        new = {c: F.when(flags[c], F.lit(med[c])).otherwise(F.col(c)).cast("double") for c in hit}
    else:
        new = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(found[c].lower)), F.lit(found[c].upper))
                         .cast("double")) for c in hit}       # bounds may be fractions
    return cur.withColumns({c: new[c].alias(c) for c in hit}) if hit else cur, report


def outlier_report(spark, report: list[dict]) -> DataFrame:
    """Per-column counts plus a TOTAL row, as a DataFrame."""
    rows = [(r["column"], r["lower"], r["upper"], int(r["n_outliers"])) for r in report]
    rows.append(("TOTAL", None, None, sum(r[3] for r in rows)))
    return spark.createDataFrame(rows, "column string, lower double, upper double, n_outliers long")


def outlier_counts(df: DataFrame, columns: list[str], method: str = "iqr", approx: bool = False,
                   **params) -> DataFrame:
    """Outliers per column, detected on the same data (no treatment between),
    computed in one pass with ``count_if`` per column."""
    threshold = params.get("threshold", 3.0)
    df = nan_to_null(df, columns)
    found = bounds_of(df, columns, method, approx=approx, **params)
    flags = [is_outlier(c, found[c], threshold) for c in columns]
    row = df.agg(*[F.count_if(f).alias(c) for f, c in zip(flags, columns)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_outliers")) for c in columns]
    per = row.select(F.inline(F.array(*structs)))
    total = row.select(F.lit("TOTAL").alias("column"),
                       sum((F.col(c) for c in columns), F.lit(0)).cast("long").alias("n_outliers"))
    return per.unionByName(total)
