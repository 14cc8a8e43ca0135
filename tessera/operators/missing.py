"""Missing-value handling: drop, mean / median / adaptive mode fill,
categorical mode fill, and chained (iterative) model imputation.

Statistics are computed by Spark as one small aggregate per pass; only the
resulting scalars (one per column) come back to the driver and are applied
with ``fillna`` / ``coalesce`` literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import nan_to_null, numeric_columns, require_columns
from tessera.functions.quantiles import medians
from tessera.operators.chained import impute_linear
from tessera.session import cut_lineage


def null_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    cols = columns or df.columns
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(c)
        aggs.append(F.count_if(m).alias(c))
    row = df.agg(*aggs).first()
    return {c: row[c] for c in cols}


def columns_with_nulls(df: DataFrame) -> list[str]:
    counts = null_counts(df)
    return [c for c in df.columns if counts[c] > 0]


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop rows null in any column that has nulls (``dropna(subset=...)``)."""
    cols = columns_with_nulls(df)
    return df.dropna(how="any", subset=cols) if cols else df


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value, smallest value on ties (pandas
    ``mode()[0]``).  A distributed group-by + top-1, never a single-task map."""
    top = (df.where(F.col(col).isNotNull()).groupBy(col).count()
           .orderBy(F.desc("count"), F.asc(col)).limit(1).collect())
    return top[0][col] if top else None


def discrete_threshold(total_rows: int) -> float:
    """Unique-ratio threshold under which a numeric column counts as discrete."""
    # fixed values: 0.05 below 100 rows, 0.10 below 1000 rows, 0.15 otherwise
    if total_rows < 100:
        return 0.05
    if total_rows < 1000:
        return 0.10
    return 0.15


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    if not values:
        return df
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in values and values[c] is not None:
            v = F.lit(values[c])
            if types[c] == "string":
                out.append(F.coalesce(F.col(c), v).alias(c))
            else:
                # a numeric column with missing values is float in pandas: fill as double
                col = F.col(c).cast("double")
                out.append(F.coalesce(F.nanvl(col, F.lit(None).cast("double")),
                                      v.cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fill_statistic(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None,
                   approx: bool = False, continuous: str = "median") -> tuple[DataFrame, dict]:
    """Fill numeric columns that have nulls.

    ``mean`` / ``median`` fill every such column; ``mode`` fills a *discrete*
    column (distinct/non-null below :func:`discrete_threshold`) with its mode
    and a continuous one with ``continuous`` (median or mean).  Returns the
    filled frame and the value used per column.

    Filled numeric columns become double (pandas turns a numeric column with
    missing values into float64)."""
    if columns is None:
        counts = null_counts(df, numeric_columns(df))         # one scan for all columns
        columns = [c for c in numeric_columns(df) if counts[c] > 0]
    cols = columns
    if not cols:
        return df, {}
    df = nan_to_null(df, cols)                                # NaN counts as missing and is filled
    values: dict[str, object] = {}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        values = {c: row[c] for c in cols}
    elif strategy == "median":
        values = dict(medians(df, cols, approx=approx))
    elif strategy == "mode":
        total = df.count()
        thr = discrete_threshold(total)
        stats = df.agg(*[F.count_distinct(c).alias(f"u_{c}") for c in cols],
                       *[F.count(c).alias(f"n_{c}") for c in cols]).first()
        ratio = {c: stats[f"u_{c}"] / stats[f"n_{c}"] if stats[f"n_{c}"] else 0.0 for c in cols}
        wide = [c for c in cols if ratio[c] >= thr]
        if wide and continuous == "mean":
            other = dict(zip(wide, df.agg(*[F.avg(c) for c in wide]).first()))
        else:
            other = medians(df, wide, approx=approx)
        values = {c: other[c] if c in other else mode_value(df, c) for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _fill(df, values), values


def fill_categorical_mode(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Fill string columns that have nulls with their mode ("" if all null)."""
    types = dict(df.dtypes)
    cols = columns if columns is not None else [
        c for c in columns_with_nulls(df) if types[c] == "string"]
    values = {}
    for c in cols:
        m = mode_value(df, c)
        values[c] = "" if m is None else m
    return _fill(df, values), values


def impute_chained(df: DataFrame, columns: list[str] | None = None, model: str = "linear",
                   max_rounds: int = 10, tol: float = 1e-3, seed: int = 42) -> DataFrame:
    """Chained-equation imputation among the numeric columns that have nulls.

    Start from mean fill; each round, for each column in ascending order of
    null count, fit a regressor on the rows where the column was observed, using
    the current values of the other columns, and replace the originally-missing
    cells with predictions.  Stops after ``max_rounds`` or when the largest change
    of a round falls under ``tol * max|observed value|``.

    ``linear`` (least squares) and ``bayes`` (Bayesian ridge) run on moments
    (:func:`tessera.operators.chained.impute_linear`); ``tree`` fits distributed
    regression trees, cutting lineage each round with a reliable checkpoint."""
    if model != "tree":
        return impute_linear(df, columns, model, max_rounds, tol)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    df = nan_to_null(df, columns)
    counts = null_counts(df)
    cols = columns if columns is not None else [c for c in numeric_columns(df) if counts[c] > 0]
    require_columns(df, cols)
    if not cols:
        return df
    order = {c: i for i, c in enumerate(cols)}
    cols = sorted(cols, key=lambda c: (counts[c], order[c]))
    flags = {c: f"__miss_{i}" for i, c in enumerate(cols)}
    cur = df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns],
                    *[F.col(c).isNull().alias(flags[c]) for c in cols])
    scale = cur.agg(F.greatest(*[F.max(F.abs(c)) for c in cols], F.lit(0.0))).first()[0] or 0.0
    cur, _ = fill_statistic(cur, "mean", cols)
    cur = cut_lineage(cur)
    if len(cols) == 1:
        return cur.drop(*flags.values())
    for _ in range(max_rounds):
        cur = cur.select("*", *[F.col(c).alias(f"__prev_{c}") for c in cols])
        for c in cols:
            others = [o for o in cols if o != c]
            asm = VectorAssembler(inputCols=others, outputCol="__f")
            est = DecisionTreeRegressor(featuresCol="__f", labelCol=c, seed=seed, predictionCol="__p")
            fitted = est.fit(asm.transform(cur.where(~F.col(flags[c]))))
            scored = fitted.transform(asm.transform(cur))
            cur = scored.select(*[F.when(F.col(flags[c]), F.col("__p")).otherwise(F.col(x)).alias(x)
                                  if x == c else F.col(x) for x in cur.columns])
        cur = cut_lineage(cur)
        change = cur.agg(F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"__prev_{c}"))) for c in cols],
                                    F.lit(0.0))).first()[0]
        cur = cur.drop(*[f"__prev_{c}" for c in cols])
        if change < tol * scale:
            break
    return cur.drop(*flags.values())
