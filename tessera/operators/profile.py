"""Column profile and dataset totals (one aggregate pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import require_columns


def column_profile(df: DataFrame, order_key: str, approx_distinct: bool = False) -> DataFrame:
    """One row per column: ``column, type, missing, unique, example``.

    ``missing`` counts NULLs (and NaN for floating columns), ``unique`` counts
    distinct non-null values, ``example`` is the value in the first row by
    ``order_key`` rendered as a string ("nan" when null, like pandas)."""
    require_columns(df, [order_key])
    types = dict(df.dtypes)
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull()
    examples = df.agg(*[F.min_by(F.coalesce(F.col(c).cast("string"), F.lit("nan")), F.col(order_key)).alias(f"e{i}")
                        for i, c in enumerate(df.columns)])
    examples = examples.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"e{i}").alias("example"))
        for i, c in enumerate(df.columns)])))
    if approx_distinct:
        row = df.agg(*[F.count_if(missing(c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
                     *[F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(df.columns)])
        counts = row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"m{i}").alias("missing"), F.col(f"u{i}").alias("unique"))
                                               for i in range(len(df.columns))])))
    else:
        # one exchange of (column, 128-bit value hash), repeats summed before it; what follows is a row a column and task
        cells = df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("position"), missing(c).cast("int").alias("m"),
                     F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("h"), F.xxhash64(F.lit(i), c).alias("g"))
            for i, c in enumerate(df.columns)])))
        values = cells.groupBy("position", "h", "g").agg(F.sum("m").alias("m"))
        counts = values.groupBy("position").agg(F.sum("m").alias("missing"), F.count("h").alias("unique"))
    counts = counts.withColumnRenamed("position", "at")
    return examples.join(counts, F.col("position") == F.col("at"), "left").select(
        "position", "column", "type", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
        F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), "example")


def dataset_totals(df: DataFrame) -> DataFrame:
    """``n_rows, n_columns, missing_cells, duplicate_rows`` (occurrences after
    the first of a repeated row).

    One distributed group-by over all columns (partial aggregation collapses
    repeats map-side); identical rows share their missing-cell count, so the
    totals follow from the group counts."""
    miss = F.lit(0)
    for c, t in df.dtypes:
        m = F.col(c).isNull()
        if t in ("double", "float"):
            m = m | F.isnan(c)
        miss = miss + m.cast("int")
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"),
                                         F.first(miss).alias("_miss"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.coalesce(F.sum(F.col("_n") * F.col("_miss")), F.lit(0)).cast("long").alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
