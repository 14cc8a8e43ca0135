"""ML preparation: dedupe + fill + label encoding + min-max scaling, problem
type, standardisation (population std), PCA and a deterministic split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import numeric_columns, require_columns, string_columns
from tessera.functions.joins import broadcast_if_bounded
from tessera.operators.missing import fill_categorical_mode, fill_statistic, null_counts
from tessera.operators.smoothing import series_positions

MAX_CLASSES = 20  # fixed value: at most this many distinct values -> classification


def encode_labels(df: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Replace each column by the 0-based rank of its value in sorted order of
    the distinct values (NULL stays NULL).  The ranking numbers the distinct
    values with a range-partitioned sort, so a high-cardinality column is
    never ranked in one task or on the driver."""
    out = df
    for c in columns:
        vals = df.select(F.col(c).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        ranks = series_positions(vals, [], ["_v"]).select(
            F.col("_v"), (F.col("_rn") - 1).cast("int").alias("_code"))
        out = out.join(broadcast_if_bounded(ranks), out[c].eqNullSafe(ranks["_v"]), "left")
        out = out.withColumn(f"{c}{suffix}", F.col("_code")).drop("_v", "_code")
    return out


def prepare(df: DataFrame, target: str | None = None) -> DataFrame:
    """Dedupe rows; fill numeric nulls with the mean and string nulls with the
    mode; label-encode string columns (not the target); min-max scale the
    columns that were numeric before encoding (not the target)."""
    df = df.dropDuplicates()
    nums = numeric_columns(df)
    strs = string_columns(df)
    counts = null_counts(df)
    df, _ = fill_statistic(df, "mean", [c for c in nums if counts[c] > 0])
    df, _ = fill_categorical_mode(df, [c for c in strs if counts[c] > 0])
    enc = [c for c in strs if c != target]
    if enc:
        df = encode_labels(df, enc)
    scale = [c for c in nums if c != target]
    if scale:
        stats = df.agg(*[F.min(c).alias(f"lo_{c}") for c in scale],
                       *[F.max(c).alias(f"hi_{c}") for c in scale]).first()
        cols = []
        for c in df.columns:
            if c in scale:
                lo, hi = stats[f"lo_{c}"], stats[f"hi_{c}"]
                span = (hi - lo) if lo is not None else 0
                expr = ((F.col(c) - F.lit(lo)) / F.lit(span)) if span else F.lit(0.0)
                cols.append(expr.cast("double").alias(c))
            else:
                cols.append(F.col(c))
        df = df.select(*cols)
    return df


def problem_type(df: DataFrame, target: str | None) -> str:
    """No target -> clustering; string target or <= 20 distinct values ->
    classification; otherwise regression."""
    if target is None:
        return "clustering"
    require_columns(df, [target])
    if dict(df.dtypes)[target] == "string":
        return "classification"
    n = df.select(target).distinct().limit(MAX_CLASSES + 1).count()
    return "classification" if n <= MAX_CLASSES else "regression"


def standardize(df: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """``(x - mean) / stddev_pop``; a constant column gives 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    out = []
    for c in df.columns:
        if c in columns:
            m, s = stats[f"m_{c}"], stats[f"s_{c}"]
            e = ((F.col(c) - F.lit(m)) / F.lit(s)) if s else F.lit(0.0)
            out.append(e.cast("double").alias(f"{c}{suffix}"))
            if suffix:
                out.append(F.col(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def split_flag(key: Column, train_permille: int = 700, seed: int = 42) -> Column:
    """Deterministic 70/30 split from key arithmetic: ``train`` when
    ``(key * 2654435761 + seed) mod 1000 < train_permille``, the key being
    reduced first so that large keys cannot overflow (independent of
    partitioning, unlike ``randomSplit``)."""
    return F.when(F.pmod(F.pmod(key, F.lit(1000)) * F.lit(2654435761) + F.lit(seed), F.lit(1000)) < train_permille,
                  "train").otherwise("test")


def pca(df: DataFrame, columns: list[str], k: int = 2, prefix: str = "pc") -> DataFrame:
    """Project centred ``columns`` on the top ``k`` principal components
    (covariance computed distributed; the d x k loadings are tiny).  Sign
    rule: the loading of largest magnitude of each component is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = min(k, len(columns))
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.select("*", *[(F.col(c) - F.lit(means[c])).alias(f"_c_{c}") for c in columns])
    asm = VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol="_x")
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(asm.transform(centred))
    pc = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pc[:, j]
        signs.append(-1.0 if col[abs(col).argmax()] < 0 else 1.0)
    proj = asm.transform(centred)
    proj = model.transform(proj).withColumn("_pa", vector_to_array("_p"))
    return proj.select(*df.columns, *[(F.col("_pa")[j] * F.lit(signs[j])).alias(f"{prefix}{j + 1}")
                                      for j in range(k)])
