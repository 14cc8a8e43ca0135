"""Classification and regression metrics as DataFrame aggregates.

Classification: accuracy and support-weighted precision / recall / F1 with
zero division -> 0, from one ``groupBy(label, prediction)`` confusion table
(tiny: classes x classes).  Regression: MAE, MSE, R^2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    conf = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("c"))
    support = conf.groupBy("y").agg(F.sum("c").alias("support"),
                                    F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(F.col("p").alias("y")).agg(F.sum("c").alias("predicted"))
    per = support.join(predicted, "y", "left").select(
        "y", "support", "tp", F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("*", prec.alias("prec"), rec.alias("rec"))
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    per = per.select("*", f1.alias("f1"))
    n = F.sum("support")
    return per.agg((F.sum("tp") / n).alias("accuracy"),
                   (F.sum(F.col("support") * F.col("prec")) / n).alias("precision"),
                   (F.sum(F.col("support") * F.col("rec")) / n).alias("recall"),
                   (F.sum(F.col("support") * F.col("f1")) / n).alias("f1"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    err = F.col(prediction) - F.col(label)
    stats = df.agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                   F.sum(err * err).alias("ss_res"), F.var_pop(label).alias("var_y"),
                   F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("var_y") > 0, 1 - F.col("ss_res") / (F.col("var_y") * F.col("n")))
    return stats.select("mae", "mse", r2.alias("r2"))


def metrics_long(rows: DataFrame, id_col: str = "model") -> DataFrame:
    """Unpivot a wide metrics table to ``(model, metric, score)``; metrics
    that are not numbers (e.g. "N/A") are dropped."""
    value_cols = [c for c in rows.columns if c != id_col]
    cast = rows.select(id_col, *[F.col(c).cast("string").alias(c) for c in value_cols])
    long = cast.unpivot(id_col, value_cols, "metric", "score")
    return (long.select(id_col, "metric", F.col("score").try_cast("double").alias("score"))
            .where(F.col("score").isNotNull()))
