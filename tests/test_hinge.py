"""The interior point method of the support vector machine against Spark's optimiser and in its number of passes."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.ml import hinge, huber, models


def _frame(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, 2))
    y = ((x ** 2).sum(1) + rng.normal(0, 0.5, n) > 1.5).astype(float)             # classes overlap
    return x, y, spark.createDataFrame([(i, *map(float, a), float(t)) for i, (a, t) in enumerate(zip(x, y))], "id long, a double, b double, y double")


def test_loss_is_at_the_optimum_in_few_jobs(spark):
    x, y, df = _frame(spark, 200)
    c, n, sc = 10.0, len(x), spark.sparkContext
    w, b = map(np.array, models.fourier_weights(2, 0.5))
    f, s = huber.fourier(x, w, b), np.where(y > 0, 1.0, -1.0)

    def loss(t):
        return np.maximum(0, 1 - s * (f @ t[:-1] + t[-1])).sum() + t[:-1] @ t[:-1] / (2 * c)
    wide = spark.createDataFrame([(float(t), Vectors.dense(r)) for t, r in zip(y, f)], ["y", "features"]).coalesce(1).cache()
    m = LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=200, labelCol="y").fit(wide)
    theirs = loss(np.r_[m.coefficients.toArray(), m.intercept])
    sc.setJobGroup("hinge", "fit")
    t = hinge.fit(df, n, ["a", "b"], "y", w, b, 1.0 / (c * n))[0]
    jobs = len(sc.statusTracker().getJobIdsForGroup("hinge"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert loss(t) <= theirs * (1 + hinge.GAP)
    assert jobs <= 250                                        # one or two a pass


def test_cosines():
    z = np.random.default_rng(0).normal(0, 5, (40, 7))
    got = z.copy()
    hinge._cosines(got, np.empty_like(z), np.empty_like(z))
    assert np.abs(got - np.cos(2 * np.pi * z)).max() < 1e-13


def test_predicts_without_wide_columns(spark):
    """No Fourier column is made of the rows: the features live within the passes."""
    _, y, df = _frame(spark)
    out = models.fit_predict(df, df, ["a", "b"], "y", "SVM Classifier", "classification", {"kernel": "rbf"})
    assert out.columns == [*df.columns, "prediction"]
    got = {r.id: r.prediction for r in out.select("id", "prediction").collect()}
    assert (np.array([got[i] for i in range(len(y))]) == y).mean() > 0.85


def test_three_classes_one_class_and_a_missing_class(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(m, 0.4, (40, 2)) for m in ([0, 0], [4, 4], [0, 5])])
    for labels in ((0.0, 1.0, 3.0), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)):
        y = np.repeat(labels, 40)
        df = spark.createDataFrame([(i, *map(float, a), float(t)) for i, (a, t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
        got = {r.id: r.prediction for r in models.fit_predict(df, df, ["a", "b"], "y", "SVM Classifier", "classification", {}).collect()}
        assert (np.array([got[i] for i in range(len(y))]) == y).mean() > 0.97, labels


def test_nulls_and_odd_labels_are_errors(spark):
    _, _, df = _frame(spark, 40)
    gap = df.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    for tr, te in ((gap, df), (df, gap), (df.withColumn("a", F.when(F.col("id") == 3, math.inf).otherwise(F.col("a"))), df)):
        with pytest.raises(Exception, match="null"):
            models.fit_predict(tr, te, ["a", "b"], "y", "SVM Classifier", "classification", {}).collect()
    for odd in (F.col("y") + 1, F.col("y") / 2):
        with pytest.raises(ValueError, match="label"):
            models.fit_predict(df.withColumn("y", odd), df, ["a", "b"], "y", "SVM Classifier", "classification", {})
