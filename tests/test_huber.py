"""Newton steps of the Huber regression against Spark's own optimiser and in their number."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera.ml import models


def _frame(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, 2))
    y = 40 * np.sin(x[:, 0]) + 10 * x[:, 1] + rng.normal(0, 3, n)
    y[::11] += 300                                            # outliers, beyond the quadratic part
    return spark.createDataFrame([(i, *map(float, a), float(t)) for i, (a, t) in enumerate(zip(x, y))], "id long, a double, b double, y double")


@pytest.mark.parametrize("c", [0.1, 10.0])
def test_equals_spark_huber_in_few_jobs(spark, c):
    df, sc = _frame(spark).cache(), spark.sparkContext
    n, gamma = df.count(), 0.5
    cols = models.fourier_features(["a", "b"], gamma)
    wide = VectorAssembler(inputCols=[f"_rff{i}" for i in range(100)], outputCol="features").transform(df.select("*", *cols)).cache()
    est = LinearRegression(loss="huber", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=3000, tol=1e-12, labelCol="y")
    want = {r.id: r.prediction for r in est.fit(wide).transform(wide).select("id", "prediction").collect()}
    sc.setJobGroup(f"huber{c}", "fit")
    pred = models.fit_predict(df, df, ["a", "b"], "y", "SVM Regressor", "regression", {"kernel": "rbf", "gamma": gamma, "C": c})
    got = {r.id: r.prediction for r in pred.select("id", "prediction").collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"huber{c}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert np.abs(np.array([got[i] - want[i] for i in want])).max() < 0.02
    assert jobs <= 60                                         # passes do not run into the hundreds


def test_constant_label_and_nulls(spark):
    df = _frame(spark, 40)
    flat = df.withColumn("y", F.lit(7.0))
    assert {r.prediction for r in models.fit_predict(flat, flat, ["a"], "y", "SVM Regressor", "regression", {}).collect()} == {7.0}
    gap = df.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    for tr, te in ((gap, df), (df, gap)):
        with pytest.raises(Exception, match="null"):
            models.fit_predict(tr, te, ["a", "b"], "y", "SVM Regressor", "regression", {}).collect()
