"""Model registry: every supervised model of the comparison, as a Spark ML
estimator (or a small driver loop of distributed fits), trained on a
feature list and scored on a test frame.

Parameter mappings to the usual single-machine objectives:
* Ridge(alpha): ``LinearRegression(elasticNetParam=0, standardization=False,
  solver="normal", regParam=alpha * stddev_pop(y) / n)``.
* Lasso(alpha): ``elasticNetParam=1, standardization=False, regParam=alpha``.
* LogisticRegression(C): ``regParam = 1 / (C * n)``, no standardisation.
* Kernel SVMs are re-aimed: an explicit feature map (random Fourier features
  for ``rbf``, degree-3 polynomial expansion for ``poly``, identity for
  ``linear``) followed by a linear model (Huber regression / hinge loss,
  one-vs-rest beyond two classes).  This approximates the kernel machine.
* AdaBoost.R2 (linear loss): boosting rounds of depth-3 weighted trees
  (instance weights instead of weighted resampling), weighted-median combine.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.ml import hinge, huber
from tessera.ml.forest import forest
from tessera.session import cut_lineage


def _depth(max_depth: int) -> int:
    """Spark's trees go to depth 30; a deeper request is refused, not cut."""
    if max_depth > 30:
        raise ValueError(f"max_depth {max_depth} is above the limit of 30")
    return max_depth


def _assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


# ------------------------------------------------------------------ kernel feature maps
def fourier_weights(n_features: int, gamma: float, dim: int = 100, seed: int = 42) -> tuple[list[list[float]], list[float]]:
    """w ~ N(0, 2 gamma) and b ~ U(0, 2 pi) of the random Fourier features."""
    rng = random.Random(seed)
    scale = math.sqrt(2.0 * gamma)
    w, b = [], []
    for _ in range(dim):
        w.append([rng.gauss(0.0, 1.0) * scale for _ in range(n_features)])
        b.append(rng.uniform(0.0, 2.0 * math.pi))
    return w, b


def fourier_features(features: list[str], gamma: float, dim: int = 100, seed: int = 42) -> list[Column]:
    """Random Fourier features approximating exp(-gamma ||x - y||^2):
    sqrt(2/D) cos(w.x + b), w ~ N(0, 2 gamma), b ~ U(0, 2 pi) (literal
    coefficients, so the map is a plain Column expression)."""
    cols = []
    for i, (w, b) in enumerate(zip(*fourier_weights(len(features), gamma, dim, seed))):
        dot = sum((F.col(f) * F.lit(wj) for f, wj in zip(features, w)), F.lit(b))
        cols.append((F.lit(math.sqrt(2.0 / dim)) * F.cos(dot)).alias(f"_rff{i}"))
    return cols


def _scale_gamma(train: DataFrame, features: list[str]) -> float:
    """'scale': 1 / (n_features * var(X))"""
    v = train.select(F.explode(F.array(*[F.col(f).cast("double") for f in features])).alias("v")) \
        .agg(F.var_pop("v")).first()[0] or 1.0
    return 1.0 / (len(features) * v)


def _kernel_map(train: DataFrame, test: DataFrame, features: list[str], kernel: str,
                gamma: float | None, degree: int = 3):
    """Apply the feature map; returns (train, test, mapped feature names)."""
    if kernel == "linear":
        return train, test, features
    if kernel == "poly":
        from pyspark.ml.feature import PolynomialExpansion
        tr = _assemble(train, features, "_raw")
        te = _assemble(test, features, "_raw")
        pe = PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="_poly")
        return pe.transform(tr).drop("_raw"), pe.transform(te).drop("_raw"), ["_poly"]
    if gamma is None:
        gamma = _scale_gamma(train, features)
    cols = fourier_features(features, gamma)
    return (train.select("*", *cols), test.select("*", *cols), [f"_rff{i}" for i in range(len(cols))])


# ------------------------------------------------------------------ AdaBoost.R2
def adaboost_r2(train: DataFrame, test: DataFrame, features: list[str], label: str,
                n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 3,
                seed: int = 42) -> DataFrame:
    """AdaBoost.R2 with linear loss; returns ``test`` with ``prediction``."""
    from pyspark.ml.regression import DecisionTreeRegressor

    # weights are kept at mean 1 (sum n): tree split checks read weighted counts
    n = train.count()
    tr = _assemble(train, features).withColumn("_w", F.lit(1.0))
    tr = cut_lineage(tr)
    te = _assemble(test, features)
    models, weights = [], []
    for i in range(n_estimators):
        dt = DecisionTreeRegressor(featuresCol="features", labelCol=label, weightCol="_w",
                                   maxDepth=max_depth, seed=seed + i, predictionCol="_p")
        m = dt.fit(tr)
        scored = m.transform(tr).withColumn("_e", F.abs(F.col("_p") - F.col(label)))
        emax = scored.agg(F.max("_e")).first()[0] or 0.0
        if emax <= 0:
            models.append(m)
            weights.append(1.0)
            break
        scored = scored.withColumn("_e", F.col("_e") / F.lit(emax))
        err = scored.agg(F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).first()[0]
        if err >= 0.5:
            if not models:
                models.append(m)
                weights.append(1.0)
            break
        beta = err / (1.0 - err)
        models.append(m)
        weights.append(learning_rate * math.log(1.0 / beta) if beta > 0 else 1.0)
        if beta <= 0:
            break
        upd = scored.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), (1 - F.col("_e")) * learning_rate))
        total = upd.agg(F.sum("_w")).first()[0]
        tr = cut_lineage(upd.withColumn("_w", F.col("_w") * F.lit(n / total)).drop("_p", "_e"))
    preds = te
    for i, m in enumerate(models):
        preds = m.setPredictionCol(f"_p{i}").transform(preds)
    pairs = F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(w).alias("w"))
                      for i, w in enumerate(weights)])
    ordered = F.array_sort(pairs)
    half = F.lit(sum(weights) / 2.0)
    # weighted median: first prediction whose cumulative weight reaches half the total
    cum = F.aggregate(ordered, F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("v")),
                      lambda s, e: F.struct((s["acc"] + e["w"]).alias("acc"),
                                            F.when(s["v"].isNull() & (s["acc"] + e["w"] >= half), e["p"])
                                            .otherwise(s["v"]).alias("v")))
    return preds.withColumn("prediction", cum["v"]).drop(*[f"_p{i}" for i in range(len(models))])


# ------------------------------------------------------------------ registry
def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str,
                model: str, problem: str, params: dict | None = None) -> DataFrame:
    """Fit ``model`` on ``train`` and return ``test`` with a ``prediction``."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    p = dict(params or {})
    n = train.count()
    if problem == "regression":
        if model == "AdaBoost":
            return adaboost_r2(train, test, features, label, p.get("n_estimators", 50),
                               p.get("learning_rate", 1.0))
        if model == "SVM Regressor":
            c = p.get("C", 1.0)
            if p.get("kernel", "rbf") == "rbf":
                gamma = p.get("gamma")
                w, b = map(np.array, fourier_weights(len(features), _scale_gamma(train, features) if gamma is None else gamma))
                theta = huber.fit(train, n, features, label, w, b, 1.0 / (c * n))
                return huber.predict(test, features, theta, w, b)
            tr, te, feats = _kernel_map(train, test, features, p.get("kernel", "rbf"), p.get("gamma"))
            # 100 iterations, the default, can stop far from the optimum
            est = R.LinearRegression(loss="huber", regParam=1.0 / (c * n), elasticNetParam=0.0,
                                     standardization=False, maxIter=1000, tol=1e-9)
            tr, te = _assemble(tr, feats), _assemble(te, feats)
            return est.setLabelCol(label).fit(tr).transform(te)
        if model == "Linear Regression":
            est = R.LinearRegression(solver="normal", regParam=0.0)
        elif model == "Ridge":
            std_y = train.agg(F.stddev_pop(label)).first()[0] or 1.0
            est = R.LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False,
                                     regParam=p.get("alpha", 1.0) * std_y / n)
        elif model == "Lasso":
            est = R.LinearRegression(elasticNetParam=1.0, standardization=False,
                                     regParam=p.get("alpha", 1.0), maxIter=1000, tol=1e-8)
        elif model == "Decision Tree Regressor":
            est = R.DecisionTreeRegressor(maxDepth=_depth(p.get("max_depth", 30)), seed=42)
        elif model == "Random Forest":
            trees, depth = p.get("n_estimators", 100), _depth(p.get("max_depth") or 30)
            out = forest(train, test, features, label, problem, trees, depth, "all")
            if out is not None:
                return out
            est = R.RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=42)
        else:
            raise ValueError(f"unknown regression model {model!r}")
    elif problem == "classification":
        if model == "SVM Classifier":
            c = p.get("C", 1.0)
            if p.get("kernel", "rbf") == "rbf":
                gamma = p.get("gamma")
                w, b = map(np.array, fourier_weights(len(features), _scale_gamma(train, features) if gamma is None else gamma))
                theta = hinge.fit(train, n, features, label, w, b, 1.0 / (c * n))
                return hinge.predict(test, features, theta, w, b)
            tr, te, feats = _kernel_map(train, test, features, p.get("kernel", "rbf"), p.get("gamma"))
            svc = C.LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=200)
            k = train.select(label).distinct().count()
            est = C.OneVsRest(classifier=svc) if k > 2 else svc
            tr, te = _assemble(tr, feats), _assemble(te, feats)
            return est.setLabelCol(label).fit(tr).transform(te)
        if model == "Logistic Regression":
            est = C.LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * n), elasticNetParam=0.0,
                                       standardization=False, maxIter=200, tol=1e-10)
        elif model == "Decision Tree Classifier":
            est = C.DecisionTreeClassifier(maxDepth=_depth(p.get("max_depth", 30)), seed=42)
        elif model == "Random Forest":
            trees, depth = p.get("n_estimators", 100), _depth(p.get("max_depth") or 30)
            out = forest(train, test, features, label, problem, trees, depth, "sqrt")
            if out is not None:
                return out
            est = C.RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=42)
        elif model == "Naive Bayes":
            est = C.NaiveBayes(modelType="gaussian")
        else:
            raise ValueError(f"unknown classification model {model!r}")
    else:
        raise ValueError(f"unknown problem type {problem!r}")
    est = est.setLabelCol(label).setFeaturesCol("features")
    return est.fit(_assemble(train, features)).transform(_assemble(test, features))
