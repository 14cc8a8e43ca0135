"""Forests on binned rows: the same trees as on rows, and a number of passes that the trees do not raise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.ml import forest, models


def _frame(spark, n, classes):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, n), rng.uniform(0, 4, n).round(1)
    y = (a > 0.2).astype(float) + (b > 2) if classes else np.sin(a) * 3 + b + rng.normal(0, 0.3, n)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, y))], "id long, a double, b double, y double")


def test_split_points():
    assert forest.split_points([1, 1, 2, 4]) == [1.5, 3.0]
    assert forest.split_points([5, 5]) == []
    cut = forest.split_points(list(range(1000)), 4)
    assert len(cut) == 3 and np.abs(np.array(cut) - [249.5, 499.5, 749.5]).max() <= 1
    heavy = forest.split_points([0.0] * 500 + list(range(1, 501)), 10)     # a common value leaves the other bins to the rest
    assert len(heavy) >= 8


@pytest.mark.parametrize("classes", [False, True])
def test_tree_on_weighted_cells_equals_tree_on_drawn_rows(spark, classes):
    """Each bag, given to Spark as repeated rows, makes the tree that the cells make."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler
    df, names = _frame(spark, 600, classes), ["a", "b"]
    cuts = forest.bins_of(df, names, 8)
    rows = forest.with_cell(df, names, cuts).select(F.col("_cell").alias("cell"), "y").cache()
    n_cells = int(np.prod([len(c) + 1 for c in cuts]))
    got = (forest._drawn_classes if classes else forest._drawn_values)(rows, n_cells, 2, 3).where("tree = 0").cache()
    # draws are about as many as rows, and their labels those of the cell
    drawn = got.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).first()
    want = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    assert drawn.w == pytest.approx(want.n, rel=0.2) and drawn.wy == pytest.approx(want.y, rel=0.25)
    kind = C.RandomForestClassifier if classes else R.RandomForestRegressor
    cells = forest._features_of(spark.range(n_cells).select(F.col("id").cast("int").alias("cell")), cuts)

    def tree(d, **kw):
        est = kind(numTrees=1, bootstrap=False, maxDepth=5, featureSubsetStrategy="all", seed=1, labelCol="y", **kw)
        return {r.cell: r.prediction for r in est.fit(d).transform(cells).select("cell", "prediction").collect()}
    by_cell = tree(forest._features_of(got, cuts), weightCol="w")
    by_row = tree(forest._features_of(got.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("w").cast("int")))).drop("_"), cuts))
    assert by_cell == pytest.approx(by_row, abs=1e-6)
    # the mean label of a cell stands for its rows: equal trees from the rows themselves
    if not classes:
        mean = rows.groupBy("cell").agg(F.count("*").cast("double").alias("w"), F.avg("y").alias("y"))
        assert tree(forest._features_of(mean, cuts), weightCol="w") == pytest.approx(tree(forest._features_of(rows, cuts)), abs=1e-6)


@pytest.mark.parametrize("problem,model", [("regression", "Random Forest"), ("classification", "Random Forest")])
def test_forest_predicts_like_the_forest_on_rows(spark, problem, model, monkeypatch):
    df, names = _frame(spark, 800, problem == "classification"), ["a", "b"]
    tr, te = df.where("id % 4 > 0"), df.where("id % 4 = 0")

    def score():
        p = models.fit_predict(tr, te, names, "y", model, problem, {"n_estimators": 12, "max_depth": 6}).select("id", "y", "prediction")
        p = p.toPandas()
        assert len(p) == 200 and p.id.is_unique
        return (p.y == p.prediction).mean() if problem == "classification" else 1 - ((p.y - p.prediction) ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum()
    binned = score()
    monkeypatch.setattr(forest, "MAX_SUMS", 0)
    assert binned == pytest.approx(score(), abs=0.04) and binned > 0.9


def test_rows_are_not_read_once_a_level(spark):
    """Rows read by the query grow with the rows, not with trees and levels."""
    sc, df = spark.sparkContext, _frame(spark, 300, True)
    read = sc.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b
    tr = df.mapInPandas(count, df.schema)
    forest.forest(tr, df, ["a", "b"], "y", "classification", 6, 8, "sqrt").count()
    assert read.value <= 6 * 300


def test_nulls_are_errors(spark):
    df = _frame(spark, 60, False)
    for bad in (df.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), df.withColumn("y", F.when(F.col("id") != 5, F.col("y")))):
        with pytest.raises(Exception, match="null"):
            models.fit_predict(bad, df, ["a", "b"], "y", "Random Forest", "regression", {"n_estimators": 2}).count()
    with pytest.raises(Exception, match="null"):
        models.fit_predict(df, df.withColumn("b", F.when(F.col("id") != 5, F.col("b"))), ["a", "b"], "y", "Random Forest", "regression",
                           {"n_estimators": 2}).select("prediction").collect()
