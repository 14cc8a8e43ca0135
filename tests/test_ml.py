"""ML and clustering operators against numpy brute force / closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.ml import clustering, metrics, models, prepare


def _brute_dbscan(X, eps, min_samples):
    n = len(X)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = [np.where(d[i] <= eps)[0] for i in range(n)]
    core = [len(nb[i]) >= min_samples for i in range(n)]
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i
    for i in range(n):
        if core[i]:
            for j in nb[i]:
                if core[j]:
                    a, b = find(i), find(j)
                    comp[max(a, b)] = min(a, b)
    lab = {}
    for i in range(n):
        if core[i]:
            lab[i] = find(i)
    for i in range(n):
        if not core[i]:
            cs = [lab[j] for j in nb[i] if core[j]]
            if cs:
                lab[i] = min(cs)
    order = {c: k for k, c in enumerate(sorted(set(lab.values())))}
    return [order[lab[i]] if i in lab else -1 for i in range(n)]


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(3, 0.3, (40, 2)), rng.uniform(-2, 5, (20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, x double, y double")
    got = {r.id: r.cluster for r in clustering.dbscan(df, "id", ["x", "y"], 0.5, 5).collect()}
    assert [got[i] for i in range(len(X))] == _brute_dbscan(X, 0.5, 5)


def _check_dbscan(spark, X, eps, min_samples):
    names = [f"f{i}" for i in range(X.shape[1])]
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in names))
    got = {r.id: r.cluster for r in clustering.dbscan(df, "id", names, eps, min_samples).collect()}
    assert [got[i] for i in range(len(X))] == _brute_dbscan(X, eps, min_samples)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    core = {r.id: r.core for r in clustering.core_points(df, "id", names, eps, min_samples).collect()}
    assert [core[i] for i in range(len(X))] == [bool((row <= eps).sum() >= min_samples) for row in d]


@pytest.mark.parametrize("case", ["line", "ladder", "copies", "moons", "three", "five", "tiny"])
def test_dbscan_without_pairs_on_hard_shapes(spark, monkeypatch, case):
    """Distances of exactly eps, repeated points, full cells facing each other at
    just under and just over eps, more dimensions, cells dealt out to many tasks."""
    monkeypatch.setattr(clustering, "CELL_ROWS", 7)
    rng = np.random.default_rng(11)
    if case == "line":
        _check_dbscan(spark, np.array([[i] for i in [*range(20), 22, 23, 24, 27, 27, 27, 27]], float), 1.0, 3)
    elif case == "ladder":
        _check_dbscan(spark, np.array([[i * 0.5, j] for i in range(12) for j in (0, 1, 2.5)], float), 1.0, 4)
    elif case == "copies":
        X = np.repeat(np.array([[0, 0], [0.5, 0], [0.999999, 0], [2.0, 0], [3.0000001, 0]]), [40, 1, 9, 30, 12], axis=0)
        _check_dbscan(spark, X, 1.0, 5)
    elif case == "moons":
        t = rng.uniform(0, np.pi, 150)
        X = np.vstack([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]]) + rng.normal(0, 0.05, (300, 2))
        for eps in (0.08, 0.2, 0.31):
            _check_dbscan(spark, X, eps, 5)
    elif case == "three":
        _check_dbscan(spark, np.vstack([rng.normal(0, 1, (90, 3)), rng.normal(4, 0.4, (90, 3))]), 0.9, 6)
    elif case == "five":
        _check_dbscan(spark, np.vstack([rng.normal(0, 1, (70, 5)), rng.normal(3, 0.5, (70, 5))]), 1.7, 5)
    else:
        _check_dbscan(spark, np.vstack([rng.uniform(-1e-9, 1e-9, (40, 2)), rng.uniform(1e6, 1e6 + 1e-3, (40, 2))]), 3e-10, 4)


def test_dbscan_edges(spark):
    kind = "id long, x double, y double"
    assert clustering.dbscan(spark.createDataFrame([], kind), "id", ["x", "y"], 1.0, 2).count() == 0
    rows = [(1, 0.0, 0.0), (2, 0.0, -0.0), (3, None, 0.0), (4, math.nan, 0.0), (5, math.inf, 0.0), (6, 50.0, 0.0)]
    got = {r.id: r.cluster for r in clustering.dbscan(spark.createDataFrame(rows, kind), "id", ["x", "y"], 1.0, 2).collect()}
    assert got == {1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: -1}


def test_squared_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(0, 1, (60, 2))
    lab = (X[:, 0] > 0).astype(int) + (X[:, 1] > 1).astype(int)
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    df = spark.createDataFrame([(int(c), float(x), float(y)) for c, (x, y) in zip(lab, X)], "cluster long, x double, y double")
    got = clustering.squared_silhouette(df, ["x", "y"]).first()
    assert got.silhouette == pytest.approx(float(np.mean(s)), abs=1e-9)
    assert got.n_clusters == len(set(lab))


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(0, 1, (50, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "id long, a double, b double, c double")
    out = prepare.pca(df, ["a", "b", "c"], 2).orderBy("id").collect()
    Xc = X - X.mean(0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    for j in range(2):
        v = vt[j] * (1 if vt[j][np.abs(vt[j]).argmax()] > 0 else -1)
        proj = Xc @ v
        assert [r[f"pc{j + 1}"] for r in out] == pytest.approx(list(proj), abs=1e-6)


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(0, 1, (80, 2))
    y = X @ np.array([1.5, -2.0]) + 0.7 + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(X, y)], "a double, b double, y double")
    alpha = 3.0
    pred = models.fit_predict(df, df, ["a", "b"], "y", "Ridge", "regression", {"alpha": alpha}).collect()
    Xm, ym = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xm.T @ Xm + alpha * np.eye(2), Xm.T @ ym)
    b0 = y.mean() - X.mean(0) @ w
    assert [r.prediction for r in pred] == pytest.approx(list(X @ w + b0), abs=1e-6)


def test_classification_metrics_weighted(spark):
    y = [0, 0, 1, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 2, 0, 2]
    df = spark.createDataFrame(list(zip(y, p)), "label long, prediction long")
    m = metrics.classification_metrics(df).first()
    # per class: precision 1/2, 2/3, 1; recall 1/2, 1, 2/3; supports 2, 2, 3
    prec = (2 * 0.5 + 2 * (2 / 3) + 3 * 1) / 7
    rec = (2 * 0.5 + 2 * 1 + 3 * (2 / 3)) / 7
    f1s = [2 * a * b / (a + b) for a, b in [(0.5, 0.5), (2 / 3, 1), (1, 2 / 3)]]
    assert m.accuracy == pytest.approx(5 / 7)
    assert m.precision == pytest.approx(prec)
    assert m.recall == pytest.approx(rec)
    assert m.f1 == pytest.approx((2 * f1s[0] + 2 * f1s[1] + 3 * f1s[2]) / 7)


def test_metrics_long_drops_non_numeric(spark):
    wide = spark.createDataFrame([("DBSCAN", "N/A", "3"), ("Spectral", "0.41", "2")],
                                 "model string, silhouette string, n_clusters string")
    rows = {(r.model, r.metric): r.score for r in metrics.metrics_long(wide).collect()}
    assert rows == {("DBSCAN", "n_clusters"): 3.0, ("Spectral", "silhouette"): 0.41,
                    ("Spectral", "n_clusters"): 2.0}


def test_prepare_fixture(spark):
    """numeric_missing fixture: means 3.0 / 18.75 / 107.5 fill the gaps."""
    rows = [(1.0, 10.0, 100.0), (2.0, None, 105.0), (None, 20.0, 110.0), (4.0, 25.0, None), (5.0, 20.0, 115.0)]
    df = spark.createDataFrame(rows, "A double, B double, C double")
    out = prepare.prepare(df).collect()
    a = sorted(r.A for r in out)
    assert a == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])   # 3.0 fills -> (3-1)/4
    b = sorted(r.B for r in out)
    assert (18.75 - 10) / 15 in [pytest.approx(x) for x in b]


def test_problem_type(spark):
    df = spark.createDataFrame([(i, float(i) * 1.5, "a" if i % 2 else "b", i % 3) for i in range(30)],
                               "i long, x double, s string, k long")
    assert prepare.problem_type(df, None) == "clustering"
    assert prepare.problem_type(df, "s") == "classification"
    assert prepare.problem_type(df, "k") == "classification"
    assert prepare.problem_type(df, "x") == "regression"


def test_adaboost_runs_and_fits(spark):
    rows = [(float(i), float((i / 12.0) ** 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, y double")
    pred = models.adaboost_r2(df, df, ["x"], "y", n_estimators=5)
    m = metrics.regression_metrics(pred, "y", "prediction").first()
    assert m.r2 > 0.95


def test_knn_affinity(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 0.0), (1, 2, 0.1), (1, 3, 0.2), (2, 1, 0.1), (2, 2, 0.0), (2, 3, 0.05),
         (3, 1, 0.2), (3, 2, 0.05), (3, 3, 0.0)], "a long, b long, dist double")
    got = {(r.src, r.dst): r.weight for r in clustering.knn_affinity(pairs, 1).collect()}
    # nearest of 1 is 2; of 2 is 3; of 3 is 2 -> (1,2) once, (2,3) from both sides
    assert got == {(1, 2): 0.5, (2, 3): 1.0}


def test_nearest_pairs_of_sparse_points(spark):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.normal(0, 0.05, (40, 2)), rng.uniform(-30, 30, (12, 2)), [[400.0, -400.0]] * 2])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(99, None, 1.0)], "id long, x1 double, x2 double")
    got = {}
    for r in clustering.nearest_pairs(pts, "id", ["x1", "x2"], 5, 0.1).collect():
        got.setdefault(r.a, set()).add(r.b)
    dist = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    want = {i: set(sorted((j for j in range(len(xy)) if j != i), key=lambda j: (dist[i, j], j))[:5]) for i in range(len(xy))}
    assert got == want
    assert clustering.nearest_pairs(pts.limit(1), "id", ["x1", "x2"], 5, 0.1).count() == 0
    assert {r.a for r in clustering.nearest_pairs(pts.limit(3), "id", ["x1", "x2"], 5, 0.1).collect()} == {0, 1, 2}


def test_spectral_labels_every_row(spark):
    from conftest import SF001
    from tessera.plans.clustering import spectral
    got = spectral(spark, SF001)
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert got.count() == n and got.where("cluster is null").count() == 0 and got.distinct().count() == n
