"""Preprocessing and OLAP fixtures (FIXTURES A6, A7) and sources."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.quantiles import quantiles
from tessera.operators import missing, olap, outliers, profile, variance
from tessera.sources import files


def test_iqr_fixture(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 100]], "X double")
    b = outliers.bounds(df, "X", "iqr", k=1.5)
    assert (b.lower, b.upper) == (pytest.approx(-36.5), pytest.approx(65.5))
    capped, rep = outliers.treat(df, ["X"], "iqr", "cap")
    assert max(r.X for r in capped.collect()) == pytest.approx(65.5)
    assert rep[0]["n_outliers"] == 1


def test_exact_quantiles_band_path(spark):
    """Force the banded path (tiny band) and compare with numpy."""
    import numpy as np
    vals = [float((i * 7919) % 1009) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = quantiles(df, "v", probs, accuracy=100, max_band=50)
    assert got == pytest.approx(list(np.quantile(vals, probs)), abs=1e-9)


def test_variance_fixture(spark):
    rows = list(zip([1.0, 2.0, 3.0, 4.0], [10.0] * 4, [5.0, 15.0, 10.0, 20.0]))
    df = spark.createDataFrame(rows, "X1 double, X2 double, X3 double")
    s = {r.feature: r for r in variance.variance_summary(df).collect()}
    assert s["X1"].variance == pytest.approx(1.6667, abs=1e-4)
    assert s["X2"].variance == 0 and s["X2"].cv == 0
    assert s["X3"].variance == pytest.approx(41.6667, abs=1e-4)
    assert s["X1"].cv == pytest.approx(0.5164, abs=1e-4) and s["X3"].cv == pytest.approx(0.5164, abs=1e-4)
    m = {(r.feature_1, r.feature_2): r.correlation for r in variance.correlation_matrix(df, ["X1", "X2", "X3"]).collect()}
    assert m[("X1", "X3")] == pytest.approx(0.8)
    assert m[("X1", "X2")] is None and m[("X2", "X2")] is None and m[("X1", "X1")] == 1.0


def test_missing_fixtures(spark):
    num = spark.createDataFrame([(1.0, 10.0, 100.0), (2.0, None, 105.0), (None, 20.0, 110.0),
                                 (4.0, 25.0, None), (5.0, 20.0, 115.0)], "A double, B double, C double")
    _, means = missing.fill_statistic(num, "mean")
    assert means == {"A": 3.0, "B": 18.75, "C": 107.5}
    _, meds = missing.fill_statistic(num, "median")
    assert meds == {"A": 3.0, "B": 20.0, "C": 107.5}
    cat = spark.createDataFrame([("Red", "a"), ("Blue", "b"), (None, "a"), ("Red", "c")], "Color string, Type string")
    filled, vals = missing.fill_categorical_mode(cat)
    assert vals == {"Color": "Red"} and filled.where("Color IS NULL").count() == 0
    mixed = spark.createDataFrame([(1, None, 1.0, 2.0), (2, "x", None, 3.0), (3, "y", 3.0, None),
                                   (4, "z", 4.0, 5.0), (5, "w", 5.0, 6.0)],
                                  "ID int, Category string, Value double, Score double")
    assert sorted(r.ID for r in missing.drop_missing(mixed).collect()) == [4, 5]


def test_mode_rule_discrete(spark):
    rows = [(float(i % 3) if i % 10 else None,) for i in range(200)]
    df = spark.createDataFrame(rows, "d double")
    _, vals = missing.fill_statistic(df, "mode")
    assert vals["d"] == 0.0   # 0, 1 and 2 occur 60 times each: ties go to the smallest value


def test_profile_and_totals(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, float("nan")), (2, None, float("nan")), (3, "b", None)],
                               "id int, s string, x double")
    t = profile.dataset_totals(df).first()
    assert (t.n_rows, t.n_columns, t.missing_cells, t.duplicate_rows) == (4, 3, 5, 1)
    p = {r.column: r for r in profile.column_profile(df, "id").collect()}
    assert p["x"].missing == 3 and p["s"].unique == 2 and p["id"].example == "1"


SAMPLE_SALES = [(101, 302, 5, 50.0), (101, 302, 10, 200.0), (102, 301, 10, 300.0), (103, 301, 5, 100.0)]


def test_cubes_fixture(spark):
    df = spark.createDataFrame(SAMPLE_SALES, "item_id int, storeid int, quantity int, amount double")
    cubes = olap.data_cubes(df, ["item_id", "storeid"], ["quantity", "amount"], money_scale=2)
    got = {(r.cube, r.item_id, r.storeid): (r.quantity, r.amount) for r in cubes.collect()}
    assert got[("item_id", 101, None)] == (15, 250) and got[("item_id", 102, None)] == (10, 300)
    assert got[("storeid", None, 302)] == (15, 250) and got[("storeid", None, 301)] == (15, 400)
    assert got[("item_id × storeid", 103, 301)] == (5, 100)
    assert len(got) == 3 + 2 + 3


def test_cube_null_keys_dropped(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, "x", 3.0)], "a int, b string, m double")
    got = {(r.cube, r.a, r.b): r.m for r in olap.data_cubes(df, ["a", "b"], ["m"]).collect()}
    assert got == {("a", 1, None): 5.0, ("b", None, "x"): 3.0, ("a × b", 1, "x"): 3.0}


def test_drilldown_rejects_duplicate_keys(spark):
    fact = spark.createDataFrame([(1, 2.0)], "k int, m double")
    dim = spark.createDataFrame([(1, "r1", "n1"), (1, "r2", "n1")], "k int, r string, n string")
    with pytest.raises(ValueError):
        olap.olap_levels(fact, dim, "k", ["r", "n"], 1, ["m"])


def test_cube_batches_sink(spark, tmp_path):
    df = spark.createDataFrame(SAMPLE_SALES, "item_id int, storeid int, quantity int, amount double")
    b = olap.cube_batches(olap.data_cubes(df, ["item_id", "storeid"], ["quantity", "amount"]), 2)
    assert {(r.cube_no, r.batch) for r in b.select("cube_no", "batch").distinct().collect()} == {(1, 1), (2, 1), (3, 2)}
    olap.write_cube_batches(b, str(tmp_path / "export"))
    assert (tmp_path / "export" / "batch=2" / "cube_file=cube_item_id_storeid").exists()


def test_csv_bom_source_and_text(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_text("﻿a,b\n1,x\n2,y\n", encoding="utf-8")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "int"
    d = tmp_path / "docs"
    d.mkdir()
    (d / "one.txt").write_text("line one\nline two")
    docs = files.read_text_documents(spark, str(d)).collect()
    assert len(docs) == 1 and docs[0].text == "line one\nline two"
