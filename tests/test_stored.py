"""Cut lineage is stored in columns; level queries mine up to their level; model inputs are stored."""

from pyspark.sql import functions as F

from tessera.operators import sequences
from tessera.plans import ml
from tessera.plans.sequences import GSP_SUPPORT, gsp_l1, gsp_vertical
from tessera.session import cut_lineage

SF001 = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_cut_lineage_is_columnar_and_keeps_rows(spark):
    df = spark.sql("SELECT id, struct(id AS a, array('x', NULL) AS b) AS s, map('k', id) AS m, "
                   "CAST(NULL AS double) AS d, decimal(id) AS e FROM range(5)")
    cut = cut_lineage(df)
    assert "Scan parquet" in _plan(cut) and cut.columns == df.columns and cut.dtypes == df.dtypes
    assert sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
    assert "Exchange" not in _plan(cut_lineage(df.groupBy((F.col("id") % 2).alias("g")).count()))


def test_columns_that_parquet_lacks_are_still_cut(spark):
    void = cut_lineage(spark.sql("SELECT id, NULL AS nothing FROM range(3)"))
    assert sorted(r["id"] for r in void.collect()) == [0, 1, 2] and void.first()["nothing"] is None
    twice = cut_lineage(spark.sql("SELECT id AS a, id + 1 AS A FROM range(3)"))
    assert sorted(map(tuple, twice.collect())) == [(0, 1), (1, 2), (2, 3)]


def test_one_level_equals_that_level_of_all(spark, monkeypatch):
    whole = sequences.mine_sequences(gsp_vertical(spark, SF001), GSP_SUPPORT)
    asked = []
    real = sequences.mine_sequences
    monkeypatch.setattr(sequences, "mine_sequences", lambda v, s, n=None: asked.append(n) or real(v, s, n))
    want = sequences.pattern_table(whole.frequent).where("elements = 1").collect()
    assert sorted(map(str, gsp_l1(spark, SF001).collect())) == sorted(map(str, want))
    assert asked == [1]


def test_model_input_is_read_from_store(spark):
    train, test, _, _ = ml._reference_flow(spark, SF001, "classification")
    assert "Window" not in _plan(train) and "Exchange" not in _plan(test)
