"""Work that must not be cut: streams, components, depths, ties, null runs, big keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import exact_sum
from tessera.functions.quantiles import median, quantiles, quantiles_of
from tessera.ml import clustering, models, prepare
from tessera.operators import forecast, missing, outliers, smoothing, text
from tessera.plans.prep import sample_order
from tessera.streaming.sources import run_available_now, table_stream

SF001 = "/root/testdata/sf0.001"


def test_directory_table_streams_in_full(spark, tmp_path):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "t/events.parquet"))
    for root in (str(tmp_path / "t"), SF001):
        src, out = table_stream(spark, root, "events", events.schema), str(tmp_path / f"out{len(root)}")
        run_available_now(src.writeStream.format("parquet").option("path", out)
                          .option("checkpointLocation", out + "-c"))
        assert spark.read.parquet(out).count() == events.count()


def test_stream_failure_is_raised(spark, tmp_path):
    src = table_stream(spark, SF001, "events", spark.read.parquet(f"{SF001}/events.parquet").schema)

    def fail(batch, batch_id):
        raise ValueError("stop here")

    with pytest.raises(Exception, match="stop here"):
        run_available_now(src.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "c")))


def test_sample_covers_all_ids(spark):
    got = [r["id"] for r in spark.range(200_000).orderBy(*sample_order("id")).limit(1000).collect()]
    assert len(set(got)) == 1000 and all(60 < sum(k * 20_000 <= i < (k + 1) * 20_000 for i in got) < 145 for k in range(10))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = clustering.connected_components(edges, spark.range(302).select(F.col("id").alias("node"))).collect()
    assert {r["node"]: r["comp"] for r in got} == {**{i: 0 for i in range(301)}, 301: 301}


def test_silhouette_in_blocks_of_clusters(spark):
    rnd = random.Random(1)
    rows = [(float(c * 3 + rnd.random()), rnd.random(), c) for c in range(7) for _ in range(6)] + [(99.0, 99.0, 7)]
    df = spark.createDataFrame(rows, "x double, y double, cluster int")
    whole = clustering.squared_silhouette(df, ["x", "y"]).first()
    blocks = clustering.squared_silhouette(df, ["x", "y"], block=3).first()
    assert whole["n_clusters"] == blocks["n_clusters"] == 8
    assert whole["silhouette"] == pytest.approx(blocks["silhouette"], abs=1e-12)


def test_depth_above_the_limit_is_refused(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        models.fit_predict(df, df, ["x"], "y", "Decision Tree Regressor", "regression", {"max_depth": 31})


def test_quantiles_of_heavy_ties(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0).alias("x"))
    assert median(df, "x") == 0.5
    vals = [0.0] * 9000 + [1.0] * 9000 + np.linspace(2, 3, 2000).tolist() + [float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.2, 0.45, 0.5, 0.9, 0.95, 1.0]
    assert quantiles(df, "x", probs, max_band=100) == pytest.approx(list(np.quantile(vals[:-1], probs)))


def test_ewma_carries_over_a_long_null_run(spark):
    x = [1.0, 4.0, 2.0] + [None] * 200 + [7.0, None, 3.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, *x])], "s long, t long, v double")
    got = [r["v_smoothed"] for r in smoothing.ewm_mean(df, ["s"], ["t"], ["v"], 5, block_rows=50).orderBy("t").collect()]
    want = pd.Series([None, *x], dtype=float).ewm(span=5).mean()
    assert got[0] is None and got[1:] == pytest.approx(want.tolist()[1:])


def test_gaussian_and_loess_with_nulls(spark):
    rows = [(1, i, None if i == 4 else float(i)) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "s long, t long, v double")
    got = {r["t"]: r["v_smoothed"] for r in smoothing.gaussian_smooth(df, ["s"], ["t"], ["v"], 2).collect()}
    _, radius = smoothing.gaussian_kernel(2)
    assert {t for t, v in got.items() if v is None} == set(range(max(1, 4 - radius), 4 + radius + 1))
    line = smoothing.loess(df, ["s"], ["t"], "v", 5).collect()
    assert [r["v_smoothed"] for r in sorted(line)] == pytest.approx([float(i) for i in range(1, 13) if i != 4])


def test_sum_of_an_all_null_group_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, v double")
    for scale in (None, 2):
        got = df.groupBy("k").agg(exact_sum("v", scale).alias("v")).collect()
        assert {r["k"]: r["v"] for r in got} == {"a": 0.0, "b": 1.5}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    filled, values = missing.fill_statistic(df, "mean", ["v"])
    assert values == {"v": 2.0} and sorted(r["v"] for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0]
    capped, _ = outliers.treat(spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, 4.0, 99.0, float("nan")]], "v double"), ["v"], "iqr", "cap")
    assert sorted(r["v"] for r in capped.where("v is not null").collect()) == [1.0, 2.0, 3.0, 4.0, 7.0]


def test_integer_columns_keep_fractions(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 6, 50]], "v int")
    capped, report = outliers.treat(df, ["v"], "iqr", "cap")
    assert max(r["v"] for r in capped.collect()) == report[0]["upper"] == np.quantile([1, 2, 3, 4, 6, 50], 0.75) + 1.5 * (
        np.quantile([1, 2, 3, 4, 6, 50], 0.75) - np.quantile([1, 2, 3, 4, 6, 50], 0.25))


def test_split_of_large_keys(spark):
    keys = [5, 3_500_000_000, 9_000_000_000_000_000_000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r["s"] for r in df.select(prepare.split_flag(F.col("k")).alias("s")).collect()]
    assert got == ["train" if (k * 2654435761 + 42) % 1000 < 700 else "test" for k in keys]


def test_chronological_split_with_gaps(spark):
    rows = [(1, p) for p in (3, 4, 9, 10, 11, 20, 21, 22, 23, 30)] + [(2, 5)]
    got = forecast.split_samples(spark.createDataFrame(rows, "s long, position long"), ["s"]).collect()
    assert {(r["s"], r["position"]): r["split"] for r in got} == \
        {**{(1, p): "train" for _, p in rows[:8]}, (1, 23): "test", (1, 30): "test", (2, 5): "test"}


def test_text_entities_round_trip(spark):
    docs = spark.createDataFrame([
        (1, "Write to ann.b@mail.example.org or +1 (017) 555-7713.\nReleased under the MIT License."),
        (2, "Host 10.2.33.4 answers; later 10.2.33.5 does."), (3, ""), (4, None), (5, "an a a a b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in text.extract_entities(docs, "doc_id", "text", text.DOCUMENT_ENTITIES).collect()}
    assert (got[1]["email"], got[1]["phone"], got[1]["license"]) == ("ann.b@mail.example.org", "1 (017) 555-7713", "MIT License")
    assert got[2]["ip_address"] == "10.2.33.5" and got[3]["email"] == got[4]["email"] == ""
    rows = text.entity_rows(text.extract_entities(docs, "doc_id", "text", text.DOCUMENT_ENTITIES), "doc_id", text.DOCUMENT_ENTITIES)
    lab = text.bio_labels(text.tokens(docs, "doc_id", "text"), rows, "doc_id", text.DOCUMENT_ENTITIES)
    back = {r["doc_id"]: r for r in text.bio_decode(lab, "doc_id", text.DOCUMENT_ENTITIES).collect()}
    assert all(back[i][f] == got[i][f] for i in (1, 2) for f in ("email", "phone", "license", "ip_address"))


def test_overlapping_phrase_later_start_wins(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a", "a"])], "doc_id long, pos long, token string")
    ents = spark.createDataFrame([(1, "CLAIM", "a a")], "doc_id long, type string, phrase string")
    got = [r["label"] for r in text.bio_labels(toks, ents, "doc_id").orderBy("pos").collect()]
    assert got == ["B-CLAIM", "B-CLAIM", "I-CLAIM"]


@pytest.mark.parametrize("accuracy,max_band", [(10_000, 5_000), (50, 20), (20, 1)])
def test_quantiles_of_many_columns_at_once(spark, accuracy, max_band):
    """Ties, nulls, NaN, constants and empty columns, however often the bands are narrowed."""
    rng = np.random.default_rng(5)
    n = 3000
    cols = {"a": rng.normal(0, 1, n), "b": rng.integers(0, 7, n).astype(float), "c": np.full(n, 4.0), "d": rng.lognormal(0, 3, n),
            "e": np.full(n, np.nan)}
    cols["a"][::5] = np.nan
    rows = [tuple(None if x != x and i % 2 else float(x) for x in r) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    probs = {"a": [0.0, 0.01, 0.25, 0.5, 0.999, 1.0], "b": [0.5, 0.25], "c": [0.3], "d": [0.9, 0.1, 0.5], "e": [0.5]}
    got = quantiles_of(df, probs, accuracy=accuracy, max_band=max_band)
    assert got["e"] == [None]
    for c in "abcd":
        assert got[c] == pytest.approx(list(np.nanquantile(cols[c], probs[c])), rel=1e-12)


def test_bounds_of_all_columns_equal_those_of_one(spark):
    from tessera.operators.outliers import bounds, bounds_of
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), int(b), None) for a, b in zip(rng.normal(0, 1, 500), rng.integers(0, 50, 500))],
                               "a double, b int, c double")
    for method in ("iqr", "percentile", "zscore", "modified_zscore"):
        assert bounds_of(df, ["a", "b", "c"], method) == {c: bounds(df, c, method) for c in "abc"}
