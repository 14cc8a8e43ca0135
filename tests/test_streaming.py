"""Stream mining: CluStream rule (FIXTURES A10), stream vs static, Hoeffding tree."""

import numpy as np
from pyspark.sql import functions as F

from tessera.streaming import clustream, hoeffding
from tessera.streaming.sources import file_stream, run_available_now

from conftest import SF001


def test_clustream_fixture():
    pts = [(0, 10), (10, 20), (420, 80), (430, 85), (720, 90), (1080, 50), (15, 25)]
    clusters = []
    labels = [clustream.update(clusters, np.array(p, dtype=float), float(p[0]), 100.0, 3) for p in pts]
    assert labels == [0, 0, 1, 1, 2, 0, 1]
    assert [(c["n"], c["ls"], c["created"]) for c in clusters] == [
        (1, [1080.0, 50.0], 1080.0), (1, [15.0, 25.0], 15.0), (1, [720.0, 90.0], 720.0)]


def test_clustream_static_fixture(spark):
    pts = [(0, 10), (10, 20), (420, 80), (430, 85), (720, 90), (1080, 50), (15, 25)]
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "k long, id long, a double, b double")
    out = clustream.cluster_static(df, F.col("k"), "id", F.col("id"), F.col("a"), F.col("b"),
                                   created=F.col("a"))
    assert [r.cluster for r in out.orderBy("id").collect()] == [0, 0, 1, 1, 2, 0, 1]


def test_stream_equals_static(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    t = F.col("ts").cast("timestamp").cast("double")
    m = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    static = {(r.key, r.id): r.cluster for r in
              clustream.cluster_static(ev, F.col("user_id"), "event_id", t, m, F.col("value")).collect()}
    src = file_stream(spark, SF001, ev.schema, "parquet", glob="events.parquet")
    out = clustream.cluster_stream(src, F.col("user_id"), "event_id", t, m, F.col("value"))
    sink = str(tmp_path / "sink")
    run_available_now(out.writeStream.format("parquet").option("path", sink)
                      .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append"))
    streamed = {(r.key, r.id): r.cluster for r in spark.read.parquet(sink).collect()}
    assert streamed == static and len(static) == ev.count()


def _rule_rows(spark, n_batches=6, per=60):
    rows = []
    for b in range(n_batches):
        for i in range(per):
            et = ["view", "click", "add_to_cart"][(i + b) % 3]
            band = ["low", "high"][(i // 3) % 2]
            rows.append((b * per + i, b, et, band, "x", "y", 1 if (et == "click" and band == "high") else 0))
    return spark.createDataFrame(rows, "event_id long, day long, event_type string, duration_band string, "
                                       "product_category string, purchases_band string, purchase int")


def test_hoeffding_learns_rule(spark):
    df = _rule_rows(spark)
    batches = [(b, df.where(F.col("day") == b)) for b in range(6)]
    records, metrics, tree = hoeffding.prequential(batches, ["event_type", "duration_band", "product_category",
                                                             "purchases_band"], "purchase", "event_id")
    first = records[0].select("prediction").distinct().collect()
    assert [r.prediction for r in first] == ["N/A"]      # nothing learnt before the first batch
    assert metrics[-1][2] > 0.9 and tree.n_leaves() > 1
    last = records[-1].where("prediction != 'N/A'")
    assert last.where("truth = prediction").count() == last.count()


def test_prequential_sink_matches_replay(spark, tmp_path):
    df = _rule_rows(spark, n_batches=4)
    src_dir = tmp_path / "src"
    for b in range(4):
        df.where(F.col("day") == b).coalesce(1).write.mode("append").parquet(str(src_dir))
    feats = ["event_type", "duration_band", "product_category", "purchases_band"]
    sink = hoeffding.PrequentialSink(feats, "purchase", "event_id", str(tmp_path / "m"), str(tmp_path / "r"))
    stream = file_stream(spark, str(src_dir), df.schema, "parquet", max_files_per_trigger=1)
    run_available_now(stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")))
    got = [(r.n_scored, r.accuracy) for r in spark.read.parquet(str(tmp_path / "m")).orderBy("batch_id").collect()]
    _, metrics, _ = hoeffding.prequential([(b, df.where(F.col("day") == b)) for b in range(4)], feats,
                                          "purchase", "event_id")
    assert got == [(m[1], m[2]) for m in metrics]
