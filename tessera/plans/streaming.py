"""Streaming queries.

Streams are the driver tables read with the file stream source and run with
``trigger(availableNow=True)``; sinks and stream checkpoints live in fresh
folders under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.joins import broadcast_if_bounded
from tessera.operators import events as ev
from tessera.operators import olap
from tessera.plans.events import shopping_events
from tessera.plans.olap import CUBE_DIMS, MEASURES, _cubes_sql
from tessera.plans.registry import register
from tessera.sources.tables import load_table
from tessera.streaming import clustream, hoeffding, snapshot
from tessera.streaming.sources import run_available_now, scratch_path, table_stream


def _epoch(ts_col: str = "ts"):
    return F.col(ts_col).cast("timestamp").cast("double")


def _minute():
    return ev.minute_of_day(F.col("ts")).cast("double")


@register("stream_clustream")
def stream_clustream(spark, sf):
    """Micro-clusters per user over the event stream (state store), points
    (minute of day, value), created at event time; threshold 100, 3 clusters."""
    schema = load_table(spark, sf, "events").schema
    src = table_stream(spark, sf, "events", schema)
    out = clustream.cluster_stream(src, F.col("user_id"), "event_id", _epoch(), _minute(), F.col("value"))
    sink, ckpt = scratch_path(spark, "clustream-out"), scratch_path(spark, "clustream-ckpt")
    run_available_now(out.writeStream.format("parquet").option("path", sink)
                      .option("checkpointLocation", ckpt).outputMode("append"))
    return spark.read.parquet(sink).select("key", "id", "x1", "x2", "cluster")


@register("clustream_static")
def clustream_static(spark, sf):
    """The same rule on the static table (per-user groups)."""
    e = load_table(spark, sf, "events")
    out = clustream.cluster_static(e, F.col("user_id"), "event_id", _epoch(), _minute(), F.col("value"))
    return out.select("key", "id", "x1", "x2", "cluster")


_DAYPART_SQL = """CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 420 AND 600 THEN 'morning'
                    WHEN hour(ts) * 60 + minute(ts) BETWEEN 720 AND 900 THEN 'midday'
                    WHEN hour(ts) * 60 + minute(ts) BETWEEN 1080 AND 1320 THEN 'evening'
                    ELSE 'off_peak' END"""


def _daypart_points(spark, sf):
    e = load_table(spark, sf, "events")
    name, _, _ = ev.daypart(ev.minute_of_day(F.col("ts")))
    return e.select("event_id", name.alias("daypart"), _minute().alias("x1"), F.col("value").alias("x2"))


@register("cf_vectors", f"""
WITH p AS (SELECT {_DAYPART_SQL} AS daypart, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS x1, value AS x2
           FROM events)
SELECT daypart, COUNT(*) AS n, ROUND(SUM(x1), 6) AS ls_x1, ROUND(SUM(x2), 6) AS ls_x2,
       ROUND(SUM(x1 * x1), 4) AS ss_x1, ROUND(SUM(x2 * x2), 4) AS ss_x2,
       ROUND(SUM(x1) / COUNT(*), 6) AS c_x1, ROUND(SUM(x2) / COUNT(*), 6) AS c_x2,
       ROUND(sqrt(greatest(0, SUM(x1 * x1) / COUNT(*) - pow(SUM(x1) / COUNT(*), 2)
                          + SUM(x2 * x2) / COUNT(*) - pow(SUM(x2) / COUNT(*), 2))), 4) AS radius
FROM p GROUP BY daypart""")
def cf_vectors(spark, sf):
    """CF vectors (N, LS, SS, centroid, radius) of the day-part groups."""
    cf = clustream.cf_vectors(_daypart_points(spark, sf), "daypart", ["x1", "x2"])
    r6 = ["ls_x1", "ls_x2", "c_x1", "c_x2"]
    r4 = ["ss_x1", "ss_x2", "radius"]
    return cf.select("daypart", "n", *[F.round(c, 6).alias(c) for c in r6], *[F.round(c, 4).alias(c) for c in r4])


@register("nearest_centroid", f"""
WITH p AS (SELECT event_id, {_DAYPART_SQL} AS daypart, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS x1,
                  value AS x2 FROM events),
c AS (SELECT daypart, AVG(x1) AS c1, AVG(x2) AS c2,
             CAST(ROW_NUMBER() OVER (ORDER BY daypart) - 1 AS INTEGER) AS idx FROM p GROUP BY daypart),
d AS (SELECT p.event_id, c.idx, sqrt(pow(p.x1 - c.c1, 2) + pow(p.x2 - c.c2, 2)) AS dist FROM p, c)
SELECT event_id, CAST(arg_min(idx, (dist, idx)) AS INTEGER) AS cluster FROM d GROUP BY event_id""")
def nearest_centroid(spark, sf):
    """Label every event with its nearest day-part centroid (centroids from a
    Spark aggregate; four literals)."""
    p = _daypart_points(spark, sf)
    cents = (p.groupBy("daypart").agg(F.avg("x1").alias("c1"), F.avg("x2").alias("c2"))
             .orderBy("daypart").collect())
    return p.select("event_id", clustream.nearest_centroid(
        p, [[r["c1"], r["c2"]] for r in cents], ["x1", "x2"]).alias("cluster"))


HT_FEATURES = ["event_type", "duration_band", "product_category", "purchases_band"]


def _shop_rows(spark, sf):
    s = shopping_events(spark, sf)
    return s.select("event_id", F.to_date("ts").alias("day"), "event_type",
                    ev.duration_bucket(F.col("session_duration")).alias("duration_band"),
                    "product_category",
                    ev.purchases_bucket(F.col("user_total_purchases")).alias("purchases_band"),
                    ev.purchase_rule(F.col("event_type"), F.col("session_duration"),
                                     F.col("user_total_purchases")).alias("purchase"))


def _replay(spark, sf):
    rows = _shop_rows(spark, sf).cache()
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").collect()]
    batches = ((i, rows.where(F.col("day") == d)) for i, d in enumerate(days))
    return hoeffding.prequential(batches, HT_FEATURES, "purchase", "event_id",
                                 grace_period=10, delta=0.99, tau=0.05)


@register("stream_prequential")
def stream_prequential(spark, sf):
    """Test-then-train Hoeffding tree over day micro-batches: running
    accuracy / F1 after every batch."""
    _, metrics, _ = _replay(spark, sf)
    return spark.createDataFrame(metrics, "batch_id long, n_scored long, accuracy double, f1 double, n_leaves long")


@register("event_records")
def event_records(spark, sf):
    """Enriched event records: truth and prediction as Yes / No / N/A."""
    records, _, _ = _replay(spark, sf)
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r)
    yn = {"1": "Yes", "0": "No"}
    m = F.create_map(*[x for k, v in yn.items() for x in (F.lit(k), F.lit(v))])
    return out.select("event_id", m[F.col("truth")].alias("purchase"),
                      F.coalesce(m[F.col("prediction")], F.lit("N/A")).alias("prediction"))


@register("stream_cube_refresh", _cubes_sql(CUBE_DIMS))
def stream_cube_refresh(spark, sf):
    """Line items as a stream; every micro-batch joins its facts to the static
    order/customer/nation dimensions and writes its own cubes under its batch
    id (a replayed batch overwrites itself).  Cubes are sums, so the export is
    the sum of the batches' cubes; no batch reads earlier facts."""
    schema = load_table(spark, sf, "lineitem").schema
    src = table_stream(spark, sf, "lineitem", schema)
    export = scratch_path(spark, "cube-export")
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = load_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = broadcast_if_bounded(load_table(spark, sf, "nation").select("n_nationkey", "n_name"), 1000)

    def refresh(batch, batch_id):
        facts = (batch.select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
                 .join(o, F.col("l_orderkey") == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
                 .join(n, F.col("c_nationkey") == n.n_nationkey)
                 .select("n_name", "c_mktsegment", "l_returnflag", "l_quantity", "l_extendedprice"))
        cubes = olap.data_cubes(facts, CUBE_DIMS, MEASURES, money_scale=2)
        cubes.write.mode("overwrite").parquet(f"{export}/batch={batch_id}")

    run_available_now(src.writeStream.foreachBatch(refresh)
                      .option("checkpointLocation", scratch_path(spark, "cube-ckpt")))
    return olap.merge_cubes(spark.read.parquet(export).drop("batch"), CUBE_DIMS, MEASURES, money_scale=2)


@register("stream_recent_events", """
SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def stream_recent_events(spark, sf):
    """Rolling snapshot of the event stream: after every micro-batch the last 100 events."""
    src = table_stream(spark, sf, "events", load_table(spark, sf, "events").schema, max_files_per_trigger=1)
    rows = src.select("ts", "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    last = snapshot.rolling_snapshot(rows, scratch_path(spark, "recent-out"), scratch_path(spark, "recent-ckpt"),
                                     [F.desc("ts"), F.desc("event_id")], 100)
    if last is None:                                          # no file, no batch
        last = load_table(spark, sf, "events").limit(0).withColumn("k", F.lit(None).cast("int"))
    return last.select("event_id", "user_id", "event_type", "value", "k")
