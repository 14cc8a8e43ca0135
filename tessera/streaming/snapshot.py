"""Rolling snapshot of a stream: the latest ``n`` events, kept in a versioned table.

Every micro-batch takes its own latest ``n`` (each task keeps ``n``), adds the
``n`` rows of the version before it and writes the result under its batch id.  A
batch that runs again reads the same earlier version and replaces its own, so a
restart neither loses nor repeats an event.  A version is valid once its write was
committed; versions no replay can ask for are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.streaming.sources import run_available_now

KEEP = 3              # versions left in place: a batch that runs again needs the one before it


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch ids of the committed versions, ascending."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    ids = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("batch=") and fs.exists(_folder(spark, f"{path}/{name}/_SUCCESS")[1]):
            ids.append(int(name[len("batch="):]))
    return sorted(ids)


def read_snapshot(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """The version of ``batch_id`` (default: the latest); None before the first batch."""
    ids = versions(spark, path)
    if not ids:
        return None
    return spark.read.parquet(f"{path}/batch={ids[-1] if batch_id is None else batch_id}")


def update_snapshot(batch: DataFrame, batch_id: int, path: str, order: list[Column], n: int = 100) -> None:
    """Write version ``batch_id``: the first ``n`` rows by ``order`` of the batch and the version before.

    ``order`` should be total (end with a key); among rows it calls equal any may be kept.
    Repeated rows count as often as they come, nulls sort as ``order`` says, and an
    empty batch repeats the version before it."""
    if n < 1:
        raise ValueError("a snapshot holds at least one row")
    spark = batch.sparkSession
    before = [v for v in versions(spark, path) if v < batch_id]
    rows = batch.orderBy(*order).limit(n)
    if before:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={before[-1]}"))
    rows.orderBy(*order).limit(n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for old in before[:-(KEEP - 1)]:
        fs, p = _folder(spark, f"{path}/batch={old}")
        fs.delete(p, True)


def rolling_snapshot(stream: DataFrame, path: str, checkpoint: str, order: list[Column], n: int = 100) -> DataFrame | None:
    """Run ``stream`` over all that is available and return the snapshot after it."""
    run_available_now(stream.writeStream.foreachBatch(lambda b, i: update_snapshot(b, i, path, order, n))
                      .option("checkpointLocation", checkpoint))
    return read_snapshot(stream.sparkSession, path)
