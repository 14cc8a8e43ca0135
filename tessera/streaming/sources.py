"""Streaming sources and sink helpers.

``kafka_json_stream`` is the production source (JSON values of a topic,
parsed with an explicit schema); the Kafka connector jar is not on this
image's classpath, so tests and the registered queries use the file source
with the same parsing path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File source with an explicit schema (``glob`` picks files in ``path``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def kafka_json_stream(spark: SparkSession, servers: str, topic: str, schema,
                      starting_offsets: str = "latest", group_id: str | None = None) -> DataFrame:
    """JSON events of a Kafka topic parsed into columns (+ the Kafka timestamp)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if group_id:
        r = r.option("kafka.group.id", group_id)
    raw = r.load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v"),
                      F.col("timestamp").alias("kafka_ts")).select("v.*", "kafka_ts")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{name}/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a stream: the part files of a directory table, or the
    single file of that name in ``sf_dir``."""
    root, leaf = sf_dir.rstrip("/"), f"{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{leaf}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        return file_stream(spark, f"{root}/{leaf}", schema, max_files_per_trigger=max_files_per_trigger)
    return file_stream(spark, root, schema, glob=leaf, max_files_per_trigger=max_files_per_trigger)


def run_available_now(writer) -> None:
    """Start a ``DataStreamWriter`` with ``trigger(availableNow=True)`` and wait
    until all available data is processed; a failure of the query is raised."""
    q = writer.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
