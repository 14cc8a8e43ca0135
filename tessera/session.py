"""Session helpers: building a session for tests/bench, and lineage cutting.

Library code never creates its own session; it works on the session of the
DataFrames it is given.  Iterative operators cut lineage with a reliable
``checkpoint()`` into the directory the cluster names in
``spark.checkpoint.dir`` (never ``localCheckpoint``: executors may be lost).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tessera") -> SparkSession:
    """Session used by tests, bench and scripts (local mode)."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the SparkContext has a reliable checkpoint directory.

    Uses the directory already set on the context, else the cluster's
    ``spark.checkpoint.dir``.  Only when neither is set *and* the master is
    local (tests) do we create a directory of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir must name a shared folder for iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` once in the shared checkpoint dir and drop its lineage: as parquet
    (compressed, and its size known to the planner) where the columns allow it."""
    if any(isinstance(t, _UNSTORED) for t in _types(df.schema)) or len({c.lower() for c in df.columns}) < max(len(df.columns), 1):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return materialize(df, "cut")


_UNSTORED = (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType, T.VariantType, T.UserDefinedType)


def _types(t: T.DataType):
    """A type and all types nested in it."""
    yield t
    inner = [f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else \
        [t.keyType, t.valueType] if isinstance(t, T.MapType) else []
    for x in inner:
        yield from _types(x)


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet into a fresh folder under the
    shared checkpoint directory and reading it back (columnar and compressed:
    cheaper than ``checkpoint()`` for large intermediates); ``by``: a folder for
    each value of that column."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tessera-{name}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
