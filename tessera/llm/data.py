"""Tables that the training-data queries read, and intermediate tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, materialize
from tessera.sources.tables import load_table

__all__ = ["ensure_checkpoint_dir", "discard", "label_rows", "load_table", "materialize"]


def label_rows(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``(doc_id, label)``, one row per labelled document."""
    marks = load_table(spark, sf_dir, "labels").where(F.col(label).isNotNull())
    return marks.groupBy("doc_id").agg(F.max(label).alias("label"))


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        if "/tessera-" in folder:                             # never an input table
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
