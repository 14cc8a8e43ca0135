"""File sources and sinks: CSV (header, inferred types, BOM-safe), plain
text documents, multi-graph edge lists and JSON adjacency graph sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, infer: bool = True, schema=None) -> DataFrame:
    """CSV with a header row; types inferred unless a schema is given.  A
    UTF-8 byte-order mark in the first header name is stripped."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    df = reader.csv(path)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header row (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(path, text)`` (whole file as one string)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))


GRAPHSET_SCHEMA = "map<string, map<string, array<string>>>"


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON adjacency graph set ``{graph: {vertex: [neighbours]}}`` to rows
    ``(graph, src, pos, dst)`` (``pos`` = neighbour order); keys are strings."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", GRAPHSET_SCHEMA).alias("g"))
    g = parsed.select(F.explode("g").alias("graph", "adj"))
    v = g.select("graph", F.explode("adj").alias("src", "nbrs"))
    return v.select("graph", "src", F.posexplode("nbrs").alias("pos", "dst"))
