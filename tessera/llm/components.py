"""Connected components of a distributed edge table.

Edges are first contracted inside each task (union-find over the task's rows,
which leaves a star per local component), then the smallest label travels along
the remaining edges with pointer jumping until nothing changes.  Every round is
checkpointed; no edge list or label table reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, smallest node of each one's component)`` of an edge list."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = code[:len(a)], code[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)                     # hang both roots under the smaller
        np.minimum.at(new, label[v], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contract(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > 500_000:
                a, b = _star(a, b)
                if len(a) > 250_000:                          # little left to contract: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        a, b = _star(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, low = roots(a, b)
    keep = nodes != low
    return nodes[keep], low[keep]


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges (a, b)`` (longs); ``comp`` is
    the smallest node of its component.  Loops to the fixed point; an empty
    edge table gives an empty result."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    near = cut_lineage(contract(contract(edges).repartition(F.col("b"))).distinct())
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                         .select("node", F.least("node", "b").alias("comp")))
    while True:
        low = (near.join(labels.withColumnRenamed("node", "b"), "b")
               .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low")))
        step = labels.join(low, "node").select("node", F.least("comp", "low").alias("comp"), F.col("comp").alias("old"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = cut_lineage(step.join(up, "comp").select("node", F.least("comp", "next").alias("comp"), "old"))
        labels = step.select("node", "comp")
        if step.where("comp != old").isEmpty():
            return labels
