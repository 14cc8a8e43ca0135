"""Micro-cluster stream clustering (CluStream-style update rule).

Per point, in time order: the nearest micro-cluster (Euclidean distance to
its centroid, first one on ties) absorbs the point when within
``threshold``; otherwise a new micro-cluster is created while fewer than
``max_clusters`` exist; otherwise the oldest (by creation time) is replaced.
The point is then labelled with its nearest centroid.  A micro-cluster is the
additive CF vector ``(N, LS, SS, created)``.

The rule is sequential, so each stream key keeps its own micro-clusters:
``groupBy(key).applyInPandasWithState`` (state bounded by ``max_clusters``)
in a streaming query, or ``applyInPandas`` on a static table.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

# fixed values: threshold and cluster count used by the parking-stream consumer
DEFAULT_THRESHOLD = 100.0
DEFAULT_MAX_CLUSTERS = 3

OUT_SCHEMA = "key string, id long, t double, x1 double, x2 double, cluster int"
IN_COLS = ["key", "id", "t", "c", "x1", "x2"]
STATE_SCHEMA = "clusters string"


def update(clusters: list[dict], point: np.ndarray, created: float, threshold: float,
           max_clusters: int) -> int:
    """Apply one point in place; return its label (nearest centroid after update)."""
    if not clusters:
        clusters.append({"n": 1, "ls": point.tolist(), "ss": (point ** 2).tolist(), "created": created})
    else:
        dists = [float(np.linalg.norm(point - np.asarray(c["ls"]) / c["n"])) for c in clusters]
        best = int(np.argmin(dists))
        if dists[best] <= threshold:
            c = clusters[best]
            c["n"] += 1
            c["ls"] = (np.asarray(c["ls"]) + point).tolist()
            c["ss"] = (np.asarray(c["ss"]) + point ** 2).tolist()
        else:
            new = {"n": 1, "ls": point.tolist(), "ss": (point ** 2).tolist(), "created": created}
            if len(clusters) < max_clusters:
                clusters.append(new)
            else:
                oldest = int(np.argmin([c["created"] for c in clusters]))
                clusters[oldest] = new
    cents = [np.asarray(c["ls"]) / c["n"] for c in clusters]
    return int(np.argmin([np.linalg.norm(point - c) for c in cents]))


def _run(key: str, pdf: pd.DataFrame, clusters: list[dict], threshold: float, max_clusters: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["t", "id"])
    labels = [update(clusters, np.array([a, b], dtype=float), float(c), threshold, max_clusters)
              for a, b, c in zip(pdf["x1"], pdf["x2"], pdf["c"])]
    return pd.DataFrame({"key": key, "id": pdf["id"].astype("int64"), "t": pdf["t"].astype(float),
                         "x1": pdf["x1"].astype(float), "x2": pdf["x2"].astype(float),
                         "cluster": np.asarray(labels, dtype="int32")})


def _points(df: DataFrame, key: Column, id_col: str, time: Column, x1: Column, x2: Column,
            created: Column | None) -> DataFrame:
    """``time`` orders the points (arrival); ``created`` stamps new clusters
    (defaults to ``time``)."""
    c = created if created is not None else time
    return df.select(key.cast("string").alias("key"), F.col(id_col).cast("long").alias("id"),
                     time.cast("double").alias("t"), c.cast("double").alias("c"),
                     x1.cast("double").alias("x1"), x2.cast("double").alias("x2"))


def cluster_static(df: DataFrame, key: Column, id_col: str, time: Column, x1: Column, x2: Column,
                   threshold: float = DEFAULT_THRESHOLD, max_clusters: int = DEFAULT_MAX_CLUSTERS,
                   created: Column | None = None) -> DataFrame:
    """Batch form: each key's points in (time, id) order through the rule."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return _run(str(pdf["key"].iloc[0]), pdf, [], threshold, max_clusters)
    return _points(df, key, id_col, time, x1, x2, created).groupBy("key").applyInPandas(fn, OUT_SCHEMA)


def cluster_stream(stream: DataFrame, key: Column, id_col: str, time: Column, x1: Column, x2: Column,
                   threshold: float = DEFAULT_THRESHOLD, max_clusters: int = DEFAULT_MAX_CLUSTERS,
                   created: Column | None = None) -> DataFrame:
    """Streaming form: micro-clusters per key live in the state store."""
    def fn(k, pdfs, state):
        clusters = json.loads(state.get[0]) if state.exists else []
        batch = pd.concat(list(pdfs), ignore_index=True)
        out = _run(str(k[0]), batch, clusters, threshold, max_clusters)
        state.update((json.dumps(clusters),))
        yield out
    pts = _points(stream, key, id_col, time, x1, x2, created)
    return pts.groupBy("key").applyInPandasWithState(fn, OUT_SCHEMA, STATE_SCHEMA, "append",
                                                     GroupStateTimeout.NoTimeout)


def cf_vectors(points: DataFrame, label: str, features: list[str]) -> DataFrame:
    """CF vector per cluster: N, LS, SS (mergeable sums), centroid, radius
    ``sqrt(sum(SS/N - centroid^2))``."""
    g = points.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                                  *[F.sum(f).alias(f"ls_{f}") for f in features],
                                  *[F.sum(F.col(f) * F.col(f)).alias(f"ss_{f}") for f in features])
    cent = [(F.col(f"ls_{f}") / F.col("n")).alias(f"c_{f}") for f in features]
    g = g.select("*", *cent)
    rad = F.sqrt(F.greatest(F.lit(0.0), sum((F.col(f"ss_{f}") / F.col("n") - F.col(f"c_{f}") ** 2
                                             for f in features), F.lit(0.0))))
    return g.select("*", rad.alias("radius"))


def nearest_centroid(points: DataFrame, centroids: list[list[float]], features: list[str]) -> Column:
    """Index of the nearest centroid (first on ties), -1 when there are none;
    the centroids (a handful) are literals of the expression."""
    if not centroids:
        return F.lit(-1)
    d = F.array(*[F.sqrt(sum(((F.col(f) - F.lit(c[i])) ** 2 for i, f in enumerate(features)), F.lit(0.0)))
                  for c in centroids])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")
