"""Hoeffding tree over nominal features with test-then-train evaluation.

The tree is a small driver-side structure (its size is bounded by the number
of leaves x feature values x classes, not by the data).  Each micro-batch:

1. the tree is compiled to a Column (leaf id, prediction) and the batch is
   scored on the executors; predictions from leaves without data are "N/A"
   and not scored;
2. ``groupBy(leaf, truth, prediction)`` counts update the running confusion
   totals (accuracy, binary F1);
3. ``groupBy(leaf, feature, value, label).count()`` sufficient statistics are
   merged into the leaves (additive), and every leaf that saw at least
   ``grace_period`` new rows tries a split: gini merit of a multiway split per
   feature, Hoeffding bound ``sqrt(ln(1/delta) / (2 n))`` (range 1 for gini),
   split when best - second best > bound or bound < ``tau``.

Predictions inside one micro-batch use the tree from the start of the batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "__other__"


@dataclass
class Node:
    depth: int
    class_counts: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)          # (feature, value) -> {label: n}
    seen_at_check: int = 0
    feature: str | None = None                          # split feature (internal node)
    children: dict = field(default_factory=dict)        # value -> node id

    @property
    def n(self) -> int:
        return int(sum(self.class_counts.values()))

    def prediction(self):
        if not self.class_counts:
            return None
        return sorted(self.class_counts.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]


def gini(counts: dict) -> float:
    n = sum(counts.values())
    if n == 0:
        return 0.0
    return 1.0 - sum((c / n) ** 2 for c in counts.values())


class HoeffdingTree:
    def __init__(self, features: list[str], label: str, grace_period: int = 10, delta: float = 0.99,
                 tau: float = 0.05, max_depth: int | None = None):
        self.features, self.label = features, label
        self.grace, self.delta, self.tau, self.max_depth = grace_period, delta, tau, max_depth
        self.nodes: dict[int, Node] = {0: Node(depth=0)}

    # ------------------------------------------------------------ compile to Columns
    def _leaf_expr(self, nid: int) -> Column:
        node = self.nodes[nid]
        if node.feature is None:
            return F.lit(nid)
        col = F.col(node.feature).cast("string")
        expr = self._leaf_expr(node.children[OTHER])
        for value, child in sorted(node.children.items(), key=lambda kv: kv[0]):
            if value != OTHER:
                expr = F.when(col == F.lit(value), self._leaf_expr(child)).otherwise(expr)
        return expr

    def leaf_column(self) -> Column:
        return self._leaf_expr(0)

    def prediction_column(self, leaf: Column) -> Column:
        preds = {nid: n.prediction() for nid, n in self.nodes.items()
                 if n.feature is None and n.prediction() is not None}
        if not preds:
            return F.lit(None).cast("string")
        m = F.create_map(*[x for k, v in sorted(preds.items()) for x in (F.lit(k), F.lit(str(v)))])
        return m[leaf]

    # ------------------------------------------------------------ learning
    def learn(self, batch: DataFrame) -> None:
        """Merge the batch's sufficient statistics and try splits."""
        leaf = self.leaf_column()
        rows = (batch.select(leaf.alias("_leaf"), F.col(self.label).cast("string").alias("_y"),
                             F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v"))
                                                 for f in self.features])).alias("_fv"))
                .groupBy("_leaf", "_y", "_fv.f", "_fv.v").count().collect())
        for r in rows:
            node = self.nodes[r["_leaf"]]
            d = node.stats.setdefault((r["f"], r["v"]), {})
            d[r["_y"]] = d.get(r["_y"], 0) + r["count"]
        # class counts from one feature's statistics (each row counted once per feature)
        first = self.features[0]
        touched = {r["_leaf"] for r in rows}
        for nid in touched:
            node = self.nodes[nid]
            cc: dict = {}
            for (f, _v), d in node.stats.items():
                if f == first:
                    for y, c in d.items():
                        cc[y] = cc.get(y, 0) + c
            node.class_counts = cc
        for nid in sorted(touched):
            node = self.nodes[nid]
            if node.n - node.seen_at_check >= self.grace:
                node.seen_at_check = node.n
                self._try_split(nid)

    def _try_split(self, nid: int) -> None:
        node = self.nodes[nid]
        if self.max_depth is not None and node.depth >= self.max_depth:
            return
        parent = gini(node.class_counts)
        n = node.n
        merits = []
        for f in self.features:
            branches = {v: d for (ff, v), d in node.stats.items() if ff == f}
            if len(branches) < 2:
                continue
            after = sum(sum(d.values()) / n * gini(d) for d in branches.values())
            merits.append((parent - after, f, branches))
        if not merits:
            return
        merits.sort(key=lambda m: (-m[0], m[1]))
        best = merits[0]
        second = merits[1][0] if len(merits) > 1 else 0.0
        eps = math.sqrt(math.log(1.0 / self.delta) / (2.0 * n))
        if best[0] <= 0 or not (best[0] - second > eps or eps < self.tau):
            return
        node.feature = best[1]
        for value, dist in list(best[2].items()) + [(OTHER, dict(node.class_counts))]:
            cid = len(self.nodes)
            self.nodes[cid] = Node(depth=node.depth + 1, class_counts=dict(dist), seen_at_check=sum(dist.values()))
            node.children[value] = cid
        node.stats = {}

    def n_leaves(self) -> int:
        return sum(1 for n in self.nodes.values() if n.feature is None)


def prequential(batches, features: list[str], label: str, key: str, **tree_params):
    """Test-then-train over an iterable of ``(batch_id, DataFrame)``.

    Returns ``(records, metrics)``: per-row ``(key, truth, prediction)`` frames
    (prediction "N/A" when the leaf has no data yet) and per-batch running
    metrics ``(batch_id, n_scored, accuracy, f1, n_leaves)``."""
    tree = HoeffdingTree(features, label, **tree_params)
    tp = fp = fn = correct = scored = 0
    records, metrics = [], []
    for batch_id, df in batches:
        leaf = tree.leaf_column()
        pred = tree.prediction_column(leaf)
        out = df.select(key, F.col(label).cast("string").alias("truth"),
                        F.coalesce(pred, F.lit("N/A")).alias("prediction"))
        records.append(out)
        conf = out.where(F.col("prediction") != "N/A").groupBy("truth", "prediction").count().collect()
        for r in conf:
            scored += r["count"]
            if r["truth"] == r["prediction"]:
                correct += r["count"]
            if r["prediction"] == "1" and r["truth"] == "1":
                tp += r["count"]
            elif r["prediction"] == "1":
                fp += r["count"]
            elif r["truth"] == "1":
                fn += r["count"]
        tree.learn(df)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        metrics.append((batch_id, scored, correct / scored if scored else None, f1, tree.n_leaves()))
    return records, metrics, tree


class PrequentialSink:
    """``foreachBatch`` callback: test-then-train on every micro-batch and
    append ``(batch_id, n_scored, accuracy, f1, n_leaves)`` to ``metrics_path``
    and the enriched records to ``records_path`` (parquet, append)."""

    def __init__(self, features, label, key, metrics_path, records_path, **tree_params):
        self.features, self.label, self.key = features, label, key
        self.metrics_path, self.records_path = metrics_path, records_path
        self.tree = HoeffdingTree(features, label, **tree_params)
        self.counts = {"tp": 0, "fp": 0, "fn": 0, "correct": 0, "scored": 0}

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        leaf = self.tree.leaf_column()
        out = df.select(self.key, F.col(self.label).cast("string").alias("truth"),
                        F.coalesce(self.tree.prediction_column(leaf), F.lit("N/A")).alias("prediction"))
        out.write.mode("append").parquet(self.records_path)
        c = self.counts
        for r in out.where(F.col("prediction") != "N/A").groupBy("truth", "prediction").count().collect():
            c["scored"] += r["count"]
            c["correct"] += r["count"] if r["truth"] == r["prediction"] else 0
            c["tp"] += r["count"] if r["truth"] == r["prediction"] == "1" else 0
            c["fp"] += r["count"] if r["prediction"] == "1" and r["truth"] != "1" else 0
            c["fn"] += r["count"] if r["truth"] == "1" and r["prediction"] != "1" else 0
        self.tree.learn(df)
        prec = c["tp"] / (c["tp"] + c["fp"]) if c["tp"] + c["fp"] else 0.0
        rec = c["tp"] / (c["tp"] + c["fn"]) if c["tp"] + c["fn"] else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        acc = c["correct"] / c["scored"] if c["scored"] else None
        df.sparkSession.createDataFrame(
            [(int(batch_id), c["scored"], acc, f1, self.tree.n_leaves())],
            "batch_id long, n_scored long, accuracy double, f1 double, n_leaves long",
        ).write.mode("append").parquet(self.metrics_path)
