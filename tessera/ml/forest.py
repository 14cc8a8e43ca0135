"""Random forests grown on binned rows.

A forest bins every feature before it grows (``max_bins``), so a tree sees no more of
the rows than their cell (the bins of all features) and, within a cell, the number of
draws and the mean label (regression) or the draws of each class.  The bootstrap is
drawn once for all trees and summed to (tree, cell); each tree is then one Spark ML
fit on weighted cells.  Rows are read for the bins and for the draws, not once a level, and the
fits cost the same whatever the number of rows.

* Regression: every row draws Poisson(1) in every tree.  Splits by variance compare
  means and weights only; the spread inside a cell is the same on both sides of a split.
* Classification: n rows of one cell and class are drawn together, as Poisson(n), the
  distribution of the sum of their draws.
"""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.joins import broadcast_if_bounded
from tessera.session import cut_lineage, materialize

MAX_BINS = 32          # Spark's default
MAX_SUMS = 1 << 22     # more sums (cells x trees) than this: the forest is grown on rows
GRID = 2000            # order statistics of a feature that its bins are cut from
FITS_AT_ONCE = 8


def split_points(values, max_bins: int = MAX_BINS) -> list[float]:
    """Thresholds between distinct ``values`` (repeats count): all midpoints where the
    values are few, else about equally many values apart."""
    v, c = np.unique(np.asarray(values, dtype=float), return_counts=True)
    mid = (v[:-1] + v[1:]) / 2
    if len(v) <= max_bins:
        return [float(m) for m in mid]
    stride = target = c.sum() / max_bins
    out, seen = [], float(c[0])
    for i in range(1, len(v)):
        if abs(seen - target) < abs(seen + c[i] - target):
            out.append(float(mid[i - 1]))
            target += stride
        seen += c[i]
    return out


def bins_of(train: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Thresholds of every feature, from all rows."""
    x = train.select(*[F.col(f).cast("double").alias(f) for f in features])
    near = x.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    many = [f for f in features if near[f] > 2 * max_bins]
    grid = dict(zip(many, x.approxQuantile(many, [i / GRID for i in range(GRID + 1)], 0.5 / GRID))) if many else {}
    few = {f: [r[0] for r in x.select(f).distinct().collect()] for f in features if f not in grid}
    return [split_points(grid[f] if f in grid else few[f], max_bins) for f in features]


def with_cell(df: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """``df`` with the number of each row's cell in ``_cell``; a null or NaN feature is an
    error, as it is for Spark's assembler."""
    from pyspark.ml.feature import Bucketizer
    cut = [(f, c) for f, c in zip(features, cuts) if c]
    bad = reduce(lambda a, b: a | b, [F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features])
    out = df.withColumns({f"_x{i}": F.when(bad, F.raise_error(F.lit("null or NaN feature")).cast("double"))
                          .otherwise(F.col(f).cast("double")) for i, (f, _) in enumerate(cut)})
    code = F.when(bad, F.raise_error(F.lit("null or NaN feature")).cast("int")).otherwise(F.lit(0))
    if cut:
        out = Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for _, c in cut], inputCols=[f"_x{i}" for i in range(len(cut))],
                         outputCols=[f"_b{i}" for i in range(len(cut))]).transform(out)
    for i, (_, c) in enumerate(cut):
        code = code * (len(c) + 1) + F.col(f"_b{i}").cast("int")
    return out.withColumn("_cell", code).drop(*[f"_{k}{i}" for i in range(len(cut)) for k in "xb"])


def _features_of(cells: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``cells`` with the vector of their bins, counted from 1."""
    from pyspark.ml.feature import VectorAssembler
    cols, rest = [], F.col("cell")
    for cut in reversed(cuts):
        cols.append((rest % (len(cut) + 1) + 1).cast("double"))
        rest = F.floor(rest / (len(cut) + 1))
    names = [f"_b{i}" for i in range(len(cuts))]
    out = cells.select("*", *[c.alias(n) for c, n in zip(reversed(cols), names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(out).drop(*names)


def _drawn_values(rows: DataFrame, n_cells: int, n_trees: int, seed: int) -> DataFrame:
    """``(tree, cell, w, y)``: draws of a cell and the mean label of the draws.  A task
    holds the sums of its rows by cell and tree, ``MAX_SUMS`` at most."""
    def draw(batches):
        import pandas as pd
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        w, wy = np.zeros((n_cells, n_trees)), np.zeros((n_cells, n_trees))
        for b in batches:
            if not len(b):
                continue
            cell, y = b["cell"].to_numpy(), b["y"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cell, y = cell[order], y[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            times = rng.poisson(1.0, (len(cell), n_trees)).astype(float)
            w[cell[first]] += np.add.reduceat(times, first, axis=0)
            times *= y[:, None]
            wy[cell[first]] += np.add.reduceat(times, first, axis=0)
        for at in range(0, n_cells, 500):
            c, t = np.nonzero(w[at:at + 500])
            if len(c):
                yield pd.DataFrame({"tree": t.astype("int32"), "cell": (c + at).astype("int32"), "w": w[at + c, t], "wy": wy[at + c, t]})

    drawn = rows.mapInPandas(draw, "tree int, cell int, w double, wy double")
    return (drawn.groupBy("tree", "cell").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
            .select("tree", "cell", "w", (F.col("wy") / F.col("w")).alias("y")))


def _drawn_classes(rows: DataFrame, n_cells: int, n_trees: int, seed: int) -> DataFrame:
    """``(tree, cell, w, y)``: draws of every class of a cell."""
    def draw(batches):
        import pandas as pd
        for b in batches:
            for cell, y, n in b.itertuples(index=False):
                w = np.random.default_rng([seed, int(cell), int(y)]).poisson(n, n_trees).astype(float)
                yield pd.DataFrame({"tree": np.arange(n_trees, dtype="int32"), "cell": np.int32(cell), "w": w, "y": y})[w > 0]

    counts = rows.groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"))
    return counts.mapInPandas(draw, "tree int, cell int, w double, y double")


def forest(train: DataFrame, test: DataFrame, features: list[str], label: str, problem: str,
           n_trees: int, max_depth: int, subset: str, seed: int = 42) -> DataFrame | None:
    """``test`` with the ``prediction`` of a forest; None where the bins of all features
    and the trees make more than ``MAX_SUMS`` sums, or there is no row to learn from."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.functions import vector_to_array
    from pyspark.util import inheritable_thread_target

    spark, classes = train.sparkSession, problem == "classification"
    y = F.col(label).cast("double")
    whole = F.when(y.isNull() | F.isnan(y) | ((y < 0) | (y != F.floor(y)) if classes else F.lit(False)), 1)
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.count(whole).alias("bad")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} labels are null, NaN or no class number")
    if not seen["n"]:
        return None
    cuts = bins_of(train, features)
    n_cells = math.prod(len(c) + 1 for c in cuts)
    if n_cells * n_trees > MAX_SUMS:
        return None
    rows = with_cell(train, features, cuts).select(F.col("_cell").alias("cell"), y.alias("y"))
    drawn = (_drawn_classes if classes else _drawn_values)(rows, n_cells, n_trees, seed)
    bags = materialize(drawn.repartition("tree"), "forest-bags", by="tree")
    cells = _features_of(spark.range(0, n_cells, 1, 1).select(F.col("id").cast("int").alias("cell")), cuts)

    def grow(t: int) -> DataFrame:
        kind = C.RandomForestClassifier if classes else R.RandomForestRegressor
        est = kind(numTrees=1, bootstrap=False, maxDepth=max_depth, maxBins=MAX_BINS, featureSubsetStrategy=subset,
                   seed=seed + t, labelCol="y", weightCol="w")
        out = est.fit(_features_of(bags.where(F.col("tree") == t), cuts)).transform(cells)
        return out.select("cell", F.posexplode(vector_to_array("rawPrediction")).alias("c", "p")) if classes \
            else out.select("cell", F.col("prediction").alias("p"))

    drawn_trees = sorted(r[0] for r in bags.select("tree").distinct().collect())
    with ThreadPool(min(FITS_AT_ONCE, len(drawn_trees))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(grow), drawn_trees, chunksize=1)
    votes = reduce(DataFrame.union, parts)
    if classes:      # trees vote by the class shares of their leaves; equal votes go to the smaller class
        total = votes.groupBy("cell", "c").agg(F.round(F.sum("p"), 9).alias("p"))
        won = total.groupBy("cell").agg(F.max_by("c", F.struct("p", -F.col("c"))).cast("double").alias("prediction"))
    else:
        won = votes.groupBy("cell").agg(F.avg("p").alias("prediction"))
    won = cut_lineage(won.withColumnRenamed("cell", "_cell"))
    return with_cell(test, features, cuts).join(broadcast_if_bounded(won, n_cells), "_cell").drop("_cell")
