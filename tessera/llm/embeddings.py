"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector with its own random hyperplanes, orders all
vectors by the concatenated sign bits, cuts that order into blocks of ``BLOCK``
rows and compares each block with itself and the next one, so a vector meets at
least its ``BLOCK`` nearest rows on either side.  Where more rows than that share
the pass's leading bits (a dense region), all blocks of the region are compared
with each other, so large groups lose nothing to the window.  A pair is counted
in the first pass that compares it, which a task can tell from the two rows'
positions in the earlier passes; no pair table is written.  Tasks return, per
vector, its links found and the root of its local component.

The number of passes follows from the number of vectors: it is the least that
finds a pair at the threshold with probability ``recall``, given the chance
that two such vectors agree in one sign bit.  Similarities are computed in
double precision; every link found is exact.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths never link; equal
vectors are one class with a multiplicity; a null id keeps its row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, roots
from tessera.llm.data import materialize
from tessera.operators.smoothing import series_positions

BLOCK = 1024
BITS = 30
SLICE = 256


def passes_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """``(passes, leading bits)`` for ``n`` vectors: so many leading bits that a
    region holds about one and a half blocks."""
    lead = min(BITS, max(0, math.ceil(math.log2(max(1.0, n / (1.5 * BLOCK))))))
    agree = (1 - math.acos(threshold) / math.pi) ** lead
    if agree >= recall:
        return 1, lead
    return math.ceil(math.log(1 - recall) / math.log(1 - agree)), lead


def _planes(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng(20240229 + dim).standard_normal((dim, passes * BITS))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column whose rows all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)              # so that squares neither over- nor underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), x


def sort_keys(classes: DataFrame, passes: int) -> DataFrame:
    """``(cid, dim, pass, bits)``: the sign bits of every vector in every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                dims = part.column("dim").to_numpy()
                for d in np.unique(dims):
                    rows = part.filter(pa.array(dims == d))
                    unit, _ = _units(rows.column("v"))
                    signs = (unit @ _planes(int(d), passes) > 0).reshape(-1, passes, BITS)
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(rows.column("cid").to_numpy(), passes)),
                         pa.array(np.full(n * passes, d, np.int32)),
                         pa.array(np.tile(np.arange(passes, dtype=np.int32), n)),
                         pa.array((signs @ weight).ravel())], names=["cid", "dim", "pass", "bits"])

    return classes.select("cid", "dim", "v").mapInArrow(run, "cid long, dim int, pass int, bits long")


def compare(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one task ``(dim, pass, i, j)``: block ``i`` with itself and with
    its neighbour ``j``; further blocks ``j`` of a dense region only where both
    rows share the leading bits."""
    now, i, j = (int(frame[c].iat[0]) for c in ("pass", "i", "j"))
    frame = frame.sort_values(["own", "cid"], ascending=[False, True])
    unit, _ = _units(pa.array(frame["v"]))
    block = np.vstack(frame["blocks"].to_numpy())
    lead = np.vstack(frame["leads"].to_numpy())
    m, cid = frame["m"].to_numpy(), frame["cid"].to_numpy()
    mine = int(frame["own"].sum())
    links = np.zeros(len(cid), np.int64)
    left, right = [], []
    for s in range(0, mine, SLICE):
        e = min(mine, s + SLICE)
        from_ = s if j == i + 1 else mine
        a, b = np.nonzero(unit[s:e] @ unit[from_:].T >= threshold)
        a, b = a + s, b + from_
        ok = a < b
        a, b = a[ok], b[ok]
        fresh = lead[a, now] == lead[b, now] if j > i + 1 else np.ones(len(a), bool)
        for q in range(now):                                  # not compared in an earlier pass
            fresh &= (lead[a, q] != lead[b, q]) & (np.abs(block[a, q] - block[b, q]) > 1)
        a, b = a[fresh], b[fresh]
        links += np.bincount(a, m[b], len(cid)).astype(np.int64) + np.bincount(b, m[a], len(cid)).astype(np.int64)
        if len(a):                                            # keep a star per local component only
            nodes, low = roots(a, b)
            left.append(nodes), right.append(low)
    if not left:
        return pd.DataFrame({"cid": cid[:0], "links": links[:0], "root": cid[:0]})
    nodes, low = roots(np.concatenate(left), np.concatenate(right))
    return pd.DataFrame({"cid": cid[nodes], "links": links[nodes], "root": cid[low]})


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                 recall: float = 0.999) -> DataFrame:
    """One row per vector: ``(key, n_links, component_id, kept)``."""
    v = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    same = F.when(good, F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))   # -0.0 equals 0.0
    rows = vectors.select(F.col(key).alias("id"), same.alias("v")).withColumn(
        "cid", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = materialize(rows.where("cid is not null").groupBy("cid").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("m")).withColumn("dim", F.size("v")), "vector-classes")
    n_passes, lead = passes_for(classes.count(), threshold, recall)

    order = series_positions(sort_keys(classes, n_passes), ["dim", "pass"], ["bits", "cid"])
    placed = order.select("cid", "dim", "pass", F.floor((F.col("_rn") - 1) / BLOCK).cast("int").alias("block"),
                          F.shiftright("bits", BITS - lead).cast("int").alias("lead"))
    placed = materialize(placed, "vector-blocks")
    spans = (placed.groupBy("dim", "pass", "lead").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
             .where("hi > lo + 1"))
    met = placed.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "lead"))).alias("p"))
    full = classes.join(met, "cid").select("cid", "dim", "v", "m", F.col("p.block").alias("blocks"),
                                           F.col("p.lead").alias("leads"), F.explode("p").alias("at"))
    full = full.select("cid", "dim", "v", "m", "blocks", "leads", "at.pass", "at.block", "at.lead")
    near = full.select("*", F.explode(F.array(F.struct(F.col("block").alias("i"), F.lit(True).alias("own")),
                                              F.struct((F.col("block") - 1).alias("i"), F.lit(False).alias("own"))))
                       .alias("t")).where("t.i >= 0").select("*", "t.i", (F.col("t.i") + 1).alias("j"), "t.own")
    dense = full.join(spans, ["dim", "pass", "lead"])
    dense = dense.select("*", F.explode(F.sequence("lo", "hi")).alias("other")).where("abs(block - other) > 1").select(
        *full.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") < F.col("other")).alias("own"))
    cols = ["dim", "pass", "i", "j", "own", "cid", "v", "m", "blocks", "leads"]
    tasks = near.select(*cols).unionByName(dense.select(*cols))
    found = materialize(tasks.groupBy("dim", "pass", "i", "j").applyInPandas(
        lambda frame: compare(frame, threshold), "cid long, links long, root long"), "vector-links")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = (rows.select("id", "cid").join(classes.select("cid", "m"), "cid", "left").join(links, "cid", "left")
             .join(comps.withColumnRenamed("node", "cid"), "cid", "left")
             .select("id", (F.coalesce("links", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1).alias("n_links"),
                     F.coalesce("comp", "cid").alias("comp")))
    first = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    got = named.join(first, "comp", "left").select(F.col("id").alias(key), "n_links",
                                                   F.coalesce("component_id", "id").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
