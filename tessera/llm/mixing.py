"""Mixing sources to target weights: subset-sum budget fitting.

Sources share a budget of words by weight; no target exceeds ``MOST`` times the
size of its source, and what that leaves over is shared again by weight among the
rest.  A source's documents are all taken ``target div size`` times; the rest
of its target is a budget that some of its documents, taken once more, must
fill.  Documents are counted by exact length in words.  Every length first
gives its share of the budget but for ``RESERVE`` words, and what remains is filled exactly, or as nearly
as can be, by bounded-knapsack dynamic programming over the lengths and the
counts still left.  Which documents of a length are taken follows a seeded hash of
id and text, so reruns agree whatever the partitioning.

Texts are read once; after that only ids, lengths and hashes move.  The
dynamic programme of a source sees its distinct lengths, not its documents, and
sums up to the remaining budget (at most ``RESERVE`` plus the longest document).
Documents of one source and length are ranked in cells of about ``CELL`` rows, so a
length that holds a third of all rows is spread over many tasks.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; rows of equal id, source and text
are counted as one row with a multiplicity before anything is shuffled and
returned as often as they came; a null id is an id like any other; an empty table
gives an empty result; if all sizes are 0 all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.data import materialize
from tessera.operators.smoothing import series_positions

MOST = 2
RESERVE = 1 << 14
CELL = 2048
COPIES = 10_000
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0), without a list of them."""
    marks = F.translate(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x"), BLANKS, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a
    source: ``share`` times all words by weight, weights repeating over the
    sources in code point order (null last), never above ``MOST`` times a source."""
    ordered = series_positions(sources.select("source", "source_size", F.col("source").isNull().alias("none"),
                                              F.lit(1).alias("all")), ["all"], ["none", "source"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("_rn") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = materialize(ordered.select("source", "source_size", weight.alias("weight")), "mix-sources")
    budget = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:  # words per unit of weight; only rises, and ends when no further source is full
        full = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        n, words, open_weight = rows.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0)),
                                         F.sum(F.when(~full, F.col("weight")))).first()
        if n == n_full or not open_weight:
            break
        level, n_full = (budget - float(words)) / float(open_weight), n
    own = F.col("weight") * F.lit(level)
    return rows.select("source", "source_size", F.least(own, (MOST * F.col("source_size")).cast("double")).alias("target"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most ``counts``) sum up nearest to ``budget``
    (the lower of two equally near sums)."""
    take = np.zeros(len(sizes), np.int64)
    usable = np.flatnonzero((sizes <= 2 * budget) & (counts > 0))
    if budget <= 0 or not len(usable):
        return take
    top = 2 * budget                                          # 0 is nearer than any sum beyond
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    step = np.full(top + 1, -1, np.int32)                     # the item that first reached a sum
    items: list[tuple[int, int]] = []
    for i in usable[np.argsort(-sizes[usable], kind="stable")].tolist():
        left, copies = min(int(counts[i]), top // int(sizes[i])), 1
        while left and not reached[budget]:                   # counts as powers of two and a rest
            copies = min(copies, left)
            add = copies * int(sizes[i])
            new = np.flatnonzero(reached[:top + 1 - add] & ~reached[add:]) + add
            reached[new], step[new] = True, len(items)
            items.append((i, copies))
            left, copies = left - copies, copies * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, copies = items[step[at]]
        take[i] += copies
        at -= copies * int(sizes[i])
    return take


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts taken of each size to fill ``budget`` words: a proportional share of
    every size, then the knapsack over what is left of budget and counts.  Of
    more than half of all words, what stays out is chosen in the same way."""
    order = np.argsort(-sizes, kind="stable")
    total = sum(int(s) * int(n) for s, n in zip(sizes, counts))
    if budget >= total:
        return counts.astype(np.int64)
    if 2 * budget > total:
        return counts - fill(sizes, counts, total - budget)
    take = np.array([int(n) * max(0, budget - RESERVE) // total for n in counts], np.int64)
    left = budget - sum(int(s) * int(t) for s, t in zip(sizes, take))
    for i in order.tolist():                                  # one more of a size while much is left
        if take[i] < counts[i] and left - int(sizes[i]) >= RESERVE:
            take[i] += 1
            left -= int(sizes[i])
    return take + knapsack(sizes, counts - take, left)


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """A source's distinct sizes with ``base`` (times each document is taken) and
    ``extra`` (documents of the size taken once more)."""
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    base = min(MOST, int(target // size)) if size else 0
    out = group[["source", "size", "n", "source_size", "target"]].copy()
    out["base"] = base
    out["extra"] = 0
    if size and base < MOST:
        order = np.argsort(group["size"].to_numpy(), kind="stable")
        sizes, counts = group["size"].to_numpy()[order].astype(np.int64), group["n"].to_numpy()[order].astype(np.int64)
        extra = np.zeros(len(order), np.int64)
        some = sizes > 0
        extra[some] = fill(sizes[some], counts[some], round(target - base * size))
        out.iloc[order, out.columns.get_loc("extra")] = extra
    return out


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, seed: int = 17, key: str = "doc_id",
        source: str = "source", text: str = "text") -> DataFrame:
    """``(key, size, source_size, target, taken)`` for every document: its words,
    those of its source, the words its source should give, and the words the
    mix takes of it (0, 1 or 2 times its size)."""
    own = docs.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
                      F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("tie"))
    rows = materialize(own.groupBy("doc", "source", "size", "tie").agg(F.count(F.lit(1)).alias("m")), "mix-rows")
    kinds = rows.groupBy("source", "size").agg(F.sum("m").alias("n"))
    total = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(total, weights, share).withColumnRenamed("source", "source_")
    kinds = kinds.join(goal, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    plan = kinds.groupBy("source").applyInPandas(
        _plan, "source string, size long, n long, source_size long, target double, base int, extra long")
    # documents of a kind are ranked by cell, then inside the cell that the cut falls into
    plan = materialize(plan.withColumn("cells", F.ceil(F.col("n") / CELL)), "mix-plan")
    cut = plan.where("cells > 1 and extra > 0 and extra < n").select("source", "size", "cells", "extra")
    full = (_of_kind(rows, cut).groupBy("source", "size", "extra", _cell().alias("cell")).agg(F.sum("m").alias("c")))
    running = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
    full = full.where("before < extra and extra <= before + c").select("source", "size", F.col("cell").alias("cut"), "before")
    plan = _of_kind(plan, full, "left")
    got = _of_kind(rows, plan).withColumn("cell", _cell())
    inside = Window.partitionBy("source", "size", "cell").orderBy("tie", "doc").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("m").over(inside), F.lit(0))
    room = (F.when(F.col("extra") == F.col("n"), F.col("m")).when(F.col("cut").isNull(), F.col("extra") - first)
            .when(F.col("cell") < F.col("cut"), F.col("m")).when(F.col("cell") > F.col("cut"), F.lit(0))
            .otherwise(F.col("extra") - F.col("before") - first))
    got = got.withColumn("k", F.greatest(F.lit(0), F.least(F.col("m"), room)))
    got = got.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COPIES))))
    got = got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("m") - F.col("part") * COPIES))))
    more = (F.col("part") * COPIES + F.col("copy") <= F.col("k")).cast("long")
    return got.select(F.col("doc").alias(key), "size", "source_size", "target",
                      (F.col("size") * (F.col("base") + more)).alias("taken"))


def _cell() -> Column:
    return F.pmod(F.col("tie"), F.col("cells"))


def _of_kind(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source (nulls equal) and size."""
    other = right.withColumnsRenamed({"source": "source__", "size": "size__"})
    return left.join(other, F.col("source").eqNullSafe(F.col("source__")) & (F.col("size") == F.col("size__")), how).drop("source__", "size__")
