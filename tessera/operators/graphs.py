"""Graph sets as edge tables: parsing, edge derivation, edge-set Apriori.

A graph set is an edge table ``(graph, src, dst)``; undirected edges keep
``src <= dst``.  Frequent edge-set mining is itemset mining with the edge as
item and the graph as basket (:mod:`tessera.operators.itemsets`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.smoothing import stencil


def edge_label(src: str | Column, dst: str | Column) -> Column:
    """``(a, b)`` rendering of an edge."""
    s = F.col(src) if isinstance(src, str) else src
    d = F.col(dst) if isinstance(dst, str) else dst
    return F.concat(F.lit("("), s, F.lit(", "), d, F.lit(")"))


def transitions(df: DataFrame, graph: list[str], order: list[str], label: str) -> DataFrame:
    """``(graph..., src, dst, order...)``: one row per pair of consecutive
    rows of a graph (``src`` = previous label, order columns of the later row)."""
    def compute(d, w):
        return d.select("*", F.lag(label, 1).over(w).alias("_prev"))

    out = stencil(df, graph, order, 1, 0, compute).where(F.col("_prev").isNotNull())
    return out.select(*graph, F.col("_prev").alias("src"), F.col(label).alias("dst"), *order)


def adjacency(trans: DataFrame, graph: list[str], order: list[str]) -> DataFrame:
    """Adjacency rows ``(graph..., src, pos, dst)``: the distinct successors of
    each vertex in order of their first transition (``pos`` from 0)."""
    from pyspark.sql import Window
    first = trans.groupBy(*graph, "src", "dst").agg(F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*graph, "src").orderBy("_first")
    return first.select(*graph, "src", (F.row_number().over(w) - 1).cast("int").alias("pos"), "dst")


def consecutive_edges(df: DataFrame, graph: list[str], order: list[str], label: str,
                      directed: bool = False) -> DataFrame:
    """Edges between the labels of consecutive rows of each graph (rows
    ordered by ``order``); distinct per graph.  Uses the bounded-block
    stencil, so one huge graph is not a single task."""
    def compute(d, w):
        return d.select("*", F.lag(label, 1).over(w).alias("_prev"))

    out = stencil(df, graph, order, 1, 0, compute).where(F.col("_prev").isNotNull())
    if directed:
        src, dst = F.col("_prev"), F.col(label)
    else:
        src = F.least(F.col("_prev"), F.col(label))
        dst = F.greatest(F.col("_prev"), F.col(label))
    return out.select(*graph, src.alias("src"), dst.alias("dst")).distinct()


def parse_edge_list_text(spark, path: str) -> DataFrame:
    """Multi-graph edge-list text files: a ``#`` line starts a graph, other
    non-blank lines are ``u v`` edges (endpoints sorted); a header with no
    edges gives no graph.  Graphs are numbered 1.. in file order per file.
    Output ``(file, graph_id, src, dst)``.

    Files are read line by line (a large file is split over tasks); the line
    order is frozen once by a checkpoint, the graph a line belongs to is the
    running count of header lines (range-partitioned prefix sum) and graph
    ids are ranks over the (file, header count) pairs that hold edges."""
    from tessera.operators.smoothing import series_positions, series_prefix_sum
    from tessera.session import cut_lineage
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line"),
                                       F.monotonically_increasing_id().alias("ln"))
    lines = cut_lineage(raw.where(F.col("line") != ""))
    tagged = series_prefix_sum(lines, ["file"], ["ln"], F.col("line").startswith("#").cast("long"))
    edges = tagged.where(~F.col("line").startswith("#")).select(
        "file", F.col("_cum").alias("blk"), F.array_sort(F.split("line", r"\s+")).alias("uv"))
    blocks = edges.select("file", "blk").distinct()
    gids = series_positions(blocks, ["file"], ["blk"]).select("file", "blk", F.col("_rn").alias("graph_id"))
    return (edges.join(gids, ["file", "blk"])
            .select("file", F.col("graph_id").cast("int").alias("graph_id"),
                    F.col("uv")[0].alias("src"), F.col("uv")[1].alias("dst")))
