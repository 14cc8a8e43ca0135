"""Sequential pattern mining (GSP and complete SPADE) on a vertical table.

Layout: distinct ``(sid, eid, item)`` rows; ``eid`` orders the events of a
sequence.  A pattern is ``array<array<string>>`` (elements of sorted items).

Engine (shared by GSP and SPADE):
1. Frequent *elements* (itemsets inside one event, support = distinct
   sequences) come from the level-wise itemset miner with the event as
   basket and the sequence as support unit.
2. Their occurrences ``(elem, sid, eid)`` are found by one join on the item.
3. A pattern's state per sequence is its minimal end event (greedy leftmost
   match is exact for subsequence containment).  Appending element E to a
   frequent pattern P: join ``state(P, sid, end)`` with the occurrences of E on
   ``(E, sid)`` keeping ``eid > end``; the new state is ``min(eid)`` and the
   support the number of sequences with a state.  The join is keyed by
   (element, sequence), so work is linear in occurrences x candidate
   patterns; event pairs inside a sequence are never enumerated.  Elements and
   patterns are numbers there; their items are kept in the small candidate tables.
Every level is checkpointed (reliable) to cut lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import format_sequence, sequence_length, split_trim
from tessera.functions.joins import broadcast_if_bounded
from tessera.operators import itemsets
from tessera.operators.smoothing import series_positions
from tessera.session import cut_lineage

CANDIDATE_BROADCAST_ROWS = 500_000


@dataclass
class SequenceResult:
    """``candidates``: every counted candidate ``(level, pattern,
    support_count, support, frequent)`` (level = number of elements);
    ``frequent``: the frequent ones; ``n_sequences``."""

    candidates: DataFrame
    frequent: DataFrame
    n_sequences: int


# ------------------------------------------------------------------ layouts
def vertical_by_row(df: DataFrame, sid: str, order: list[str], cell: str,
                    sep: str | None = ",") -> DataFrame:
    """SPADE layout: every row is its own event; ``eid`` = 1.. per sequence
    in ``order`` (a total order); a cell holding ``a, b`` gives two items."""
    pos = series_positions(df.select(F.col(sid).cast("string").alias("sid"), *order, cell),
                           ["sid"], order)
    items = split_trim(F.col(cell).cast("string"), sep) if sep else F.array(F.trim(F.col(cell).cast("string")))
    return (pos.select("sid", F.col("_rn").cast("long").alias("eid"), F.explode(items).alias("item"))
            .where(F.col("item").isNotNull() & (F.col("item") != "")).distinct())


def vertical_by_element(df: DataFrame, sid: str, element_key: Column, item: str) -> DataFrame:
    """GSP layout: all items of a sequence that share ``element_key`` (e.g.
    a date or a time bucket, orderable) form one element."""
    return (df.select(F.col(sid).cast("string").alias("sid"), element_key.cast("long").alias("eid"),
                      F.col(item).cast("string").alias("item"))
            .where(F.col("sid").isNotNull() & F.col("eid").isNotNull() & F.col("item").isNotNull())
            .distinct())


def transactions(vertical: DataFrame) -> DataFrame:
    """``(sid, eid, items)``: the set of items of every event (sorted)."""
    return vertical.groupBy("sid", "eid").agg(F.array_sort(F.collect_set("item")).alias("items"))


# ------------------------------------------------------------------ engine
def frequent_elements(vertical: DataFrame, min_support: float) -> tuple[itemsets.Mined, DataFrame, DataFrame]:
    """Frequent itemsets inside single events (support = distinct sequences),
    their numbers ``(elem, e)`` and their occurrences ``(e, sid, eid)``."""
    tx = vertical.select(F.struct("sid", "eid").alias("basket"), "item", F.col("sid").alias("unit"))
    mined = itemsets.mine(tx, min_support=min_support)
    codes = cut_lineage(mined.frequent.select(F.col("items").alias("elem"), F.monotonically_increasing_id().alias("e")))
    occ = (itemsets.containing_baskets(tx, mined.frequent.select("items")).withColumnRenamed("items", "elem")
           .join(broadcast_if_bounded(codes, CANDIDATE_BROADCAST_ROWS), "elem")
           .select("e", F.col("basket.sid").alias("sid"), F.col("basket.eid").alias("eid")))
    return mined, codes, cut_lineage(occ)


def _gsp_candidates(freq: DataFrame, k: int) -> DataFrame:
    """``(prefix, elem)`` pairs, k > 2, of frequent (k-1)-sequences whose last k-2
    elements of the first equal the first k-2 of the second (GSP join).
    Both sides are frequent patterns, so the join is small."""
    a = freq.select(F.col("pattern").alias("prefix"), F.slice("pattern", 2, k - 2).alias("overlap"))
    b = freq.select(F.element_at("pattern", k - 1).alias("elem"), F.slice("pattern", 1, k - 2).alias("overlap"))
    return a.join(b, "overlap").select("prefix", "elem").distinct()


def _element_pairs(occ: DataFrame) -> DataFrame:
    """``(prefix, elem, support_count)`` of the ordered pairs that occur: the first
    place of one element lies before the last place of the other in a sequence.
    Pairs are counted from the occurrences, never listed beforehand."""
    ends = occ.groupBy("elem", "sid").agg(F.min("eid").alias("first"), F.max("eid").alias("last"))
    a = ends.select("sid", "first", F.col("elem").alias("x"))
    b = ends.select("sid", "last", F.col("elem").alias("y"))
    pairs = a.join(b, "sid").where(F.col("first") < F.col("last"))
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("support_count")).select(
        F.array("x").alias("prefix"), F.col("y").alias("elem"), "support_count")


def mine_sequences(vertical: DataFrame, min_support: float,
                   max_elements: int | None = None) -> SequenceResult:
    """All frequent sequential patterns: support = distinct sequences that
    contain the pattern / all sequences, frequent iff ``>= min_support``."""
    n = vertical.select("sid").distinct().count()
    spark = vertical.sparkSession
    schema = "level int, pattern array<array<string>>, support_count long, support double, frequent boolean"
    if n == 0:
        e = spark.createDataFrame([], schema)
        return SequenceResult(e, e, 0)
    vertical = cut_lineage(vertical)
    mined, codes, occ = frequent_elements(vertical, min_support)
    sup = F.col("support_count") / F.lit(n)

    level1 = mined.frequent.select(F.lit(1).alias("level"), F.array("items").alias("pattern"),
                                   "support_count", sup.alias("support"), F.lit(True).alias("frequent"))
    levels = [cut_lineage(level1)]
    # what is joined and grouped at size carries numbers of elements (e) and patterns (p); ``path``: a pattern's element numbers
    freq = codes.select(F.col("e").alias("p"), F.array("e").alias("path"), F.array("elem").alias("pattern"))
    state = cut_lineage(occ.groupBy(F.col("e").alias("p"), "sid").agg(F.min("eid").alias("end")))
    k = 1
    while (max_elements is None or k < max_elements) and not freq.isEmpty():
        k += 1
        found = _element_pairs(occ.withColumnRenamed("e", "elem")) if k == 2 else \
            _gsp_candidates(freq.select(F.col("path").alias("pattern")), k)
        cands = cut_lineage(
            found.withColumnRenamed("elem", "e").join(freq.withColumnRenamed("path", "prefix"), "prefix").join(codes, "e")
            .select(F.monotonically_increasing_id().alias("q"), "p", "e", F.concat("prefix", F.array("e")).alias("path"),
                    F.concat("pattern", F.array("elem")).alias("pattern"), *(["support_count"] if k == 2 else [])))
        if k == 2:
            allc = cands.select("*", sup.alias("support"), (sup >= F.lit(min_support)).alias("frequent"))
            grow = allc.where("frequent")                     # only frequent pairs need a state
        else:
            grow = cands
        if k > 2 and grow.isEmpty():
            break
        if k > 2 or (k != max_elements and not grow.isEmpty()):
            grown = (state.join(broadcast_if_bounded(grow.select("p", "e", "q"), CANDIDATE_BROADCAST_ROWS), "p")
                     .join(occ.withColumnRenamed("eid", "at"), ["e", "sid"])
                     .where(F.col("at") > F.col("end"))
                     .groupBy("e", "sid", "q").agg(F.min("at").alias("end")))
            # rows of patterns that turn out infrequent stay: no candidate has them as prefix
            state = cut_lineage(grown.select(F.col("q").alias("p"), "sid", "end"))
        if k > 2:
            counts = state.groupBy(F.col("p").alias("q")).agg(F.count(F.lit(1)).alias("support_count"))
            counted = cands.join(counts, "q", "left").withColumn("support_count", F.coalesce("support_count", F.lit(0)).cast("long"))
            allc = cut_lineage(counted.select("*", sup.alias("support"), (sup >= F.lit(min_support)).alias("frequent")))
        levels.append(allc.select(F.lit(k).alias("level"), "pattern", "support_count", "support", "frequent"))
        freq = allc.where("frequent").select(F.col("q").alias("p"), "path", "pattern")
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return SequenceResult(out, out.where("frequent"), n)


def pattern_table(df: DataFrame) -> DataFrame:
    """Readable form: ``pattern ({a, b} / <a -> {b, c}>), elements, length
    (items), pattern_type (Itemset/Sequence), support_count, support``."""
    return df.select(format_sequence(F.col("pattern")).alias("pattern"),
                     F.col("level").alias("elements"),
                     sequence_length(F.col("pattern")).cast("long").alias("length"),
                     F.when(F.col("level") == 1, "Itemset").otherwise("Sequence").alias("pattern_type"),
                     "support_count", "support")


# ------------------------------------------------------------------ ID-list joins
def idlist(vertical: DataFrame, item: str) -> DataFrame:
    """ID-list of one item: ``(sid, eid)``."""
    return vertical.where(F.col("item") == item).select("sid", "eid").distinct()


def itemset_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same-event join of two ID-lists: events holding both."""
    return a.join(b, ["sid", "eid"]).select("sid", "eid")


def temporal_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a -> b``: per sequence, the first ``b`` event after the first ``a``
    event (one row per sequence; the min-end state of the pattern)."""
    first_a = a.groupBy("sid").agg(F.min("eid").alias("a_end"))
    return (first_a.join(b, "sid").where(F.col("eid") > F.col("a_end"))
            .groupBy("sid").agg(F.min("eid").alias("eid")))
