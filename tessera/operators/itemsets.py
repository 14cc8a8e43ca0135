"""Frequent itemsets (level-wise Apriori, FP-growth) and association rules.

Data layout: distinct ``(basket, item)`` rows.  Support of a candidate is
counted by joining the exploded candidates to those rows *on the item* and
keeping the ``(candidate, basket)`` groups that matched all ``k`` items: the
work is linear in the rows times the candidates containing each item, and
item pairs inside one basket are never enumerated, so a huge basket costs
no more than its own rows.  Where candidates are counted by this join alone,
baskets of equal items are one weighted basket first.  Candidates are small (built only from frequent
sets); they are broadcast only under a checked row bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import require_columns
from tessera.functions.joins import broadcast_if_bounded
from tessera.session import cut_lineage

CANDIDATE_BROADCAST_ROWS = 500_000
SMALL_BASKET = 64  # baskets up to this many items extend their own frequent sets
PAIR_BUCKETS = 1 << 18  # hashed pair counters of the second level


@dataclass
class Mined:
    """Level-wise result: ``candidates`` has every counted candidate
    ``(level, items, support_count, support, frequent)``; ``frequent`` the
    frequent ones; ``n_baskets`` the basket count."""

    candidates: DataFrame
    frequent: DataFrame
    n_baskets: int


def basket_items(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``(basket, item)`` rows, items cast to string, nulls dropped."""
    require_columns(df, [basket, item])
    return (df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item"))
            .where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct())


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Group to set: ``(basket, items)`` with the items sorted."""
    return (basket_items(df, basket, item).groupBy("basket")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def containing_baskets(tx: DataFrame, cands: DataFrame, k: int | None = None) -> DataFrame:
    """``(items, basket[, unit])`` for every basket that holds all items of a
    candidate: exploded candidates joined to the rows on the item, groups
    kept when every item matched (candidates may differ in size).

    The hot aggregation is keyed by an integer candidate id, and baskets
    holding fewer candidate items than the smallest candidate are dropped
    before the join.  A ``weight`` column of ``tx`` (see :func:`basket_classes`)
    is carried along."""
    ids = cut_lineage(cands.select("items").distinct()
                      .select("items", F.monotonically_increasing_id().alias("cid"),
                              F.size("items").alias("m")))
    # one small job sizes every candidate-derived side: exploded rows = sum(m)
    st = ids.agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("k_min"), F.sum("m").alias("cells")).first()
    small = (st["cells"] or 0) <= CANDIDATE_BROADCAST_ROWS

    def side(df):
        return F.broadcast(df) if small else df

    exploded = ids.select("cid", "m", F.explode("items").alias("item"))
    cand_items = exploded.select("item").distinct()
    rows = tx.join(side(cand_items), "item", "left_semi")
    k_min = st["k_min"] or 0
    if k_min > 1:
        big = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("_nb")).where(F.col("_nb") >= k_min)
        rows = rows.join(big.select("basket"), "basket", "left_semi")
    keys = ["cid", "m", "basket"] + [c for c in ("unit", "weight") if c in tx.columns]
    hits = (rows.join(side(exploded), "item")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("hit"))
            .where(F.col("hit") == F.col("m")).drop("hit", "m"))
    out = hits.join(side(ids.select("cid", "items")), "cid")
    return out.select("items", *[c for c in keys if c not in ("cid", "m")])


def count_support(tx: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """``(items, support_count)`` for each candidate ``items`` of size ``k``
    (zero-support candidates included).  With a ``unit`` column in ``tx``
    support counts distinct units (e.g. sequences) instead of baskets, with a
    ``weight`` column the weights of the baskets."""
    hits = containing_baskets(tx, cands, k)
    if "unit" in tx.columns:
        hits = hits.select("items", "unit").distinct()
    each = F.sum("weight") if "weight" in tx.columns else F.count(F.lit(1))
    hits = hits.groupBy("items").agg(each.alias("support_count"))
    return (cands.join(hits, "items", "left")
            .select("items", F.coalesce("support_count", F.lit(0)).cast("long").alias("support_count")))


@dataclass
class Classes:
    """Baskets by equal item sets: ``rows`` ``(basket, item, weight)`` with the class
    number as basket and its number of baskets as weight; ``members``
    ``(basket, class)``; ``sizes`` ``(class, weight)``."""

    rows: DataFrame
    members: DataFrame
    sizes: DataFrame


def basket_classes(tx: DataFrame) -> Classes:
    """Group the baskets of distinct ``(basket, item)`` rows that hold the same items, so
    that a candidate is looked up once a class.  Sets of at most ``SMALL_BASKET`` items
    are compared as a whole; a larger basket is a class of its own and stays in rows."""
    sizes = tx.groupBy("basket").agg(F.count(F.lit(1)).alias("_sz"))
    small, big = (tx.join(sizes.where(c), "basket", "left_semi")
                  for c in (F.col("_sz") <= SMALL_BASKET, F.col("_sz") > SMALL_BASKET))
    sets = small.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    alone = big.select("basket").distinct()
    kinds = cut_lineage(
        sets.groupBy("items").agg(F.count(F.lit(1)).alias("weight"), F.lit(None).cast(tx.schema["basket"].dataType).alias("basket"))
        .unionByName(alone.select("basket", F.lit(1).cast("long").alias("weight"),
                                  F.lit(None).cast("array<string>").alias("items")))
        .withColumn("class", F.monotonically_increasing_id()))
    whole = kinds.where(F.col("items").isNotNull())
    single = kinds.where(F.col("items").isNull()).select("basket", "class", "weight")
    rows = (whole.select(F.col("class").alias("basket"), F.explode("items").alias("item"), "weight")
            .unionByName(big.join(single, "basket").select(F.col("class").alias("basket"), "item", "weight")))
    members = (sets.join(broadcast_if_bounded(whole.select("items", "class")), "items").select("basket", "class")
               .unionByName(single.select("basket", "class")))
    return Classes(cut_lineage(rows), members, kinds.select("class", "weight"))


MEMBERS_PER_SALT = 20_000


def member_baskets(classes: Classes, cands: DataFrame) -> DataFrame:
    """``(items, basket)`` as :func:`containing_baskets`, found once a class.  A class of many
    baskets is dealt out by salt; what was found for it is repeated once a salt."""
    found = containing_baskets(classes.rows, cands).select("items", F.col("basket").alias("class"), "weight")
    salts = F.ceil(F.col("weight") / MEMBERS_PER_SALT)
    found = found.select("items", "class", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    members = (classes.members.join(broadcast_if_bounded(classes.sizes), "class")
               .select("basket", "class", F.pmod(F.xxhash64("basket"), salts).alias("salt")))
    return found.join(members, ["class", "salt"]).select("items", "basket")


def _prefix_candidates(freq: DataFrame, k: int) -> DataFrame:
    """(k+1)-candidates, k > 1: two frequent k-sets sharing their first k-1 items,
    then pruned to those whose every k-subset is frequent."""
    a = freq.select(F.col("items").alias("a"), F.slice("items", 1, k - 1).alias("prefix"))
    b = freq.select(F.element_at("items", k).alias("b"), F.slice("items", 1, k - 1).alias("prefix"))
    joined = a.join(b, "prefix").where(F.element_at("a", k) < F.col("b"))
    cands = joined.select(F.concat("a", F.array("b")).alias("items"))
    subsets = cands.select("items", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(k)),
        lambda i: F.filter("items", lambda x, j: j != i))).alias("sub"))
    missing = subsets.join(freq.select(F.col("items").alias("sub")), "sub", "left_anti").select("items")
    return cands.join(missing.distinct(), "items", "left_anti")


def _pair_occurrences(hits: DataFrame, big: DataFrame | None, enough, extra: list[str]) -> DataFrame:
    """``(items, basket[, unit])`` of the pairs in small baskets that may be frequent.

    Pairs are first counted by hash into ``PAIR_BUCKETS`` counters; only those whose
    counter, with what large baskets (``big``: item and number of its large
    baskets) can add, reaches the threshold go on to exact counting."""
    own = hits.select(F.element_at("items", 1).alias("a"), "basket", *extra)
    if big is not None:
        own = own.join(big.select(F.col("item").alias("a"), "more"), "a", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    else:
        own = own.withColumn("more", F.lit(0))
    other = own.select(F.col("a").alias("b"), F.col("more").alias("more_b"), "basket")
    pairs = own.join(other, "basket").where(F.col("a") < F.col("b")).withColumn(
        "bucket", F.pmod(F.xxhash64("a", "b"), F.lit(PAIR_BUCKETS)).cast("int"))
    counters = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"))     # at most PAIR_BUCKETS rows
    if big is None:
        counters = counters.where(enough(F.col("in_bucket")))
    pairs = pairs.join(F.broadcast(counters), "bucket").where(enough(F.col("in_bucket") + F.least("more", "more_b")))
    return pairs.select(F.array("a", "b").alias("items"), "basket", *extra)


def _heavy_pairs(items: DataFrame, block: int = 1000) -> DataFrame:
    """All pairs of the items, block of items by block."""
    from tessera.operators.smoothing import series_positions
    numbered = cut_lineage(series_positions(items.select("item"), [], ["item"]).select("item", F.floor((F.col("_rn") - 1) / block).alias("blk")))
    blocks = numbered.groupBy("blk").agg(F.collect_list("item").alias("others"))
    top = (numbered.agg(F.max("blk")).first()[0] or 0)
    wide = numbered.select("item", F.explode(F.sequence("blk", F.lit(top))).alias("blk")).join(blocks, "blk")
    pairs = wide.select("item", F.explode("others").alias("o")).where(F.col("item") < F.col("o"))
    return pairs.select(F.array("item", "o").alias("items"))


def _extend_candidates(freq: DataFrame, singles: DataFrame) -> DataFrame:
    """Candidates = a frequent set plus one frequent single item not in it
    (sorted, deduplicated).  Both sides are frequent sets: small."""
    s = singles.select(F.element_at("items", 1).alias("e"))
    j = freq.join(broadcast_if_bounded(s, CANDIDATE_BROADCAST_ROWS),
                  ~F.array_contains(F.col("items"), F.col("e")))
    return j.select(F.array_sort(F.array_append("items", F.col("e"))).alias("items")).distinct()


def mine(tx: DataFrame, min_support: float | None = None, min_count: int | None = None,
         candidate_rule: str = "prefix", max_level: int | None = None) -> Mined:
    """Level-wise frequent itemset mining over distinct ``(basket, item)`` rows
    (optionally ``unit``: support then counts distinct units, e.g. the
    sequences the baskets belong to).

    Frequent iff ``count / n_baskets >= min_support`` (relative) or
    ``count >= min_count`` (absolute).  ``candidate_rule`` is ``prefix``
    (hashed pair counters, then Apriori join + subset prune; pairs that the
    counters rule out are not listed) or ``extend`` (frequent set + one frequent
    item; lists every such candidate, also the infrequent ones)."""
    if (min_support is None) == (min_count is None):
        raise ValueError("give exactly one of min_support / min_count")
    unit = "unit" if "unit" in tx.columns else "basket"
    n = tx.select(unit).distinct().count()
    spark = tx.sparkSession
    empty_schema = "level int, items array<string>, support_count long, support double, frequent boolean"
    if n == 0:
        e = spark.createDataFrame([], empty_schema)
        return Mined(e, e, 0)

    def enough(count):
        return (count / F.lit(n) >= F.lit(min_support)) if min_support is not None else (count >= F.lit(min_count))

    def label(counts: DataFrame, level: int) -> DataFrame:
        sup = F.col("support_count") / F.lit(n)
        ok = enough(F.col("support_count"))
        return counts.select(F.lit(level).alias("level"), "items", "support_count",
                             sup.alias("support"), ok.alias("frequent"))

    tx = cut_lineage(tx)
    level1 = tx.select("item", unit).distinct() \
        .groupBy("item").agg(F.count(F.lit(1)).alias("support_count")) \
        .select(F.array("item").alias("items"), F.col("support_count").cast("long").alias("support_count"))
    cur = cut_lineage(label(level1, 1))
    levels = [cur]
    freq = cur.where("frequent").select("items")
    singles = freq
    extra = ["unit"] if "unit" in tx.columns else []
    if candidate_rule == "prefix":
        # Hybrid exact counting: baskets of at most SMALL_BASKET items extend
        # their own frequent-set occurrences (bounded work per basket); larger
        # baskets go through the candidate join, so no big basket is expanded.
        sizes = tx.groupBy("basket").agg(F.count(F.lit(1)).alias("_sz"))
        small = sizes.where(F.col("_sz") <= SMALL_BASKET).select("basket")
        tx_small = cut_lineage(tx.join(small, "basket", "left_semi"))
        tx_big = cut_lineage(tx.join(small, "basket", "left_anti"))
        has_big = tx_big.limit(1).count() > 0
        hits = cut_lineage(tx_small.join(freq.select(F.element_at("items", 1).alias("item")), "item")
                           .select(F.array("item").alias("items"), "basket", *extra))
    elif max_level is None or max_level > 1:
        counted = tx if extra else basket_classes(tx).rows     # equal baskets are looked up once
    k = 1
    while (max_level is None or k < max_level) and freq.limit(1).count() > 0:
        ext = None
        if candidate_rule == "prefix" and k == 1:
            big = (tx_big.groupBy("item").agg(F.count(F.lit(1)).alias("more")) if has_big else None)
            ext = cut_lineage(_pair_occurrences(hits, big, enough, extra))
            cands = ext.select("items").distinct()
            if has_big:
                heavy = big.where(enough(F.col("more"))).join(freq.select(F.element_at("items", 1).alias("item")), "item", "left_semi")
                cands = cands.union(_heavy_pairs(heavy)).distinct()
        elif candidate_rule == "prefix":
            cands = _prefix_candidates(freq, k)
        elif candidate_rule == "extend":
            cands = _extend_candidates(freq, singles)
        else:
            raise ValueError(f"unknown candidate rule {candidate_rule!r}")
        cands = cut_lineage(cands)
        if cands.limit(1).count() == 0:
            break
        k += 1
        if candidate_rule == "prefix":
            if ext is None:
                nxt = tx_small.select("basket", F.col("item").alias("_nx"))
                ext = (hits.join(nxt, "basket").where(F.col("_nx") > F.element_at("items", -1))
                       .select(F.concat("items", F.array("_nx")).alias("items"), "basket", *extra)
                       .join(broadcast_if_bounded(cands, CANDIDATE_BROADCAST_ROWS), "items", "left_semi"))
                ext = cut_lineage(ext)
            found = ext
            if has_big:
                found = found.unionByName(containing_baskets(tx_big, cands))
            if extra:
                found = found.select("items", "unit").distinct()
            counts = found.groupBy("items").agg(F.count(F.lit(1)).alias("support_count"))
            counts = (cands.join(counts, "items", "left")
                      .select("items", F.coalesce("support_count", F.lit(0)).cast("long").alias("support_count")))
            cur = cut_lineage(label(counts, k))
            freq = cur.where("frequent").select("items")
            hits = cut_lineage(ext.join(freq, "items", "left_semi"))
        else:
            cur = cut_lineage(label(count_support(counted, cands, k), k))
            freq = cur.where("frequent").select("items")
        levels.append(cur)
    allc = levels[0]
    for lv in levels[1:]:
        allc = allc.unionByName(lv)
    return Mined(allc, allc.where("frequent"), n)


def itemset_table(mined: Mined) -> DataFrame:
    """``level, itemset ("a, b"), support_count, support`` of the frequent sets."""
    return mined.frequent.select("level", F.array_join("items", ", ").alias("itemset"),
                                 "support_count", "support")


def fpgrowth(df_baskets: DataFrame, min_support: float, n_baskets: int | None = None,
             num_partitions: int | None = None) -> DataFrame:
    """Frequent itemsets with Spark's parallel FP-growth, exact boundary:
    FP-growth keeps ``count >= ceil(s * n)``; it is run slightly below ``s``
    and post-filtered with ``count / n >= s``.  Input ``(basket, items)``.
    Output as :func:`itemset_table`."""
    from pyspark.ml.fpm import FPGrowth

    n = n_baskets if n_baskets is not None else df_baskets.count()
    if n == 0:
        return df_baskets.sparkSession.createDataFrame(
            [], "level int, itemset string, support_count long, support double")
    fp = FPGrowth(itemsCol="items", minSupport=max(min_support - 1e-9, 0.0), minConfidence=0.0)
    if num_partitions:
        fp.setNumPartitions(num_partitions)
    model = fp.fit(df_baskets.select("items"))
    sets = model.freqItemsets
    return (sets.where(F.col("freq") / F.lit(n) >= F.lit(min_support))
            .select(F.size("items").alias("level"),
                    F.array_join(F.array_sort("items"), ", ").alias("itemset"),
                    F.col("freq").cast("long").alias("support_count"),
                    (F.col("freq") / F.lit(n)).alias("support")))


def association_rules(frequent: DataFrame, min_confidence: float) -> DataFrame:
    """Single-item-consequent rules of every frequent set of size > 1:
    confidence = support(X) / support(X minus consequent) >= min_confidence.
    Output ``antecedent, consequent, support, confidence``."""
    big = frequent.where(F.size("items") > 1).select("items", "support")
    rules = big.select("items", "support", F.explode("items").alias("consequent"))
    rules = rules.select(F.array_remove("items", F.col("consequent")).alias("ante"), "consequent",
                         "support")
    ante = frequent.select(F.col("items").alias("ante"), F.col("support").alias("ante_support"))
    joined = rules.join(ante, "ante")
    conf = F.col("support") / F.col("ante_support")
    return joined.where(conf >= F.lit(min_confidence)).select(
        F.array_join("ante", ", ").alias("antecedent"), F.col("consequent"),
        "support", conf.alias("confidence"))
