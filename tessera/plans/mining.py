"""Frequent itemsets, association rules (G5, A1-A3, J2, J3) and graph
Apriori (H1-H4) over the driver tables.

Baskets are orders; items are the part's brand (25 values) or type (6).
Graphs are (user, day) event sessions; an edge joins the types of two
consecutive events (undirected: endpoints sorted).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import gspan, itemsets
from tessera.operators.graphs import adjacency, consecutive_edges, edge_label, transitions
from tessera.plans.registry import register
from tessera.session import cut_lineage
from tessera.sources.tables import load_table

BRAND_SUPPORT = 0.02
BRAND_CONFIDENCE = 0.1
TYPE_SUPPORT = 0.1
TYPE_CONFIDENCE = 0.3
GRAPH_MIN_COUNT = 20


def order_items(spark, sf, item_col):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = load_table(spark, sf, "part").select("p_partkey", item_col)
    return itemsets.basket_items(li.join(p, li.l_partkey == p.p_partkey), "l_orderkey", item_col)


def _tx_sql(item: str) -> str:
    return f"""
WITH tx AS (SELECT DISTINCT l.l_orderkey AS basket, p.{item} AS item
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
            WHERE p.{item} IS NOT NULL),
nb AS (SELECT COUNT(DISTINCT basket) AS n FROM tx)
"""


def _levels_sql(item: str, support: str, levels: int) -> str:
    """Levels 1..levels of frequent itemsets, each level counted from data
    with nested joins over the frequent items (anti-monotone pruning)."""
    sql = _tx_sql(item) + f"""
, c1 AS (SELECT [item] AS items, COUNT(*) AS c FROM tx GROUP BY item),
f1 AS (SELECT c1.* FROM c1, nb WHERE {support}),
t1 AS (SELECT tx.* FROM tx WHERE item IN (SELECT items[1] FROM f1))
"""
    if levels >= 2:
        sql += f"""
, c2 AS (SELECT [a.item, b.item] AS items, COUNT(*) AS c FROM t1 a JOIN t1 b
         ON a.basket = b.basket AND a.item < b.item GROUP BY a.item, b.item),
f2 AS (SELECT c2.* FROM c2, nb WHERE {support})
"""
    if levels >= 3:
        sql += f"""
, c3 AS (SELECT [a.item, b.item, c.item] AS items, COUNT(*) AS c FROM t1 a
         JOIN t1 b ON a.basket = b.basket AND a.item < b.item
         JOIN t1 c ON a.basket = c.basket AND b.item < c.item
         WHERE [a.item, b.item] IN (SELECT items FROM f2) AND [a.item, c.item] IN (SELECT items FROM f2)
           AND [b.item, c.item] IN (SELECT items FROM f2)
         GROUP BY a.item, b.item, c.item),
f3 AS (SELECT c3.* FROM c3, nb WHERE {support})
"""
    union = " UNION ALL ".join(f"SELECT {i} AS level, items, c FROM f{i}" for i in range(1, levels + 1))
    return sql + f", fa AS ({union})\n"


def _itemset_select(where: str = "") -> str:
    return f"""SELECT level, array_to_string(items, ', ') AS itemset, c AS support_count,
       c / nb.n AS support FROM fa, nb {where}"""


def _brand(spark, sf):
    return itemsets.mine(order_items(spark, sf, "p_brand"), min_support=BRAND_SUPPORT)


def _type(spark, sf):
    return itemsets.mine(order_items(spark, sf, "p_type"), min_support=TYPE_SUPPORT)


_BRAND_SUP = f"c / nb.n >= {BRAND_SUPPORT}"
_TYPE_SUP = f"c / nb.n >= {TYPE_SUPPORT}"


@register("baskets", _tx_sql("p_brand") + """
SELECT basket, list_sort(list(item)) AS items FROM tx GROUP BY basket""")
def baskets(spark, sf):
    return order_items(spark, sf, "p_brand").groupBy("basket") \
        .agg(F.array_sort(F.collect_list("item")).alias("items"))


@register("apriori_itemsets", _levels_sql("p_brand", _BRAND_SUP, 3) + _itemset_select())
def apriori_itemsets(spark, sf):
    return itemsets.itemset_table(_brand(spark, sf))


@register("apriori_l2", _levels_sql("p_type", _TYPE_SUP, 3) + _itemset_select("WHERE level = 2"))
def apriori_l2(spark, sf):
    return itemsets.itemset_table(_type(spark, sf)).where("level = 2")


@register("apriori_l3", _levels_sql("p_type", _TYPE_SUP, 3) + _itemset_select("WHERE level = 3"))
def apriori_l3(spark, sf):
    return itemsets.itemset_table(_type(spark, sf)).where("level = 3")


@register("fpgrowth_itemsets", _levels_sql("p_brand", _BRAND_SUP, 3) + _itemset_select())
def fpgrowth_itemsets(spark, sf):
    tx = order_items(spark, sf, "p_brand")
    b = tx.groupBy("basket").agg(F.collect_list("item").alias("items"))
    return itemsets.fpgrowth(b, BRAND_SUPPORT)


def _rules_sql(item: str, support: str, conf: float) -> str:
    return _levels_sql(item, support, 3) + f"""
, fs AS (SELECT items, c / nb.n AS support FROM fa, nb),
r AS (SELECT x.items, x.support, unnest(x.items) AS consequent FROM fs x WHERE len(x.items) > 1),
ra AS (SELECT list_filter(r.items, lambda e: e <> r.consequent) AS ante, r.consequent, r.support FROM r)
SELECT array_to_string(ra.ante, ', ') AS antecedent, ra.consequent, ra.support,
       ra.support / a.support AS confidence
FROM ra JOIN fs a ON a.items = ra.ante
WHERE ra.support / a.support >= {conf}"""


@register("assoc_rules", _rules_sql("p_brand", _BRAND_SUP, BRAND_CONFIDENCE))
def assoc_rules(spark, sf):
    return itemsets.association_rules(_brand(spark, sf).frequent, BRAND_CONFIDENCE)


@register("assoc_rules_types", _rules_sql("p_type", _TYPE_SUP, TYPE_CONFIDENCE))
def assoc_rules_types(spark, sf):
    return itemsets.association_rules(_type(spark, sf).frequent, TYPE_CONFIDENCE)


# ------------------------------------------------------------------ graph Apriori
def session_edges(spark, sf):
    """``(graph, src, dst)``: graph = user and day, edge = consecutive types."""
    e = load_table(spark, sf, "events").select(
        "event_id", "ts", "event_type",
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("graph"))
    return consecutive_edges(e, ["graph"], ["ts", "event_id"], "event_type")


def graph_tx(spark, sf):
    return itemsets.basket_items(
        session_edges(spark, sf).select("graph", edge_label("src", "dst").alias("edge")),
        "graph", "edge")


_EDGES_SQL = """
WITH s AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS graph, event_type,
                  LAG(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS prev
           FROM events),
ge AS (SELECT DISTINCT graph, least(prev, event_type) AS src, greatest(prev, event_type) AS dst
       FROM s WHERE prev IS NOT NULL),
tx AS (SELECT DISTINCT graph AS basket, '(' || src || ', ' || dst || ')' AS item FROM ge),
nb AS (SELECT COUNT(DISTINCT basket) AS n FROM tx)
"""


@register("graph_edges", _EDGES_SQL + "SELECT DISTINCT src, dst FROM ge")
def graph_edges(spark, sf):
    """All distinct (undirected) edges over the graph set."""
    return session_edges(spark, sf).select("src", "dst").distinct()


@register("graph_support", _EDGES_SQL + "SELECT item AS edge, COUNT(*) AS support FROM tx GROUP BY item")
def graph_support(spark, sf):
    """Support (graphs containing it) of every single edge."""
    m = itemsets.mine(graph_tx(spark, sf), min_count=GRAPH_MIN_COUNT, candidate_rule="extend",
                      max_level=1)
    return m.candidates.select(F.element_at("items", 1).alias("edge"),
                               F.col("support_count").alias("support"))


def _graph_levels_sql() -> str:
    m = GRAPH_MIN_COUNT
    return _EDGES_SQL + f"""
, c1 AS (SELECT [item] AS items, COUNT(*) AS c FROM tx GROUP BY item),
f1 AS (SELECT * FROM c1 WHERE c >= {m}),
k2 AS (SELECT [a.items[1], b.items[1]] AS items FROM f1 a JOIN f1 b ON a.items[1] < b.items[1]),
c2 AS (SELECT k2.items, COUNT(t2.basket) AS c FROM k2
       LEFT JOIN (SELECT a.basket, a.item AS x, b.item AS y FROM tx a JOIN tx b
                  ON a.basket = b.basket AND a.item < b.item) t2
       ON t2.x = k2.items[1] AND t2.y = k2.items[2] GROUP BY k2.items),
f2 AS (SELECT * FROM c2 WHERE c >= {m}),
k3 AS (SELECT DISTINCT list_sort(list_append(p.items, e.items[1])) AS items
       FROM f2 p JOIN f1 e ON NOT list_contains(p.items, e.items[1])),
c3 AS (SELECT k3.items, (SELECT COUNT(*) FROM (SELECT basket FROM tx WHERE item IN
          (k3.items[1], k3.items[2], k3.items[3]) GROUP BY basket HAVING COUNT(*) = 3)) AS c FROM k3),
f3 AS (SELECT * FROM c3 WHERE c >= {m}),
k4 AS (SELECT DISTINCT list_sort(list_append(p.items, e.items[1])) AS items
       FROM f3 p JOIN f1 e ON NOT list_contains(p.items, e.items[1])),
c4 AS (SELECT k4.items, (SELECT COUNT(*) FROM (SELECT basket FROM tx WHERE item IN
          (k4.items[1], k4.items[2], k4.items[3], k4.items[4]) GROUP BY basket HAVING COUNT(*) = 4)) AS c
       FROM k4),
allc AS (SELECT 1 AS level, items, c FROM c1 UNION ALL SELECT 2, items, c FROM c2
         UNION ALL SELECT 3, items, c FROM c3 UNION ALL SELECT 4, items, c FROM c4)
"""


@register("graph_apriori", _graph_levels_sql() + f"""
SELECT level, array_to_string(items, ' ') AS edge_set, c AS support FROM allc WHERE c >= {GRAPH_MIN_COUNT}""")
def graph_apriori(spark, sf):
    """Frequent k-edge sets (absolute support, no connectivity required)."""
    m = itemsets.mine(graph_tx(spark, sf), min_count=GRAPH_MIN_COUNT, candidate_rule="extend")
    return m.frequent.select("level", F.array_join("items", " ").alias("edge_set"),
                             F.col("support_count").alias("support"))


@register("graph_presence", _graph_levels_sql() + f"""
SELECT level, array_to_string(items, ' ') AS edge_set, c AS support,
       CASE WHEN c >= {GRAPH_MIN_COUNT} THEN 'Y' ELSE 'N' END AS qualify FROM allc""")
def graph_presence(spark, sf):
    """Every candidate of every level with its support and Y/N qualification
    (the per-graph presence is the sparse ``graph_presence_pairs`` table)."""
    m = itemsets.mine(graph_tx(spark, sf), min_count=GRAPH_MIN_COUNT, candidate_rule="extend")
    return m.candidates.select("level", F.array_join("items", " ").alias("edge_set"),
                               F.col("support_count").alias("support"),
                               F.when(F.col("frequent"), "Y").otherwise("N").alias("qualify"))


@register("graph_presence_pairs", _graph_levels_sql() + """
, cand AS (SELECT level, items FROM allc),
hit AS (SELECT c.level, c.items, t.basket FROM cand c JOIN tx t ON list_contains(c.items, t.item)
        GROUP BY c.level, c.items, t.basket HAVING COUNT(*) = len(c.items))
SELECT level, array_to_string(items, ' ') AS edge_set, basket AS graph FROM hit""")
def graph_presence_pairs(spark, sf):
    """Sparse presence table: every (candidate edge set, graph) where the graph
    holds all edges of the candidate (the Y cells of the presence table)."""
    tx = cut_lineage(graph_tx(spark, sf))
    m = itemsets.mine(tx, min_count=GRAPH_MIN_COUNT, candidate_rule="extend")
    hits = itemsets.member_baskets(itemsets.basket_classes(tx), m.candidates.select("items"))
    lv = m.candidates.select("items", "level")
    return hits.join(lv, "items").select("level", F.array_join("items", " ").alias("edge_set"),
                                         F.col("basket").alias("graph"))


# ------------------------------------------------------------------ gSpan (directed)
GSPAN_MIN_SUPPORT = 50


def session_adjacency(spark, sf):
    """Directed transition graphs of (user, day) sessions as adjacency rows."""
    e = load_table(spark, sf, "events").select(
        "event_id", "ts", "event_type",
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("graph"))
    return adjacency(transitions(e, ["graph"], ["ts", "event_id"], "event_type"), ["graph"], ["ts", "event_id"])


@register("graph_adjacency", """
WITH s AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS graph, ts, event_id, event_type,
                  LAG(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS prev
           FROM events),
t AS (SELECT graph, prev AS src, event_type AS dst, MIN((ts, event_id)) AS first FROM s
      WHERE prev IS NOT NULL GROUP BY graph, prev, event_type)
SELECT graph, src, CAST(ROW_NUMBER() OVER (PARTITION BY graph, src ORDER BY first) - 1 AS INTEGER) AS pos, dst
FROM t""")
def graph_adjacency(spark, sf):
    return session_adjacency(spark, sf)


@register("graph_dfs_codes")
def graph_dfs_codes(spark, sf):
    """DFS code of every session graph from its smallest vertex."""
    return gspan.dfs_codes(session_adjacency(spark, sf))


@register("graph_gspan")
def graph_gspan(spark, sf):
    """Frequent connected edge sets of the session graphs (absolute support)."""
    codes = gspan.dfs_codes(session_adjacency(spark, sf))
    fs = gspan.frequent_subgraphs(codes, GSPAN_MIN_SUPPORT)
    return fs.select("size", gspan.render_edges(F.col("edges")).alias("edge_set"),
                     F.array_join("edges", " ").alias("edge_keys"), "support")
