"""Sequential pattern queries (Q1-Q13, J4-J8): GSP and complete SPADE over
(user, day) event sessions.

GSP: an element is the set of event types of one 6-hour bucket of the day.
SPADE: every event row is its own event; its cell lists the event type and,
for values of at least 100, the tag ``big`` (a two-item cell).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequences
from tessera.plans.registry import register
from tessera.sources.tables import load_table

GSP_SUPPORT = 0.005
SPADE_SUPPORT = 0.005


def _sessions(spark, sf):
    e = load_table(spark, sf, "events")
    return e.select("event_id", "ts", "event_type", "value",
                    F.concat_ws(":", F.col("user_id").cast("string"),
                                F.to_date("ts").cast("string")).alias("session"))


def gsp_vertical(spark, sf):
    s = _sessions(spark, sf)
    return sequences.vertical_by_element(s, "session", F.floor(F.hour("ts") / 6), "event_type")


def spade_vertical(spark, sf):
    s = _sessions(spark, sf).select(
        "session", "ts", "event_id",
        F.concat_ws(",", "event_type", F.when(F.col("value") >= 100, F.lit("big"))).alias("cell"))
    return sequences.vertical_by_row(s, "session", ["ts", "event_id"], "cell")


def _gsp(spark, sf, elements=None):
    return sequences.mine_sequences(gsp_vertical(spark, sf), GSP_SUPPORT, elements)


def _spade(spark, sf, elements=None):
    """``elements``: longer patterns hold more items than a query of one length lists."""
    return sequences.mine_sequences(spade_vertical(spark, sf), SPADE_SUPPORT, elements)


# ------------------------------------------------------------------ SQL side
_GSP_ROWS = """
WITH v AS (SELECT DISTINCT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sid,
                  CAST(floor(hour(ts) / 6) AS BIGINT) AS eid, event_type AS item FROM events)
"""

_SPADE_ROWS = """
WITH r AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sid, ts, event_id,
                  event_type || CASE WHEN value >= 100 THEN ',big' ELSE '' END AS cell FROM events),
p AS (SELECT sid, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY ts, event_id) AS eid, cell FROM r),
v AS (SELECT DISTINCT sid, eid, trim(unnest(string_split(cell, ','))) AS item FROM p)
"""


def _patterns_sql(rows: str, support: float) -> str:
    """Frequent elements (itemsets of size <= 3 inside one event, support by
    sequence) and frequent sequences of up to 3 elements, by plain joins."""
    return rows + f"""
, nb AS (SELECT COUNT(DISTINCT sid) AS n FROM v),
e1 AS (SELECT sid, eid, [item] AS elem FROM v),
e2 AS (SELECT a.sid, a.eid, [a.item, b.item] AS elem FROM v a JOIN v b
       ON a.sid = b.sid AND a.eid = b.eid AND a.item < b.item),
e3 AS (SELECT a.sid, a.eid, [a.item, b.item, c.item] AS elem FROM v a
       JOIN v b ON a.sid = b.sid AND a.eid = b.eid AND a.item < b.item
       JOIN v c ON a.sid = c.sid AND a.eid = c.eid AND b.item < c.item),
ea AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3),
fe AS (SELECT elem FROM ea, nb GROUP BY elem, nb.n HAVING COUNT(DISTINCT sid) / nb.n >= {support}),
occ AS (SELECT ea.* FROM ea JOIN fe ON ea.elem = fe.elem),
fmt AS (SELECT elem, CASE WHEN len(elem) = 1 THEN elem[1]
                          ELSE '{{' || array_to_string(elem, ', ') || '}}' END AS f FROM fe),
s1 AS (SELECT 1 AS elements, '{{' || array_to_string(o.elem, ', ') || '}}' AS pattern,
              len(o.elem) AS length, COUNT(DISTINCT o.sid) AS c
       FROM occ o GROUP BY o.elem),
s2 AS (SELECT 2 AS elements, '<' || fa.f || ' -> ' || fb.f || '>' AS pattern,
              len(a.elem) + len(b.elem) AS length, COUNT(DISTINCT a.sid) AS c
       FROM occ a JOIN occ b ON a.sid = b.sid AND a.eid < b.eid
       JOIN fmt fa ON fa.elem = a.elem JOIN fmt fb ON fb.elem = b.elem
       GROUP BY fa.f, fb.f, len(a.elem), len(b.elem)),
f2 AS (SELECT s2.* FROM s2, nb WHERE c / nb.n >= {support}),
s3 AS (SELECT 3 AS elements, '<' || fa.f || ' -> ' || fb.f || ' -> ' || fc.f || '>' AS pattern,
              len(a.elem) + len(b.elem) + len(c.elem) AS length, COUNT(DISTINCT a.sid) AS c
       FROM occ a JOIN occ b ON a.sid = b.sid AND a.eid < b.eid
       JOIN occ c ON b.sid = c.sid AND b.eid < c.eid
       JOIN fmt fa ON fa.elem = a.elem JOIN fmt fb ON fb.elem = b.elem JOIN fmt fc ON fc.elem = c.elem
       WHERE '<' || fa.f || ' -> ' || fb.f || '>' IN (SELECT pattern FROM f2)
         AND '<' || fb.f || ' -> ' || fc.f || '>' IN (SELECT pattern FROM f2)
       GROUP BY fa.f, fb.f, fc.f, len(a.elem), len(b.elem), len(c.elem)),
alls AS (SELECT * FROM s1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM s3),
freq AS (SELECT elements, pattern, length,
                CASE WHEN elements = 1 THEN 'Itemset' ELSE 'Sequence' END AS pattern_type,
                c AS support_count, c / nb.n AS support
         FROM alls, nb WHERE c / nb.n >= {support})
"""


def _table(res, where=None):
    t = sequences.pattern_table(res.frequent)
    return t.where(where) if where else t


_GSP_SQL = _patterns_sql(_GSP_ROWS, GSP_SUPPORT)
_SPADE_SQL = _patterns_sql(_SPADE_ROWS, SPADE_SUPPORT)


@register("seq_horizontal", _GSP_ROWS + "SELECT sid, eid, list_sort(list(item)) AS items FROM v GROUP BY sid, eid")
def seq_horizontal(spark, sf):
    """Horizontal sequences in long form: one row per element, ordered by
    ``eid`` (a whole sequence is never gathered into one row)."""
    return sequences.transactions(gsp_vertical(spark, sf))


@register("seq_vertical", _SPADE_ROWS + "SELECT sid, eid, item FROM v")
def seq_vertical(spark, sf):
    return spade_vertical(spark, sf)


@register("seq_transactions", _SPADE_ROWS + "SELECT sid, eid, list_sort(list(item)) AS items FROM v GROUP BY sid, eid")
def seq_transactions(spark, sf):
    return sequences.transactions(spade_vertical(spark, sf))


@register("gsp_l1", _GSP_SQL + "SELECT * FROM freq WHERE elements = 1")
def gsp_l1(spark, sf):
    return _table(_gsp(spark, sf, 1), "elements = 1")


@register("gsp_l2", _GSP_SQL + "SELECT * FROM freq WHERE elements = 2")
def gsp_l2(spark, sf):
    return _table(_gsp(spark, sf, 2), "elements = 2")


@register("gsp_l3", _GSP_SQL + "SELECT * FROM freq WHERE elements = 3")
def gsp_l3(spark, sf):
    return _table(_gsp(spark, sf, 3), "elements = 3")


@register("gsp_patterns", _GSP_SQL + "SELECT * FROM freq")
def gsp_patterns(spark, sf):
    return _table(_gsp(spark, sf))


@register("spade_l1", _SPADE_SQL + "SELECT * FROM freq WHERE length = 1")
def spade_l1(spark, sf):
    return _table(_spade(spark, sf, 1), "length = 1")


@register("spade_l2", _SPADE_SQL + "SELECT * FROM freq WHERE length = 2")
def spade_l2(spark, sf):
    return _table(_spade(spark, sf, 2), "length = 2")


@register("spade_l3", _SPADE_SQL + "SELECT * FROM freq WHERE length = 3")
def spade_l3(spark, sf):
    return _table(_spade(spark, sf, 3), "length = 3")


@register("spade_patterns", _SPADE_SQL + "SELECT * FROM freq")
def spade_patterns(spark, sf):
    return _table(_spade(spark, sf))


@register("spade_itemset_join", _SPADE_ROWS + """
SELECT a.sid, a.eid FROM v a JOIN v b ON a.sid = b.sid AND a.eid = b.eid
WHERE a.item = 'click' AND b.item = 'big'""")
def spade_itemset_join(spark, sf):
    v = spade_vertical(spark, sf)
    return sequences.itemset_join(sequences.idlist(v, "click"), sequences.idlist(v, "big"))


@register("spade_temporal_join", _SPADE_ROWS + """
, fa AS (SELECT sid, MIN(eid) AS a_end FROM v WHERE item = 'view' GROUP BY sid)
SELECT b.sid, MIN(b.eid) AS eid FROM fa JOIN v b ON fa.sid = b.sid AND b.eid > fa.a_end
WHERE b.item = 'click' GROUP BY b.sid""")
def spade_temporal_join(spark, sf):
    v = spade_vertical(spark, sf)
    return sequences.temporal_join(sequences.idlist(v, "view"), sequences.idlist(v, "click"))


@register("spade_seq_itemset_join", _SPADE_ROWS + """
, a AS (SELECT x.sid, x.eid FROM v x JOIN v y ON x.sid = y.sid AND x.eid = y.eid
        WHERE x.item = 'view' AND y.item = 'big'),
b AS (SELECT x.sid, x.eid FROM v x JOIN v y ON x.sid = y.sid AND x.eid = y.eid
      WHERE x.item = 'click' AND y.item = 'big'),
fa AS (SELECT sid, MIN(eid) AS a_end FROM a GROUP BY sid)
SELECT b.sid, MIN(b.eid) AS eid FROM fa JOIN b ON fa.sid = b.sid AND b.eid > fa.a_end GROUP BY b.sid""")
def spade_seq_itemset_join(spark, sf):
    """``{view, big} -> {click, big}``: intersect each side, then temporal join."""
    v = spade_vertical(spark, sf)
    a = sequences.itemset_join(sequences.idlist(v, "view"), sequences.idlist(v, "big"))
    b = sequences.itemset_join(sequences.idlist(v, "click"), sequences.idlist(v, "big"))
    return sequences.temporal_join(a, b)


@register("spade_support", _SPADE_ROWS + """
, nb AS (SELECT COUNT(DISTINCT sid) AS n FROM v),
fa AS (SELECT sid, MIN(eid) AS a_end FROM v WHERE item = 'view' GROUP BY sid),
t AS (SELECT DISTINCT b.sid FROM fa JOIN v b ON fa.sid = b.sid AND b.eid > fa.a_end WHERE b.item = 'click')
SELECT '<view -> click>' AS pattern, COUNT(*) AS support_count, COUNT(*) / MAX(nb.n) AS support FROM t, nb""")
def spade_support(spark, sf):
    """Support of a pattern = distinct sequences in its joined ID-list / all."""
    v = spade_vertical(spark, sf)
    n = v.select("sid").distinct().count()
    j = sequences.temporal_join(sequences.idlist(v, "view"), sequences.idlist(v, "click"))
    return j.agg(F.lit("<view -> click>").alias("pattern"),
                 F.count(F.lit(1)).alias("support_count"),
                 (F.count(F.lit(1)) / F.lit(n)).alias("support"))
