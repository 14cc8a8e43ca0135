"""Star schema, cubes and OLAP queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import olap
from tessera.plans.inputs import SALES_FLAT_SQL, nation_region, sales_by_customer, sales_flat
from tessera.plans.registry import register
from tessera.sources.tables import load_table

CUBE_DIMS = ["n_name", "c_mktsegment", "l_returnflag"]
MEASURES = ["l_quantity", "l_extendedprice"]
DIMENSIONS = [
    olap.Dimension("customer", ("c_custkey", "c_name", "c_mktsegment"), "c_custkey"),
    olap.Dimension("nation", ("n_nationkey", "n_name", "r_name"), "n_nationkey",
                   ("r_name", "n_name")),
    olap.Dimension("returnflag", ("l_returnflag",), "l_returnflag"),
]


def _money_sum(col: str) -> str:
    return f"CAST(SUM(CAST({col} AS DECIMAL(18,2))) AS DOUBLE) AS {col}"


def _cubes_sql(dims: list[str]) -> str:
    """Every non-empty dimension combination as its own plain GROUP BY."""
    parts = []
    sets = [c for k in range(1, len(dims) + 1) for c in combinations(dims, k)]
    for no, s in enumerate(sets, start=1):
        keys = ", ".join(d if d in s else f"CAST(NULL AS VARCHAR) AS {d}" for d in dims)
        where = " AND ".join(f"{d} IS NOT NULL" for d in s)
        parts.append(
            f"SELECT '{olap.cube_name(s)}' AS cube, CAST({no} AS INTEGER) AS cube_no, {keys}, "
            f"{', '.join(_money_sum(m) for m in MEASURES)} FROM f WHERE {where} GROUP BY {', '.join(s)}")
    return f"WITH f AS ({SALES_FLAT_SQL})\n" + "\nUNION ALL\n".join(parts)


def cube_all(spark, sf):
    """All 7 cubes of (nation, segment, return flag) in one grouping-sets pass
    over line items pre-aggregated per customer."""
    return olap.data_cubes(sales_by_customer(spark, sf), CUBE_DIMS, MEASURES, money_scale=2)


register("cube_all", _cubes_sql(CUBE_DIMS))(cube_all)


@register("cube_single", f"""
WITH f AS ({SALES_FLAT_SQL})
SELECT n_name, c_mktsegment, {_money_sum('l_quantity')}, {_money_sum('l_extendedprice')}
FROM f WHERE n_name IS NOT NULL AND c_mktsegment IS NOT NULL
GROUP BY n_name, c_mktsegment""")
def cube_single(spark, sf):
    return olap.data_cube(sales_by_customer(spark, sf), ["n_name", "c_mktsegment"], MEASURES,
                          money_scale=2)


@register("cube_batches", f"""
WITH c AS ({_cubes_sql(CUBE_DIMS)})
SELECT CAST(FLOOR((cube_no - 1) / 3) + 1 AS INTEGER) AS batch,
       'cube_' || replace(cube, ' × ', '_') AS cube_file, c.*
FROM c""")
def cube_batches(spark, sf):
    return olap.cube_batches(cube_all(spark, sf), batch_size=3)


def _fact_by_nation(spark, sf):
    """Fact rows keyed by the customer's nation key (line-item grain is kept:
    the pre-aggregation is exact, so roll-ups equal the raw-row sums)."""
    return sales_by_customer(spark, sf).select("c_nationkey", *MEASURES)


_DRILL_SQL = f"""
WITH fact AS (
  SELECT c.c_nationkey, l.l_quantity, l.l_extendedprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey),
dim AS (SELECT DISTINCT n.n_nationkey, r.r_name, n.n_name
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
j AS (SELECT * FROM fact LEFT JOIN dim ON fact.c_nationkey = dim.n_nationkey)
"""


@register("olap_drilldown", _DRILL_SQL + f"""
SELECT r_name, n_name, {_money_sum('l_quantity')}, {_money_sum('l_extendedprice')}
FROM j WHERE r_name IS NOT NULL AND n_name IS NOT NULL GROUP BY r_name, n_name""")
def olap_drilldown(spark, sf):
    """Drill down region -> nation (level 1 of the hierarchy)."""
    return olap.olap_levels(_fact_by_nation(spark, sf), nation_region(spark, sf), "n_nationkey",
                            ["r_name", "n_name"], 1, MEASURES, money_scale=2,
                            fact_key="c_nationkey")


@register("olap_rollup", _DRILL_SQL + f"""
SELECT r_name, {_money_sum('l_quantity')}, {_money_sum('l_extendedprice')}
FROM j WHERE r_name IS NOT NULL GROUP BY r_name""")
def olap_rollup(spark, sf):
    """Roll up nation -> region (level 0)."""
    return olap.olap_levels(_fact_by_nation(spark, sf), nation_region(spark, sf), "n_nationkey",
                            ["r_name", "n_name"], 0, MEASURES, money_scale=2,
                            fact_key="c_nationkey")


@register("olap_levels", f"""
WITH f AS ({SALES_FLAT_SQL})
SELECT 1 AS level, r_name, CAST(NULL AS VARCHAR) AS n_name,
       {_money_sum('l_quantity')}, {_money_sum('l_extendedprice')}
FROM f WHERE r_name IS NOT NULL GROUP BY r_name
UNION ALL
SELECT 2 AS level, r_name, n_name, {_money_sum('l_quantity')}, {_money_sum('l_extendedprice')}
FROM f WHERE r_name IS NOT NULL AND n_name IS NOT NULL GROUP BY r_name, n_name""")
def olap_levels(spark, sf):
    """Every drill level of region -> nation at once (ROLLUP minus grand total)."""
    fact = sales_by_customer(spark, sf)
    return olap.olap_all_levels(fact, ["r_name", "n_name"], MEASURES, money_scale=2)


@register("star_fact", f"""
WITH f AS ({SALES_FLAT_SQL})
SELECT l_quantity, l_extendedprice, c_custkey, n_nationkey, l_returnflag FROM f""")
def star_fact(spark, sf):
    return olap.star_fact(sales_flat(spark, sf), MEASURES, DIMENSIONS)


@register("star_dimension", f"""
WITH f AS ({SALES_FLAT_SQL})
SELECT DISTINCT n_nationkey, n_name, r_name FROM f""")
def star_dimension(spark, sf):
    return olap.star_dimension(sales_flat(spark, sf), DIMENSIONS[1])


@register("dedup_rows", """
SELECT DISTINCT user_id, event_type FROM events""")
def dedup_rows(spark, sf):
    """Distinct rows of a projection (pandas ``drop_duplicates``)."""
    return load_table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()



@register("cube_null_measure", """
SELECT 'l_returnflag' AS cube, CAST(1 AS INTEGER) AS cube_no, l_returnflag, CAST(NULL AS VARCHAR) AS l_linestatus,
       CAST(COALESCE(SUM(CASE WHEN l_returnflag <> 'N' THEN l_quantity END), 0) AS DOUBLE) AS l_quantity
FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', 2, NULL, l_linestatus,
       CAST(COALESCE(SUM(CASE WHEN l_returnflag <> 'N' THEN l_quantity END), 0) AS DOUBLE) FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT '""" + olap.cube_name(("l_returnflag", "l_linestatus")) + """', 3, l_returnflag, l_linestatus,
       CAST(COALESCE(SUM(CASE WHEN l_returnflag <> 'N' THEN l_quantity END), 0) AS DOUBLE)
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def cube_null_measure(spark, sf):
    """Cubes of a measure that is null in a whole group: its sum is 0."""
    li = load_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.when(
        F.col("l_returnflag") != "N", F.col("l_quantity")).alias("l_quantity"))
    return olap.data_cubes(li, ["l_returnflag", "l_linestatus"], ["l_quantity"], money_scale=2)
