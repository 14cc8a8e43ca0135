"""Inputs derived from the driver tables, shared by the registered queries.

Every input reads whole tables; nothing is subset.  Dimension tables of a
fixed TPC-H size (nation, region) are broadcast behind a row-bound check;
everything else is left to the planner (sort-merge / AQE conversion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.joins import broadcast_if_bounded
from tessera.sources.tables import load_table

MONEY = T.DecimalType(28, 2)


def nation_region(spark: SparkSession, sf: str) -> DataFrame:
    n = load_table(spark, sf, "nation")
    r = load_table(spark, sf, "region")
    return (n.join(broadcast_if_bounded(r, 1000), n.n_regionkey == r.r_regionkey)
            .select("n_nationkey", "n_name", "r_name"))


def sales_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The denormalised sales table (one row per line item), the shape of the
    single CSV a star schema is split from."""
    li = load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = load_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nr = broadcast_if_bounded(nation_region(spark, sf), 1000)
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(c, F.col("o_custkey") == c.c_custkey)
            .join(nr, F.col("c_nationkey") == nr.n_nationkey)
            .drop("o_orderkey", "o_custkey"))


def sales_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Line items pre-aggregated to (customer, return flag) right after the
    order join, before the customer shuffle.  Sums are exact decimals, so
    re-summing them in any cube gives the same totals as the raw rows while
    the data crossing the second shuffle shrinks to customers x flags."""
    li = load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_cust = (li.join(o, li.l_orderkey == o.o_orderkey)
                .groupBy("o_custkey", "l_returnflag")
                .agg(F.sum(F.col("l_quantity").cast(MONEY)).alias("l_quantity"),
                     F.sum(F.col("l_extendedprice").cast(MONEY)).alias("l_extendedprice")))
    c = load_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nr = broadcast_if_bounded(nation_region(spark, sf), 1000)
    return (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
            .join(nr, F.col("c_nationkey") == nr.n_nationkey)
            .select("c_nationkey", "n_name", "r_name", "c_mktsegment", "l_returnflag",
                    "l_quantity", "l_extendedprice"))


# SQL text of the same inputs for the DuckDB oracle
SALES_FLAT_SQL = """
SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_quantity, l.l_extendedprice,
       c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment, n.n_nationkey, n.n_name, r.r_name
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
