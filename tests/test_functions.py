"""Scalar helpers: business days, label encoding, split, parsing."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.columns import business_days_after, coerce_double, parse_timestamp, strip_non_word
from tessera.ml import prepare


def test_business_days_skip_weekend(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d date")          # a Friday
    days = df.select(business_days_after("d", 5).alias("x")).first().x
    assert days == [dt.date(2024, 1, 8), dt.date(2024, 1, 9), dt.date(2024, 1, 10),
                    dt.date(2024, 1, 11), dt.date(2024, 1, 12)]


def test_encode_labels_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string")
    got = sorted((r.s is None, r.s) for r in prepare.encode_labels(df, ["s"]).collect())
    assert got == [(False, 0), (False, 0), (False, 1), (False, 2), (True, None)]


def test_split_is_deterministic_and_about_70_percent(spark):
    df = spark.range(10000).select(F.col("id"), prepare.split_flag(F.col("id")).alias("s"))
    a = {r.id: r.s for r in df.collect()}
    b = {r.id: r.s for r in df.repartition(7).collect()}
    assert a == b
    frac = sum(1 for v in a.values() if v == "train") / len(a)
    assert 0.68 < frac < 0.72


def test_coercing_parsers_and_strip(spark):
    df = spark.createDataFrame([("31-12-2024", " 3.5 ", "..Dr. Moore,"), ("bad", "x", "")],
                               "d string, n string, t string")
    rows = df.select(parse_timestamp("d", "dd-MM-yyyy").alias("d"), coerce_double("n").alias("n"),
                     strip_non_word("t").alias("t")).collect()
    assert rows[0].d == dt.datetime(2024, 12, 31) and rows[0].n == 3.5 and rows[0].t == "Dr. Moore"
    assert rows[1].d is None and rows[1].n is None and rows[1].t == ""
