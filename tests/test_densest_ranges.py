"""Densest interval with a key's values spread over ranges: the same rows as in one pass."""
import random

import pytest
from pyspark.sql import functions as F

from cagetrace.operators import clean as C


@pytest.mark.parametrize("ranges,width", [(2, 5.0), (16, 0.5), (16, 40.0), (64, 1000.0)])
def test_ranges_change_nothing(spark, ranges, width):
    rng = random.Random(ranges)
    rows = [(rng.choice("aaab") if rng.random() < 0.97 else None, rng.choice([round(rng.gauss(0, 30), 1), rng.random() * 100, 7.0])) for _ in range(3000)]
    rows += [("c", 1.0), ("d", None), ("e", float("nan")), ("e", -3.0), ("f", 1.0), ("f", 1.0 + width)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    want, got = (sorted(map(str, C.densest_interval(df, ["k"], "x", width, r).collect())) for r in (1, ranges))
    assert got == want and len(got) == 6


def test_whole_numbers_and_no_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 90 * F.col("id") % 70).alias("x"))
    want, got = (C.densest_interval(df, ["k"], "x", 9, r).collect() for r in (1, 8))
    assert got == want
    assert C.densest_interval(df.limit(0), ["k"], "x", 9, 8).collect() == []


def test_values_of_few_keys_take_many_tasks(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("k"), (F.hash("id") / 1e3).alias("x"))
    hist = df.groupBy("k", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cov = C._cover_ranges(hist, ["k"], 100.0, 32)
        assert cov.select(F.spark_partition_id().alias("t")).distinct().count() >= 7      # eight shuffle partitions, two keys
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
