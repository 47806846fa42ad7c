"""Counts beyond 64 bits when multiplied, and numbers of many rows."""

import math

from pyspark.sql import functions as F

from equilens.operators import generate as ge
from equilens.operators import inference as inf


def test_kappa_of_many_pairs(spark):
    # the products of the margins are 3.6e19 and more
    cells = spark.createDataFrame([("x", "x", 4_000_000_000), ("x", "y", 1_000_000_000), ("y", "x", 2_000_000_000), ("y", "y", 3_000_000_000)], "a string, b string, o bigint")
    for r in (inf.kappa_of_cells(cells, "a", "b").first(), inf.kappa_of_cells(cells.withColumn("k", F.lit(1)), "a", "b", ["k"]).first()):
        assert r["n"] == 10_000_000_000 and r["agreement"] == 0.7
        assert math.isclose(r["expected"], 0.5) and math.isclose(r["kappa"], 0.4)


def test_batches_of_many_rows(spark):
    rows = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("i"), "id").repartition(7)
    # several ranges, as of a table that is larger than one partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ge.batches(rows, ["i"], 1000).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.sum("id").alias("ids")).orderBy("batch_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["batch_id"], r["n"]) for r in got] == [(f"batch_{k:04d}", 1000) for k in range(1, 41)]
    assert sum(r["ids"] for r in got) == 40_000 * 39_999 // 2
    assert all(a["high"] < b["low"] for a, b in zip(got, got[1:]))
