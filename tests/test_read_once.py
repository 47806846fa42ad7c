"""Inputs are read once, however many steps use them."""

import glob
import gzip
import json

from pyspark.sql import functions as F

from equilens.operators import isotonic as iso
from equilens.operators import report as rp
from equilens.plans import tables
from equilens.sources import records


def counted(spark, df):
    """``df`` through a task that counts the rows it passes on."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_isotonic_pools_read_once_and_weighted(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(20)) / 20).alias("p"), F.when(F.col("id") % 7 > 2, 1).otherwise(0).alias("y"))
    df, seen = counted(spark, rows)
    fit = sorted(iso.pools(df, "p", "y", ["g"]).collect())
    assert seen.value == 400
    cells = rows.groupBy("g", "p", "y").agg(F.count("*").alias("w"))
    assert fit == sorted(iso.pools(cells, "p", "y", ["g"], weight="w").collect())


def test_summary_without_a_task_of_all_values(spark):
    rows = spark.range(101).select((F.col("id") % 10).alias("s"), F.when(F.col("id") > 0, F.concat(F.lit("m"), F.col("id") % 2)).alias("m"), (F.col("id") % 4 > 0).alias("ok"), (F.col("id") % 2).cast("int").alias("c"), (F.col("id") * 1.5).alias("t"), F.lit(0.5).alias("x"))
    df, seen = counted(spark, rows)
    out = rp.summary(df, "s", "m", "ok", "c", "t", "x")
    assert out.first().asDict() == {"n": 101, "subjects": 10, "models": 2, "success_rate": 75 / 101, "accuracy": 50 / 101, "mean_seconds": 75.0, "median_seconds": 75.0, "total_cost": 50.5}
    assert seen.value == 101
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    even = rp.summary(rows.where("id > 0"), "s", "m", "ok", "c", "t", "x").first()
    assert even["median_seconds"] == 75.75
    none = rp.summary(rows.withColumn("t", F.lit(None).cast("double")), "s", "m", "ok", "c", "t", "x").first()
    assert (none["n"], none["mean_seconds"], none["median_seconds"]) == (101, 0.0, 0.0)


def test_catalogue_reads_the_calls_once(spark, monkeypatch):
    calls = tables._calls
    seen = []

    def once(spark, sf):
        df, n = counted(spark, calls(spark, sf))
        seen.append(n)
        return df

    monkeypatch.setattr(tables, "_calls", once)
    runs = {r["run"]: r["n"] for r in tables.s15(spark, "/root/testdata/sf0.001").collect()}
    assert set(runs) == {"run_F", "run_O", "run_P"} and sum(n.value for n in seen) == sum(runs.values())


def test_calls_are_gzipped_lines(spark, tmp_path):
    path = str(tmp_path / "calls")
    records.append_calls(tables._calls(spark, "/root/testdata/sf0.001").limit(50), path)
    lines = [json.loads(x) for f in glob.glob(f"{path}/part-*.json.gz") for x in gzip.open(f, "rt")]
    good, bad = records.read_calls(spark, path)
    assert len(lines) == good.count() == 50 and bad.isEmpty()
