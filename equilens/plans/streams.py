"""Streaming queries run to completion over the driver tables, and their batch oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilens.streaming import monitor as mo

from .audit import query
from .tables import scratch


def _run(spark, sf, make, mode: str):
    """Run a stream over ``events`` to its end and return what it wrote (its last state in complete mode), from Parquet in the shared folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("acc", (F.col("value") > 250).cast("int"))
    folder, out = scratch(spark), make(rows)
    sink = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(mo.append_into(f"{folder}/out"))
    sink.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")
    if mode != "complete":
        return kept
    batch = F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1)
    last = kept.select(F.max(batch)).first()[0]
    return kept.where(batch == last).select(*out.columns)


@query("s_windowed_accuracy", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS begin, event_type, count(*) AS n, round(avg(CAST(value>250 AS INT)),6) AS accuracy FROM events GROUP BY ALL")
def windows(spark, sf):
    out = _run(spark, sf, lambda r: mo.windowed_accuracy(r, by=["event_type"], width="6 hours"), "complete")
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("accuracy", 6).alias("accuracy"))


@query("s_sliding_accuracy", "SELECT b AS begin, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) + INTERVAL 12 HOUR - INTERVAL 24 HOUR]) AS b FROM events) GROUP BY ALL")
def sliding(spark, sf):
    out = _run(spark, sf, lambda r: mo.windowed_accuracy(r, by=["event_type"], width="24 hours", slide="12 hours"), "complete")
    return out.select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n")


@query("s_first_calls", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def first(spark, sf):
    return _run(spark, sf, lambda r: mo.first_calls(r, ["event_id"]).select("event_id"), "append").agg(F.count("*").alias("n"))


@query("s_cusum_state")
def cusum(spark, sf):
    return _run(spark, sf, lambda r: mo.cusum(r, "event_type", "ts", "value", 250.0, 100.0), "update")
