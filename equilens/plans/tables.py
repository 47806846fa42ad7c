"""Queries that go through files: JSON lines to tidy results, catalogues and version logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from equilens.session import stored
from equilens.sources import records

from .audit import AUDIT, audit, query


def scratch(spark) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _calls(spark, sf):
    a = audit(spark, sf)
    mix = F.struct(F.col("proposed_growth").cast("int").alias("growth_pct"), (100 - F.col("proposed_growth")).cast("int").alias("income_pct"))
    demo = F.when(F.col("subject_id") % 4 == 0, F.array(F.lit("age"))).otherwise(F.array().cast("array<string>"))
    response = F.when(F.col("ok"), F.struct(F.col("pred_label").alias("risk_label"), mix.alias("proposed_asset_mix"), F.create_map(F.lit("demographics"), demo).alias("assumptions_made")))
    return a.select(F.col("subject_id").cast("int").alias("subject_id"), "toi", "th", "true_label", "condition", "name_group", "city", F.col("run_idx").cast("int").alias("run_idx"), "provider", "model", "latency_s", "ok", response.alias("response"))


@query("s10_p01_jsonl_tidy", f"""SELECT model, condition, count(*) AS n, count(pred_label) AS n_pred, CAST(sum(acc) AS BIGINT) AS correct, round(sum(proposed_growth-true_growth),6) AS growth_gap, CAST(sum(ordinal_error) AS BIGINT) AS ordinal_error,
 round(avg(CAST(ok AND subject_id % 4 = 0 AS INT)),6) AS assumption_rate FROM {AUDIT} a GROUP BY ALL""")
def s10(spark, sf):
    path = scratch(spark)
    records.append_calls(_calls(spark, sf), path)
    calls, _ = records.read_calls(spark, path)
    t = records.tidy(calls)
    some = (F.size(F.from_json("assumed_demo", "array<string>")) > 0).cast("double")
    return t.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("pred_label").alias("n_pred"), F.sum("acc").alias("correct"), F.round(F.sum("growth_gap"), 6).alias("growth_gap"), F.sum("ordinal_error").alias("ordinal_error"), F.round(F.avg(some), 6).alias("assumption_rate"))


@query("s11_csv_round_trip", f"SELECT model, count(*) AS n, CAST(sum(acc) AS BIGINT) AS correct FROM {AUDIT} a GROUP BY 1")
def s11(spark, sf):
    path = scratch(spark)
    records.write_csv(audit(spark, sf).select("model", "acc", "pred_label"), path)
    return records.read_csv(spark, path, "model string, acc int, pred_label string").groupBy("model").agg(F.count("*").alias("n"), F.sum("acc").alias("correct"))


@query("s15_catalogue", f"SELECT 'run_' || provider AS run, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS n_ok, round(100.0*count_if(ok)/count(*),6) AS success_pct, count(DISTINCT model) AS n_models FROM {AUDIT} a GROUP BY 1")
def s15(spark, sf):
    path, calls = scratch(spark), stored(_calls(spark, sf))
    for p in ("F", "O", "P"):
        records.append_calls(calls.where(F.col("provider") == p), f"{path}/run_{p}/results.jsonl")
    runs = records.catalogue(spark, path)
    return runs.select("run", "n", "n_ok", F.round("success_pct", 6).alias("success_pct"), F.size("models").cast("bigint").alias("n_models"))


@query("s18_version_log", "SELECT 'v' || (user_id % 4) AS version_id, count(*) AS n FROM events GROUP BY 1")
def s18(spark, sf):
    path = scratch(spark)
    e = spark.read.parquet(f"{sf}/events.parquet")
    records.append_versions(e.select(F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("version_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("payload")), path)
    return records.read_versions(spark, path).groupBy("version_id").agg(F.count("*").alias("n"))


@query("s20_registry", "WITH e AS (SELECT 'v' || (user_id % 8) AS version_id, event_type FROM events), n AS (SELECT version_id, 'new ' || count(*) AS metadata FROM e WHERE event_type = 'click' AND version_id < 'v3' GROUP BY 1), o AS (SELECT version_id, 'old ' || count(*) AS metadata FROM e GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE version_id NOT IN (SELECT version_id FROM n)")
def s20(spark, sf):
    """A registry of the events' versions, in which the first ones' rows are replaced by those of their clicks."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("v"), (F.col("user_id") % 8).cast("string")).alias("version_id"), "event_type")
    told = lambda df, word: df.groupBy("version_id").agg(F.concat(F.lit(f"{word} "), F.count("*").cast("string")).alias("metadata"))
    return records.register_version(told(e, "old"), told(e.where("event_type = 'click' and version_id < 'v3'"), "new"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def props(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
