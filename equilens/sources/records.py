"""Call records: JSON lines in, tidy results out, and the files around them."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions import rubric as ru

from .schemas import CALL, CHECKPOINT, VERSION_LOG


def read_calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(calls, rejects): JSON lines with the declared schema; lines that aren't JSON, or have no true label, are rejects (line, file)."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("z", F.from_json("line", CALL, {"mode": "PERMISSIVE"}))
    usable = F.col("z.true_label").isNotNull()
    return parsed.where(usable).select("z.*"), parsed.where(~F.coalesce(usable, F.lit(False)) & (F.trim("line") != "")).select("line", "file")


def stream_calls(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    """The same lines as a stream of new files."""
    return spark.readStream.schema(CALL).option("maxFilesPerTrigger", files).json(path)


def tidy(calls: DataFrame) -> DataFrame:
    """The results table: labels and growth of answered calls, and acc, growth_gap and ordinal_error (null where unanswered)."""
    answered = F.coalesce(F.col("ok"), F.lit(False)) & F.col("response.risk_label").isNotNull()
    keep = ["subject_id", "toi", "th", "true_label", "condition", "name_group", "city", "run_idx", "provider", "model", "latency_s", "ok"]
    out = calls.select(
        *keep, F.when(answered, F.col("response.risk_label")).alias("pred_label"), F.when(answered, F.col("response.proposed_asset_mix.growth_pct").cast("double")).alias("proposed_growth"),
        ru.growth_of(ru.ord_of(F.col("true_label"))).cast("double").alias("true_growth"), F.to_json(F.coalesce(F.when(answered, F.col("response.assumptions_made")["demographics"]), F.array().cast("array<string>"))).alias("assumed_demo"),
    )
    return out.withColumn("acc", ru.accuracy(F.col("pred_label"), F.col("true_label"))).withColumn("growth_gap", F.col("proposed_growth") - F.col("true_growth")).withColumn("ordinal_error", ru.ordinal_error(F.col("pred_label"), F.col("true_label")))


def assumption_rate(results: DataFrame, by: list[str], column: str = "assumed_demo") -> DataFrame:
    """Share of rows whose model assumed some demographic."""
    some = F.size(F.from_json(column, "array<string>")) > 0
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(some, F.lit(False)).cast("double")).alias("assumption_rate"))


def append_calls(calls: DataFrame, path: str) -> None:
    """Append the calls as JSON lines, gzipped: records repeat their field names and labels."""
    calls.write.mode("append").option("compression", "gzip").json(path)


def write_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_summary(metrics: DataFrame, path: str) -> None:
    """A small metric frame as one JSON line for each row."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Runs under ``root`` (a folder each, with results.jsonl, a file or a folder of part files): run, n, n_ok, success_pct, models and changed; newest first."""
    lines = spark.read.option("recursiveFileLookup", True).text(f"{root}/*/results.jsonl").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"))
    # by file first: the run's name is taken from a path once, and not from every line
    z = lines.withColumn("z", F.from_json("value", "ok boolean, model string"))
    files = z.groupBy("f").agg(F.count("*").alias("n"), F.count_if("z.ok").alias("n_ok"), F.collect_set("z.model").alias("models"), F.max("t").alias("t"))
    named = files.withColumn("run", F.regexp_extract("f", "([^/]+)/results[.]jsonl(?:/[^/]*)?$", 1))
    g = named.groupBy("run").agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"), F.max("t").alias("changed"))
    return g.withColumn("success_pct", 100 * F.col("n_ok") / F.col("n")).orderBy(F.col("changed").desc(), "run")


def append_versions(rows: DataFrame, path: str) -> None:
    """Append version-log rows (version_id, timestamp, payload), a folder for each version."""
    rows.write.mode("append").partitionBy("version_id").json(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The version log; an empty frame where there is none."""
    try:
        return spark.read.schema(VERSION_LOG).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VERSION_LOG)


def register_version(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (version_id, registered, metadata) with new rows in place of those of the same version."""
    return registry.join(new.select("version_id"), "version_id", "left_anti").unionByName(new)


def save_checkpoint(spark: SparkSession, state: dict[str, Any], path: str) -> None:
    row = spark.createDataFrame([tuple(state[k.split()[0]] for k in CHECKPOINT.split(", "))], CHECKPOINT)
    row.coalesce(1).write.mode("overwrite").json(path)


def load_checkpoint(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The saved state; null where there is none."""
    try:
        row = spark.read.schema(CHECKPOINT).json(path).first()
    except AnalysisException:
        return None
    return row.asDict() if row else None


def progress(total: int, done: int, failed: int, seconds: float) -> dict[str, float]:
    """Percent done, rate and seconds left."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"percent": 100 * done / total if total else 0.0, "failed": failed, "per_second": rate, "seconds_left": (total - done) / rate if rate else float("inf")}


@dataclasses.dataclass(frozen=True)
class AuditConfig:
    """Parameters of an audit; unknown keys of a file raise."""

    subjects: int = 30
    repeats: int = 3
    pairs: int = 3
    models: tuple[str, ...] = ()
    seed: int = 42
    alpha: float = 0.05
    max_call_cost: float = 0.05
    max_total_cost: float = 100.0

    @classmethod
    def load(cls, path: str) -> "AuditConfig":
        with open(path) as f:
            if path.endswith(".json"):
                data = json.load(f)
            else:
                import yaml

                data = yaml.safe_load(f) or {}
        if isinstance(data.get("models"), list):
            data["models"] = tuple(data["models"])
        return cls(**data)

    def save(self, path: str) -> None:
        data = dataclasses.asdict(self) | {"models": list(self.models)}
        with open(path, "w") as f:
            if path.endswith(".json"):
                json.dump(data, f)
            else:
                import yaml

                yaml.safe_dump(data, f)
