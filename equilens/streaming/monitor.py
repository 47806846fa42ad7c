"""Structured Streaming over result rows: windowed accuracy, first calls, sessions, and drift state per key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def windowed_accuracy(rows: DataFrame, time: str = "ts", by: list[str] | tuple = ("model",), acc: str = "acc", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """begin, end, by, n and accuracy by tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = rows.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(acc).alias("accuracy"))
    return g.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *by, "n", "accuracy")


def sessions(rows: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *by, "n")


def first_calls(rows: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def cusum(rows: DataFrame, key: str, time: str, value: str, mean: float, sd: float, threshold: float = 3.0) -> DataFrame:
    """One-sided CUSUM of each key's values in order of arrival (of time within a batch): key, n, s and alarm after each batch. State: two numbers per key."""

    def step(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        n, s = state.get if state.exists else (0, 0.0)
        alarm = False
        for x in pd.concat(list(batches)).sort_values(time)[value]:
            n, s = n + 1, max(0.0, s + (x - mean) - 0.5 * threshold * sd)
            alarm = alarm or s > threshold * sd
        state.update((n, s))
        yield pd.DataFrame({key: [k[0]], "n": [n], "s": [s], "alarm": [alarm]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, s double, alarm boolean", "n bigint, s double", "update", GroupStateTimeout.NoTimeout)


def _newest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("z"))
    return g.select(*keys, "z.*")


def upsert_into(path: str, keys: list[str], time: str = "ts"):
    """A foreachBatch sink that keeps the newest row of each key by ``time`` under ``path``, one folder for each batch (so that a batch that is repeated replaces itself)."""

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch, keys, time).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return write


def append_into(path: str):
    """A foreachBatch sink that keeps all rows under ``path``, one folder for each batch: the last one is the newest state of a query in complete mode."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return write


def latest(spark, path: str, keys: list[str], time: str = "ts") -> DataFrame:
    """What ``upsert_into`` has kept: of each key the newest row by ``time``, of equal times that of the later batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/*")
    return _newest(rows, keys, time, "batch")
