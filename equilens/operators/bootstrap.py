"""Poisson bootstrap of any metric that is a function of weighted sums.

A metric names what rows are summed by (cells: groups, bins), what is summed
(amounts), and how the sums of all cells give one number. A task keeps, for each
cell, a matrix of replicates by amounts, to which every batch adds the product
of its rows' weights and amounts; matrices of several tasks add up, so each row is
read once whatever the number of replicates. A row's weights come from the hash
of its key, the replicate and a seed: they don't depend on partitions, and rows
of one key are drawn together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .uncertainty import POISSON

#: Cells of a task's matrices; beyond, they are passed on and begun anew.
MOST_CELLS = 512
#: Rows of a batch whose weights are in memory at once.
ROWS = 1024


class Metric(NamedTuple):
    """``value``: an aggregate over the rows of a replicate's cells, with the names in ``cells`` and ``amounts``."""

    cells: dict[str, Column]
    amounts: dict[str, Column]
    value: Column


def _number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def mean(value: str) -> Metric:
    return ratio(value, F.lit(1.0))


def ratio(above: str | Column, below: str | Column) -> Metric:
    """Sum of one column over the sum of another."""
    return Metric({}, {"a": _number(above), "b": _number(below)}, F.try_divide(F.sum("a"), F.sum("b")))


def rate_range(group: str, hit: str) -> Metric:
    """Greatest less least mean of ``hit`` among groups (accuracy range, parity difference)."""
    rate = F.try_divide("hits", "rows")
    return Metric({"g": F.col(group)}, {"hits": _number(hit), "rows": F.lit(1.0)}, F.max(rate) - F.min(rate))


def calibration_error(p: str, y: str, bins: int = 10) -> Metric:
    """Expected calibration error over bins (lo, hi] of equal width."""
    at = F.size(F.filter(F.array(*[F.lit(i / bins) for i in range(bins)]), lambda e: e < F.col(p)))
    return Metric({"bin": F.when(at > 0, at)}, {"rows": F.lit(1.0), "p": _number(p), "y": _number(y)}, F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("rows")))


def odds_gap(group: str, pred: Column, true: Column, which: str = "tpr") -> Metric:
    """Range among groups of the true positive rate (``tpr``), the false positive rate (``fpr``), or the greater of both (``odds``). ``pred`` and ``true`` are conditions."""
    p, t = pred.cast("double"), true.cast("double")
    tpr, fpr = F.try_divide("tp", "pos"), F.try_divide("fp", "neg")
    gaps = {"tpr": F.max(tpr) - F.min(tpr), "fpr": F.max(fpr) - F.min(fpr)}
    value = F.greatest(*gaps.values()) if which == "odds" else gaps[which]
    return Metric({"g": F.col(group)}, {"tp": p * t, "pos": t, "fp": p * (1 - t), "neg": 1 - t}, value)


def weights(hashes: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of rows (their keys' 64-bit hashes) in replicates ``first`` to ``last`` - 1, as a matrix of replicates by rows; replicate 0 has ones."""
    with np.errstate(over="ignore"):
        start = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = hashes.view(np.uint64)[None, :] ^ ((np.arange(first, last, dtype=np.uint64) + start) * np.uint64(0xBF58476D1CE4E5B9))[:, None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    u = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
    out = np.zeros(u.shape, np.uint8)
    for p in POISSON:
        out += u > p
    if first == 0:
        out[0] = 1
    return out


def _sum_up(width: int, replicates: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # by cell: amounts by replicates

        def passed_on() -> Iterator[pa.RecordBatch]:
            for cell, matrix in sums.items():
                n = replicates + 1
                columns = [pa.array([cell] * n, pa.string()), pa.array(np.arange(n), pa.int32()), *(pa.array(a) for a in matrix)]
                yield pa.RecordBatch.from_arrays(columns, names=["__cell", "__r", *(f"__a{i}" for i in range(width))])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                coded = batch.column(0).dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.diff(code[order], prepend=-1))
                drawn = weights(batch.column(1).to_numpy()[order], 0, replicates + 1, seed).astype(np.float64)
                cells = [coded.dictionary[int(code[order[b]])].as_py() for b in begin]
                for i in range(width):
                    parts = np.add.reduceat(drawn * batch.column(2 + i).to_numpy()[order], begin, axis=1)
                    for j, cell in enumerate(cells):
                        if cell not in sums:
                            sums[cell] = np.zeros((width, replicates + 1))
                        sums[cell][i] += parts[:, j]
                if len(sums) > MOST_CELLS:
                    yield from passed_on()
                    sums = {}
        yield from passed_on()

    return run


def replicated(df: DataFrame, metric: Metric, key: str | list[str], by: list[str] | tuple = (), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """by, replicate and value; replicate 0 is the metric itself. Rows with a null cell or amount are left out."""
    by, keys = list(by), [key] if isinstance(key, str) else list(key)
    cells, amounts = list(metric.cells), list(metric.amounts)
    named = {**{b: F.col(b) for b in by}, **metric.cells}
    # the cell as JSON: any types, null groups apart from the text "null"
    rows = df.select(F.struct(*[c.alias(n) for n, c in named.items()]).alias("__s") if named else F.lit(None).alias("__s"), F.xxhash64(*keys).alias("__h"), *[c.alias(f"__a{i}") for i, c in enumerate(metric.amounts.values())])
    for n in cells:
        rows = rows.where(F.col(f"__s.{n}").isNotNull())
    for i in range(len(amounts)):
        rows = rows.where(F.col(f"__a{i}").isNotNull())
    kind = rows.schema["__s"].dataType.simpleString() if named else ""
    cell = F.to_json("__s") if named else F.lit("{}")
    fields = ", ".join(["__cell string, __r int", *(f"__a{i} double" for i in range(len(amounts)))])
    summed = rows.select(cell.alias("__cell"), "__h", *[f"__a{i}" for i in range(len(amounts))]).mapInArrow(_sum_up(len(amounts), replicates, seed), fields)
    merged = summed.groupBy("__cell", "__r").agg(*[F.sum(f"__a{i}").alias(a) for i, a in enumerate(amounts)])
    if named:
        merged = merged.withColumn("__s", F.from_json("__cell", kind)).select("*", *[F.col(f"__s.{n}").alias(n) for n in named])
    return merged.groupBy(*by, F.col("__r").alias("replicate")).agg(metric.value.alias("value"))


def bootstrap(df: DataFrame, metric: Metric, key: str | list[str], by: list[str] | tuple = (), replicates: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by, value (of all rows as they are), low and high (percentile interval of the replicates), std (of the replicates) and n_replicates (those that have a value)."""
    by = list(by)
    drawn = replicated(df, metric, key, by, replicates, seed)
    own = F.when(F.col("replicate") > 0, F.col("value"))
    q = F.percentile(own, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = drawn.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("value"), q.alias("q"), F.stddev_samp(own).alias("std"), F.count(own).alias("n_replicates"))
    return out.select(*by, "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "std", "n_replicates")
