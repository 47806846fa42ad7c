"""Change points of series: pruned optimal partitioning with a kernel cost.

A segment's cost is its number of rows less the mean, over its rows, of the sum
of their kernel values exp(-gamma d^2) to all of its rows; a partition costs its segments and a
penalty for each. Of a series that fits a task, the cheapest partition is found
exactly. A longer one is cut into chunks; each chunk's cheapest partition
leaves segments, which are the items of the next level, in chunks of their own
that straddle the ends of those before, until a level changes nothing. Segments are passed on
as sums of Fourier features whose products are the kernel's values, so that
no task sees more than a chunk of items at any level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from equilens.session import stored

from . import ordered as od

#: Items of a chunk.
CHUNK = 2000
#: Frequencies of the features, at most; values beyond the span that they resolve are drawn in to it.
MOST_FREQUENCIES = 256


def bandwidth(values: np.ndarray) -> float:
    """gamma: 1 over the median squared distance of two values (1 where that is 0)."""
    apart = np.abs(values[:, None] - values[None, :])[np.triu_indices(len(values), 1)]
    middle = float(np.median(apart * apart)) if len(apart) else 0.0
    return 1 / middle if middle > 0 else 1.0


class GramCost:
    """Costs of segments of single rows from the kernel matrix, summed from its corner."""

    def __init__(self, values: np.ndarray, gamma: float):
        kernel = np.exp(-gamma * (values[:, None] - values[None, :]) ** 2)
        self.sums = np.zeros((len(values) + 1,) * 2)
        self.sums[1:, 1:] = kernel.cumsum(0).cumsum(1)

    def __call__(self, begin: np.ndarray, end: int) -> np.ndarray:
        inside = self.sums[end, end] - 2 * self.sums[begin, end] + self.sums[begin, begin]
        return (end - begin) - inside / (end - begin)


class FeatureCost:
    """The same from items' counts and feature sums."""

    def __init__(self, counts: np.ndarray, features: np.ndarray):
        self.counts = np.concatenate([[0], np.cumsum(counts)])
        self.features = np.concatenate([np.zeros((1, features.shape[1])), np.cumsum(features, 0)])

    def __call__(self, begin: np.ndarray, end: int) -> np.ndarray:
        n = self.counts[end] - self.counts[begin]
        total = self.features[end] - self.features[begin]
        return n - np.einsum("ij,ij->i", total, total) / n


def features(values: np.ndarray, gamma: float, low: float, high: float) -> np.ndarray:
    """Rows whose scalar products are the kernel's values (to about 1e-9): cosines and sines at the nodes of a trapezoid rule for the kernel's spectrum."""
    scale = np.sqrt(2 * gamma)
    widest = 2 * np.pi * MOST_FREQUENCIES / (6.5 * scale) - 6.5 / scale
    middle, reach = (low + high) / 2, min((high - low) / 2, widest / 2)
    step = 2 * np.pi / (2 * reach + 6.5 / scale)
    w = step * np.arange(int(6.5 * scale / step) + 1)
    density = step * np.exp(-w * w / (4 * gamma)) / np.sqrt(4 * np.pi * gamma)
    weight = np.sqrt(density * np.where(w > 0, 2, 1))
    phase = (np.clip(values, middle - reach, middle + reach) - middle)[:, None] * w
    return np.concatenate([weight * np.cos(phase), weight * np.sin(phase)], 1)


def partition(cost, n: int, penalty: float, jump: int, least: int, pruned: bool = True) -> list[int]:
    """Begins of the cheapest partition's segments. Segments begin at multiples of ``jump`` and have ``least`` items or more.

    A begin that can't win any more, once a later one can take its place, is
    dropped; without ``pruned``, none is.
    """
    best, back = {0: 0.0}, {0: 0}
    open_, gone = np.zeros(0, np.int64), {}
    waiting = list(range(0, n, jump))
    ends = [k for k in waiting if k >= least] + [n]
    for end in ends:
        while waiting and waiting[0] <= end - least:
            begin = waiting.pop(0)
            if begin in best:
                open_ = np.append(open_, begin)
        open_ = open_[[gone.get(int(s), end + 1) > end for s in open_]] if gone else open_
        if not len(open_):
            continue
        total = np.array([best[int(s)] for s in open_]) + cost(open_, end)
        at = int(total.argmin())
        best[end], back[end] = float(total[at]) + penalty, int(open_[at])
        if pruned:  # from end + least on, a segment that begins at ``end`` does at least as well
            for s in open_[total > best[end]]:
                gone.setdefault(int(s), end + least)
    begins, end = [], n
    while end > 0 and end in back:
        end = back[end]
        begins.append(end)
    return begins[::-1] or [0]


def _first_level(penalty: float, jump: int, least: int):
    def run(rows):
        rows = rows.sort_values("__i")
        x = rows["__x"].to_numpy()
        whole = rows["__n"].iloc[0] <= CHUNK
        gamma = bandwidth(x) if whole else float(rows["__g"].iloc[0])
        seen = np.ones((len(x), 1)) if whole else features(x, gamma, float(rows["__low"].iloc[0]), float(rows["__high"].iloc[0]))
        cost = GramCost(x, gamma) if whole else FeatureCost(np.ones(len(x)), seen)
        begins = partition(cost, len(x), penalty, jump, least)
        return _segments(rows, begins, np.ones(len(x), np.int64), seen)

    return run


def _next_level(penalty: float):
    def run(rows):
        rows = rows.sort_values("__i")
        counts, seen = rows["__rows"].to_numpy(), np.stack(rows["__f"].to_numpy())
        return _segments(rows, partition(FeatureCost(counts, seen), len(rows), penalty, 1, 1), counts, seen)

    return run


def _segments(rows, begins: list[int], counts: np.ndarray, seen: np.ndarray):
    """One row a segment: the columns of its first row, its rows and the sum of their features."""
    out = rows.iloc[begins].copy()
    out["__rows"] = np.add.reduceat(counts, begins)
    out["__f"] = list(np.add.reduceat(seen, begins, axis=0))
    return pd.DataFrame({c: out[c] for c in rows.columns if c in KEPT or c.startswith("__by")} | {"__rows": out["__rows"], "__f": out["__f"]})


#: Columns of a segment besides those of its series.
KEPT = ("__begin", "__n", "__at")


@F.pandas_udf(DoubleType())
def _gamma(quantiles: pd.Series) -> pd.Series:
    return quantiles.map(lambda q: bandwidth(np.asarray(q, float)))


def change_points(df: DataFrame, time: str, metric: str, by: list[str] | tuple = (), penalty: float = 10.0, shortest: int = 10, jump: int = 5, least: int = 2) -> DataFrame:
    """Segments of each series with ``shortest`` rows or more: by, begin (number of its first row, from 0), n and first (that row's time).

    The change points are the begins above 0, multiples of ``jump``; segments
    have ``least`` rows or more. gamma is that of ``bandwidth`` over the whole series, of
    a longer series than CHUNK rows over 201 of its quantiles. Null values are left out; rows of one time are ordered by value.
    """
    by = list(by)
    names = [f"__by{i}" for i in range(len(by))]
    rows = df.where(F.col(metric).isNotNull()).select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col(time).alias("__at"), F.col(metric).cast("double").alias("__x"))
    spots = [k / 200 for k in range(201)]
    about = rows.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.percentile_approx("__x", spots).alias("__q"))
    about = about.where(F.col("__n") >= shortest).withColumn("__g", _gamma("__q")).drop("__q")
    placed = od.joined(od.indexed(rows, names, ["__at", "__x"]), about, names).withColumn("__c", F.floor(F.col("__i") / CHUNK)).withColumn("__begin", F.col("__i"))
    kinds = ", ".join([*(f"{n} {df.schema[b].dataType.simpleString()}" for b, n in zip(by, names)), f"__at {df.schema[time].dataType.simpleString()}"])
    fields = f"{kinds}, __begin bigint, __n bigint, __rows bigint, __f array<double>"
    order = [*names, "__at", "__begin", "__n", "__rows", "__f"]
    found = stored(placed.groupBy(*names, "__c").applyInPandas(_first_level(penalty, jump, least), fields).select(*order))
    done, long, level = found.where(F.col("__n") <= CHUNK), found.where(F.col("__n") > CHUNK), 0
    items = long.count()
    unchanged = 0
    while items and unchanged < 2:  # both ways of cutting have left all as it was
        level += 1
        dealt = od.indexed(long, names, ["__begin"]).withColumn("__c", F.floor((F.col("__i") + (level % 2) * (CHUNK // 2)) / CHUNK))
        long = stored(dealt.groupBy(*names, "__c").applyInPandas(_next_level(penalty), fields).select(*order))
        left = long.count()
        unchanged = unchanged + 1 if left == items else 0
        items = left
    return done.unionByName(long).select(*[F.col(n).alias(b) for b, n in zip(by, names)], F.col("__begin").alias("begin"), F.col("__rows").alias("n"), F.col("__at").alias("first"))
