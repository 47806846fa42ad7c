"""Isotonic calibration: pool-adjacent-violators over blocks.

The outcomes of each distinct probability are one cell. Cells are dealt into
chunks by their position; a chunk merges neighbours whose means fall, and passes on its
pools. Merging any two neighbours that fall leads to the same fit, so the pools
are cells of the next round, whose chunks straddle the borders of those
before, until no two neighbours fall. No task holds more than a chunk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.session import stored

from . import ordered as od

#: Cells or pools of a chunk.
CHUNK = 100_000


def merged(n: list[float], s: list[float]) -> list[int]:
    """Begins of the pools of cells with ``n`` rows and sums ``s``."""
    begins: list[int] = []
    rows: list[float] = []
    sums: list[float] = []
    for i, (a, b) in enumerate(zip(n, s)):
        begins.append(i)
        rows.append(a)
        sums.append(b)
        while len(begins) > 1 and sums[-2] * rows[-1] >= sums[-1] * rows[-2]:
            begins.pop()
            a, b = rows.pop(), sums.pop()
            rows[-1] += a
            sums[-1] += b
    return begins


def pools(df: DataFrame, p: str, y: str, by: list[str] | tuple = (), weight: str | None = None) -> DataFrame:
    """Pools of the isotonic fit of ``y`` on ``p``, by least squares: by, low and high (least and greatest p), n and value (mean of y), which rises from pool to pool.

    Rows with a null are left out; rows of equal p are together; neighbours of equal means are one pool. ``weight``: a column of counts.
    The input is read once: its cells are written down.
    """
    by = list(by)
    names = [f"__by{i}" for i in range(len(by))]
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    cells = known.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col(p).cast("double").alias("low")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("n"), F.sum(F.col(y).cast("double") * (F.col(weight) if weight else 1)).alias("s"))
    kinds = ", ".join([*(f"{n} {df.schema[b].dataType.simpleString()}" for b, n in zip(by, names)), "low double, high double, n double, s double"])
    columns = [*names, "low", "high", "n", "s"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("low")
        begins = merged(rows["n"].tolist(), rows["s"].tolist())
        ends = [*begins[1:], len(rows)]
        out = rows.iloc[begins].copy()
        out["high"] = rows["high"].to_numpy()[[e - 1 for e in ends]]
        for c in ("n", "s"):
            total = rows[c].cumsum().to_numpy()
            out[c] = [total[e - 1] - (total[b - 1] if b else 0.0) for b, e in zip(begins, ends)]
        return out[columns]

    found, level = stored(cells.withColumn("high", F.col("low")).select(*columns)), 0
    while True:
        dealt = od.indexed(found, names, ["low"]).withColumn("__c", F.floor((F.col("__i") + (level % 2) * (CHUNK // 2)) / CHUNK))
        found = stored(dealt.groupBy(*names, "__c").applyInPandas(run, kinds))
        if not _falls(found, names):
            break
        level += 1
    return found.select(*[F.col(n).alias(b) for b, n in zip(by, names)], "low", "high", F.col("n").cast("bigint").alias("n"), (F.col("s") / F.col("n")).alias("value"))


def _falls(found: DataFrame, names: list[str]) -> bool:
    """Whether any two neighbouring pools of a series don't rise."""
    near = od.with_neighbours(od.indexed(found, names, ["low"]), 1, 0)
    over = od.over(names, "__c").orderBy("__i")
    mean = F.col("s") / F.col("n")
    return not near.withColumn("__f", F.lag(mean).over(over) >= mean).where("__f and not __guest").isEmpty()


def calibrated(df: DataFrame, fit: DataFrame, p: str, by: list[str] | tuple = (), name: str = "calibrated") -> DataFrame:
    """``df`` with the fit's value at ``p``: that of the pool with p in it, between two pools on the line from one to the next, and outside all that of the nearest. Null p: null.

    Values and pools are dealt into blocks by p; a block's pools come with the last one before it and the first one behind.
    """
    by = list(by)
    marks = fit.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], F.explode(F.array(F.struct(F.col("low").alias("x")), F.struct(F.col("high").alias("x")))).alias("m"), "value").select(*[f"__k{i}" for i in range(len(by))], "m.x", "value").distinct()
    keys = [f"__k{i}" for i in range(len(by))]
    asked = df.where(F.col(p).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(p).cast("double").alias("x")).agg(F.count("*").alias("__n")).drop("__n")
    both = stored(asked.withColumn("value", F.lit(None).cast("double")).unionByName(marks).groupBy(*keys, "x").agg(F.max("value").alias("value")))
    placed = od.in_blocks(both, "x")
    point = F.when(F.col("value").isNotNull(), F.struct("x", "value"))
    ends = placed.groupBy(*keys, "__b").agg(F.min(point).alias("__first"), F.max(point).alias("__last"))
    w = od.over(keys).orderBy("__b")
    ends = ends.select(*keys, "__b", F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__behind"))
    rows = od.joined(placed, ends, [*keys, "__b"])
    own = od.over(keys, "__b").orderBy("x")
    left = F.coalesce(F.last(point, True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    right = F.coalesce(F.first(point, True).over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("__behind"))
    told = rows.withColumn("__l", left).withColumn("__r", right)
    share = F.coalesce(F.try_divide(F.col("x") - F.col("__l.x"), F.col("__r.x") - F.col("__l.x")), F.lit(0.0))
    line = F.col("__l.value") + share * (F.col("__r.value") - F.col("__l.value"))
    told = told.select(*keys, "x", F.coalesce(line, F.col("__l.value"), F.col("__r.value")).alias(name))
    renamed = told.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("x").alias("__x"), name)
    return od.joined(df.withColumn("__x", F.col(p).cast("double")), renamed, [*by, "__x"], "left").drop("__x")
