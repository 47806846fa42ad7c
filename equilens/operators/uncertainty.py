"""Bootstrap and posterior intervals, calibration, individual and intersectional fairness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .generate import chance

#: Cumulative Poisson(1) probabilities up to 7, from which bootstrap weights are drawn (the rest, 1e-6, counts as 8).
POISSON = (0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589, 0.9999897508)


def bootstrap_means(df: DataFrame, value: str, key: str, by: list[str] | tuple = (), replicates: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of a mean: by, n, mean, low and high (percentile interval of the replicates' means).

    A row's weight in a replicate is drawn by the hash of its key, so that
    replicates are independent of partitioning. One pass: each row updates all
    replicates' sums, which combine before the shuffle; nothing is copied per replicate.
    """
    by = list(by)
    x = F.col(value).cast("double")

    def weight(b: int) -> Column:
        u = chance(F.col(key), F.lit(b), F.lit(seed))
        return sum(((u > p).cast("int") for p in POISSON), F.lit(0))

    rows = df.where(F.col(value).isNotNull())
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.array(*[F.try_divide(F.sum(weight(b) * x), F.sum(weight(b))) for b in range(replicates)]).alias("m"))
    spread = sums.select(*by, "n", "mean", F.explode("m").alias("m")).groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return spread.select(*by, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def beta_posterior(df: DataFrame, hit: str, by: list[str] | tuple = (), a: float = 1.0, b: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Beta-Bernoulli: by, n, s, post_a, post_b, mean, low and high."""
    from equilens.functions.dist import beta_ppf_col

    g = df.where(F.col(hit).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("s"))
    g = g.withColumn("post_a", F.col("s") + a).withColumn("post_b", F.col("n") - F.col("s") + b).withColumn("mean", F.col("post_a") / (F.col("post_a") + F.col("post_b")))
    return g.withColumn("low", beta_ppf_col(F.lit(alpha / 2), "post_a", "post_b")).withColumn("high", beta_ppf_col(F.lit(1 - alpha / 2), "post_a", "post_b"))


def normal_posterior(df: DataFrame, value: str, by: list[str] | tuple = (), mu: float = 0.0, sd: float = 10.0) -> DataFrame:
    """Normal prior, unit noise: by, n, mean and sd of the posterior, low and high (95 %)."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    precision = F.col("n") + 1 / (sd * sd)
    mean, dev = (F.col("s") + mu / (sd * sd)) / precision, F.sqrt(1 / precision)
    return g.select(*by, "n", mean.alias("mean"), dev.alias("sd"), (mean - 1.96 * dev).alias("low"), (mean + 1.96 * dev).alias("high"))


def calibration_bins(df: DataFrame, p: str, y: str, by: list[str] | tuple = (), bins: int = 10, keep_unknown: bool = False) -> DataFrame:
    """by, bin (1 to ``bins``; (lo, hi], so that 0 is in none), n, mean_p and mean_y. Rows without an outcome count in n and mean_p with ``keep_unknown``."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    at = F.size(F.filter(edges, lambda e: e < F.col(p)))
    known = F.col(p).between(0, 1) if keep_unknown else F.col(p).isNotNull() & F.col(y).isNotNull()
    rows = df.where(known).withColumn("bin", at).where("bin > 0")
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_suite(df: DataFrame, p: str, y: str, by: list[str] | tuple = (), bins: int = 10) -> DataFrame:
    """by, n, brier, ece, mce, reliability, resolution and base rate's uncertainty (Murphy's parts over the same bins)."""
    by = list(by)
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    yd = F.col(y).cast("double")
    brier = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - yd, 2)).alias("brier"), F.avg(yd).alias("base"))
    b = calibration_bins(df, p, y, by, bins)
    b = b.join(brier.select(*by, "base"), by) if by else b.crossJoin(brier.select("base"))  # one row
    gap, total = F.abs(F.col("mean_p") - F.col("mean_y")), F.sum("n")
    parts = b.groupBy(*by).agg((F.sum(F.col("n") * gap) / total).alias("ece"), F.max(gap).alias("mce"), (F.sum(F.col("n") * gap * gap) / total).alias("reliability"), (F.sum(F.col("n") * F.pow(F.col("mean_y") - F.col("base"), 2)) / total).alias("resolution"))
    out = brier.join(parts, by, "left") if by else brier.crossJoin(parts)  # one row each
    return out.withColumn("uncertainty", F.col("base") * (1 - F.col("base")))


def isotonic(df: DataFrame, p: str, y: str):
    """A fitted isotonic regression of the outcome on the probability."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=p, labelCol="__y").fit(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double")))


def individual_fairness(df: DataFrame, key: str, vector: str, prediction: str, group: str, distance: str = "euclidean", block: int = 4096) -> DataFrame:
    """Per row: lipschitz (greatest |difference of predictions| / distance; 0 at distance 0), disparity (mean difference to its own group, itself included, by 1 / (distance + 1e-8)) and consistency (1 - disparity).

    ``distance``: euclidean, manhattan or cosine. Every row against every row,
    as the measure asks: rows are dealt into blocks of ``block`` (up to four times as many where there are over 32 blocks),
    and each two blocks are compared once, for both, in a task of their own; what leaves it is a maximum and two sums a row.
    """
    total = df.count()
    n = max(1, -(-total // max(block, min(4 * block, total // 32))))
    vectors = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("k"), vectors.alias("v"), F.col(prediction).cast("double").alias("p"), F.col(group).cast("string").alias("g"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    cells = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("x", F.least("b", "o")).withColumn("y", F.greatest("b", "o")).drop("o")

    def compare(cell):
        import pandas as pd

        cell = cell.sort_values("g", kind="stable")
        first = cell["x"].iloc[0]
        sides = [part for _, part in cell.groupby(cell["b"] != first)]
        if cell["y"].iloc[0] != first and len(sides) < 2:  # an empty block
            return pd.DataFrame({"k": cell["k"][:0], "lipschitz": [], "sw": [], "swd": []})
        codes, _ = pd.factorize(cell["g"])  # null: -1
        held = [(np.stack(part["v"].to_numpy()).astype(np.float64), part["p"].to_numpy(), codes[(cell["b"] != first) == far]) for far, part in zip((False, True), sides)]
        found = _compared(held[0], held[1] if len(held) > 1 else None, distance)
        return pd.concat([pd.DataFrame({"k": part["k"], "lipschitz": f[0], "sw": f[1], "swd": f[2]}) for part, f in zip(sides, found)])

    if distance not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"unknown distance {distance}")
    kind = df.schema[key].dataType.simpleString()
    tasks = min(n * (n + 1) // 2, 4096)  # by comparisons, and not by bytes, which are few
    parts = cells.repartition(tasks, "x", "y").groupBy("x", "y").applyInPandas(compare, f"k {kind}, lipschitz double, sw double, swd double")
    out = parts.groupBy("k").agg(F.max("lipschitz").alias("lipschitz"), F.try_divide(F.sum("swd"), F.sum("sw")).alias("disparity"))
    return out.withColumn("consistency", 1 - F.col("disparity")).withColumnRenamed("k", key)


#: Rows a side that are compared at once.
TILE = 512
#: Squared distances below this share of the vectors' squared sizes are computed from differences, as products would lose their digits.
CLOSE = 1e-3


def _distances(a: np.ndarray, b: np.ndarray, centre: np.ndarray, distance: str) -> np.ndarray:
    """Distances of all rows of ``a`` from all of ``b``."""
    if distance == "manhattan":
        return np.stack([np.abs(b - v).sum(1) for v in a])
    if distance == "cosine":
        size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
        return np.maximum(0.0, 1 - a @ b.T / np.maximum(size, 1e-300))
    u, w = a - centre, b - centre
    size = (u * u).sum(1)[:, None] + (w * w).sum(1)
    d = u @ w.T
    d *= -2
    d += size
    size *= CLOSE
    i, j = np.nonzero(d < size)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        d[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def _compared(one, two, distance: str) -> list[np.ndarray]:
    """Of rows (vectors, predictions, codes of groups in runs) against ``two``, or against themselves: greatest ratio, sum of weights and of weighted differences, for each side."""
    same = two is None
    two = one if same else two
    out = [np.zeros((3, len(one[1])))] if same else [np.zeros((3, len(one[1]))), np.zeros((3, len(two[1])))]
    centre = one[0].mean(0)
    for r in range(0, len(one[1]), TILE):
        a, p, g = (c[r : r + TILE] for c in one)
        for s in range(r if same else 0, len(two[1]), TILE):
            b, q, h = (c[s : s + TILE] for c in two)
            d = _distances(a, b, centre, distance)
            gap = np.abs(p[:, None] - q)
            left = out[0][:, r : r + TILE]
            right = None if same and r == s else out[-1][:, s : s + TILE]
            for code in np.intersect1d(g[g >= 0], h[h >= 0]):
                (x0, x1), (y0, y1) = ((at[0], at[-1] + 1) for at in (np.flatnonzero(g == code), np.flatnonzero(h == code)))
                weight = 1 / (d[x0:x1, y0:y1] + 1e-8)
                left[1, x0:x1] += weight.sum(1)
                if right is not None:
                    right[1, y0:y1] += weight.sum(0)
                weight *= gap[x0:x1, y0:y1]
                left[2, x0:x1] += weight.sum(1)
                if right is not None:
                    right[2, y0:y1] += weight.sum(0)
            apart = d > 0
            if not apart.all():
                d[~apart], gap[~apart] = 1.0, 0.0
            gap /= d
            np.maximum(left[0], gap.max(1), out=left[0])
            if right is not None:
                np.maximum(right[0], gap.max(0), out=right[0])
    return out


def intersections(df: DataFrame, columns: list[str], pred: str, true: str, positive: str, least: int = 5, most: int = 3) -> DataFrame:
    """All combinations of up to ``most`` columns in one pass: level, columns (names, by comma), values, n, accuracy, predicted_rate and true_rate.

    Combinations of two and more need over ``least`` rows; with more than four columns, three at a time are left out.
    """
    from itertools import combinations

    sets = [c for k in range(1, most + 1) if k < 3 or len(columns) <= 4 for c in combinations(columns, k)]
    tags = F.array(*[F.struct(F.lit(len(s)).alias("level"), F.lit(",".join(s)).alias("columns"), F.concat_ws("|", *[F.when(F.col(c).isNull(), F.lit(None).cast("string")).otherwise(F.col(c).cast("string")) for c in s]).alias("values"), F.greatest(*[F.col(c).isNull() for c in s], F.lit(False)).alias("hole")) for s in sets])
    spread = df.select(pred, true, F.explode(tags).alias("z")).where("not z.hole")
    g = spread.groupBy("z.level", "z.columns", "z.values").agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col(true)).cast("double")).alias("accuracy"), F.avg((F.col(pred) == positive).cast("double")).alias("predicted_rate"), F.avg((F.col(true) == positive).cast("double")).alias("true_rate"))
    return g.where((F.col("level") == 1) | (F.col("n") > least))


def amplification(inter: DataFrame) -> DataFrame:
    """From ``intersections``: columns a and b, their own ranges of predicted rates, the pair's range, and whether it exceeds both."""
    r = inter.groupBy("level", "columns").agg((F.max("predicted_rate") - F.min("predicted_rate")).alias("r"))
    one = r.where("level = 1")
    pair = r.where("level = 2").select(F.split("columns", ",")[0].alias("a"), F.split("columns", ",")[1].alias("b"), F.col("r").alias("pair_range"))
    out = pair.join(one.select(F.col("columns").alias("a"), F.col("r").alias("range_a")), "a").join(one.select(F.col("columns").alias("b"), F.col("r").alias("range_b")), "b")
    return out.select("a", "b", "range_a", "range_b", "pair_range", (F.col("pair_range") > F.greatest("range_a", "range_b")).alias("amplified"))


def parity_interval(df: DataFrame, group: str, hit: str, key: str, replicates: int = 100) -> DataFrame:
    """Bootstrap of the range of group rates: range, low and high."""
    g = df.where(F.col(group).isNotNull() & F.col(hit).isNotNull())
    x = F.col(hit).cast("double")

    def weight(b: int) -> Column:
        u = chance(F.col(key), F.lit(b), F.lit(7))
        return sum(((u > p).cast("int") for p in POISSON), F.lit(0))

    per = g.groupBy(group).agg(F.avg(x).alias("rate"), F.array(*[F.try_divide(F.sum(weight(b) * x), F.sum(weight(b))) for b in range(replicates)]).alias("m"))
    wide = per.select("rate", F.posexplode("m").alias("b", "m"))
    ranges = wide.groupBy("b").agg((F.max("rate") - F.min("rate")).alias("range"), (F.max("m") - F.min("m")).alias("r"))
    return ranges.agg(F.first("range").alias("range"), F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("range", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


