"""Trend, drift, stability, version and season operators over a time column and a metric.

Series operators take ``by`` columns. Rows get their position within the series
first (see ``ordered``); windows then reach over chunks of a series, so that no
task holds a whole one. The cumulative sums of CUSUM and Page-Hinkley are prefix
sums less their running minimum, which chunks pass on as two numbers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.session import stored

from . import inference as inf
from . import ordered as od


def day_offset(df: DataFrame, time: str, by: list[str] | tuple = ()) -> DataFrame:
    """Adds day: whole days since the series' first time."""
    by = list(by)
    at = F.unix_micros(F.col(time).cast("timestamp"))  # without a zone: in the session's
    first = df.groupBy(*by).agg(F.min(at).alias("__first"))
    return od.joined(df, first, by).withColumn("day", F.floor((at - F.col("__first")) / 86_400_000_000).cast("bigint")).drop("__first")


def linear_trend(df: DataFrame, metric: str, x: str = "day", by: list[str] | tuple = (), alpha: float = 0.05) -> DataFrame:
    """by, n, slope, intercept, r2, se (of the slope), t and dof. Fewer than three points, or one x: null."""
    rows = df.where(F.col(metric).isNotNull() & F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(metric).cast("double").alias("y"))
    agg = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0)
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    out = agg.withColumn("se", F.when(ok, se))
    return out.select(*by, "n", *[F.when(ok, F.col(c)).alias(d) for c, d in (("b", "slope"), ("a", "intercept"), ("r2", "r2"))], "se", F.when(F.col("se") > 0, F.col("b") / F.col("se")).alias("t"), F.when(ok, F.col("n") - 2).alias("dof"))


def direction(slope: Column, p: Column, n: Column, alpha: float = 0.05) -> Column:
    """increasing, decreasing, stable or insufficient_data."""
    return F.when(n < 3, "insufficient_data").when((p < alpha) & (slope > 0), "increasing").when((p < alpha) & (slope < 0), "decreasing").otherwise("stable")


def versions(df: DataFrame, version: str, metric: str) -> DataFrame:
    """version, n, mean, std (sample), median and first-to-last spread of each version."""
    return df.where(F.col(version).isNotNull() & F.col(metric).isNotNull()).groupBy(version).agg(
        F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.percentile(metric, F.lit(0.5)).alias("median"), F.var_samp(metric).alias("v"), F.var_pop(metric).alias("p")
    )


def version_changes(df: DataFrame, version: str, metric: str, consecutive: bool = True) -> DataFrame:
    """Versions next to each other by name, or every two: version_a, version_b, diff (b - a), t (pooled) and dof, and d over the mean population variance (0 if degenerate)."""
    v = versions(df, version, metric)
    a = v.select(*[F.col(c).alias(f"{c}_a") for c in v.columns])
    b = v.select(*[F.col(c).alias(f"{c}_b") for c in v.columns])
    key_a, key_b = f"{version}_a", f"{version}_b"
    if consecutive:
        before = v.select(version, F.lag(version).over(Window.orderBy(version)).alias(key_a))  # one row for each version
        pairs = b.join(before.withColumnRenamed(version, key_b), key_b).join(a, key_a)
    else:
        pairs = a.join(b, F.col(key_a) < F.col(key_b))
    t = inf.t_pooled(F.col("mean_b"), F.col("v_b"), F.col("n_b"), F.col("mean_a"), F.col("v_a"), F.col("n_a"))
    d = F.try_divide(F.col("mean_b") - F.col("mean_a"), F.sqrt((F.col("p_a") + F.col("p_b")) / 2))
    return pairs.select(F.col(key_a).alias("version_a"), F.col(key_b).alias("version_b"), (F.col("mean_b") - F.col("mean_a")).alias("diff"), t.alias("t"), (F.col("n_a") + F.col("n_b") - 2).alias("dof"), F.coalesce(d, F.lit(0.0)).alias("d"))


def timeline(df: DataFrame, version: str, time: str) -> DataFrame:
    return df.where(F.col(version).isNotNull()).groupBy(version).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def stability(df: DataFrame, time: str, metric: str, by: list[str] | tuple = ()) -> DataFrame:
    """by, n, std (population), cv, stability (1 / cv), range, iqr, and mean and sample deviation of the rolling deviation.

    The rolling window: min(10, n div 3) rows, full windows only, from n = 10 on.
    """
    by = list(by)
    rows = df.where(F.col(metric).isNotNull()).select(*by, time, F.col(metric).cast("double").alias("__x"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("__x").alias("std"), F.avg("__x").alias("mean"), (F.max("__x") - F.min("__x")).alias("range"))
    rows = stored(rows)
    placed = od.joined(od.indexed(rows, by, [time, "__x"]), whole.select(*by, F.col("n").alias("__n")), by).where("__n >= 10")
    near = od.with_neighbours(placed, 9, 0)
    last = od.over(by, "__c").orderBy("__i").rowsBetween(-9, 0)
    width = F.least(F.lit(10), F.floor(F.col("__n") / 3)).cast("int")
    window = near.withColumn("__w", width).withColumn("__v", F.collect_list("__x").over(last)).where("not __guest and __i >= __w - 1")
    own = F.slice(F.col("__v"), -F.col("__w"), F.col("__w"))
    mean = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.col("__w")
    around = window.withColumn("__own", own).withColumn("__m", mean)
    square = F.aggregate(F.transform("__own", lambda x: (x - F.col("__m")) * (x - F.col("__m"))), F.lit(0.0), lambda s, x: s + x)
    rolling = around.withColumn("__r", F.sqrt(square / (F.col("__w") - 1))).groupBy(*by).agg(F.avg("__r").alias("rolling_mean"), F.stddev_samp("__r").alias("rolling_std"))
    out = od.joined(od.joined(whole, od.quantiles(rows, "__x", [0.25, 0.75], by).drop("n"), by), rolling, by, "left") if by else whole.crossJoin(od.quantiles(rows, "__x", [0.25, 0.75]).drop("n")).crossJoin(rolling)  # one row each
    cv = F.try_divide(F.col("std"), F.col("mean"))
    return out.select(*by, "n", "std", cv.alias("cv"), F.try_divide(F.lit(1.0), cv).alias("stability"), "range", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), "rolling_mean", "rolling_std")


def drift(df: DataFrame, time: str, metric: str, by: list[str] | tuple = (), threshold: float = 3.0, ph_threshold: float = 10.0) -> DataFrame:
    """CUSUM (both sides) and Page-Hinkley against the first third of each series.

    by, n, cusum_up and cusum_down (maxima), first_up and first_down (row from
    0 of the first alarm), ph_max and first_ph. Alarms: a sum over
    ``threshold`` baseline deviations (population), with half of that as the
    allowance; Page-Hinkley: over ``ph_threshold`` with one deviation as the
    allowance. Series whose baseline doesn't vary are left out.
    """
    by = list(by)
    rows = df.where(F.col(metric).isNotNull()).select(*by, time, F.col(metric).cast("double").alias("__x"))
    placed = stored(od.joined(od.indexed(rows, by, [time, "__x"]), rows.groupBy(*by).agg(F.count("*").alias("__n")), by))
    base = placed.where(F.col("__i") < F.floor(F.col("__n") / 3)).groupBy(*by).agg(F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__sd")).where("__sd > 0")
    x, sd = F.col("__x") - F.col("__m"), F.col("__sd")
    steps = {"up": x - 0.5 * threshold * sd, "down": -x - 0.5 * threshold * sd, "ph": x - sd}
    chunked = od.with_neighbours(od.joined(placed, base, by), 0, 0)
    for k, d in steps.items():  # the sum starts at row 1, from 0
        chunked = chunked.withColumn(f"__d{k}", F.when(F.col("__i") > 0, d).otherwise(0.0))
    own = od.over(by, "__c").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    for k in steps:
        chunked = chunked.withColumn(f"__p{k}", F.sum(f"__d{k}").over(own))
    for k in steps:
        chunked = chunked.withColumn(f"__l{k}", F.min(f"__p{k}").over(own))
    # of each chunk its sum and its least running sum: what the chunks behind it start from
    chunks = chunked.groupBy(*by, "__c").agg(*[e for k in steps for e in (F.sum(f"__d{k}").alias(f"__s{k}"), F.min(f"__p{k}").alias(f"__m{k}"))])
    ahead = od.over(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    for k in steps:
        chunks = chunks.withColumn(f"__o{k}", F.coalesce(F.sum(f"__s{k}").over(ahead), F.lit(0.0)))
    for k in steps:
        chunks = chunks.withColumn(f"__a{k}", F.coalesce(F.min(F.col(f"__o{k}") + F.col(f"__m{k}")).over(ahead), F.lit(0.0)))
    rows = od.joined(chunked, chunks.select(*by, "__c", *[f"__{z}{k}" for k in steps for z in "oa"]), [*by, "__c"])
    limit = {"up": threshold * sd, "down": threshold * sd, "ph": F.lit(ph_threshold)}
    aggs = []
    for k, (most, first) in {"up": ("cusum_up", "first_up"), "down": ("cusum_down", "first_down"), "ph": ("ph_max", "first_ph")}.items():
        at = F.col(f"__p{k}") + F.col(f"__o{k}") - F.least(F.lit(0.0), F.col(f"__a{k}"), F.col(f"__l{k}") + F.col(f"__o{k}"))
        aggs += [F.max(at).alias(most), F.min(F.when(at > limit[k], F.col("__i"))).alias(first)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *aggs).where("n > 0")


def rolling_mean(df: DataFrame, time: str, metric: str, by: list[str] | tuple = (), rows: int = 10) -> DataFrame:
    """Adds rolling: the mean of the last ``rows`` rows (fewer at the start). Rows of one time are ordered by the metric."""
    by = list(by)
    near = od.with_neighbours(od.indexed(df, by, [time, metric]), rows - 1, 0)
    last = od.over(by, "__c").orderBy("__i").rowsBetween(-(rows - 1), 0)
    return near.withColumn("rolling", F.avg(metric).over(last)).where("not __guest").drop("__i", "__c", "__guest")


def hour_crosstab(df: DataFrame, time: str, label: str, labels: list[str]) -> DataFrame:
    return df.groupBy(F.hour(time).alias("hour")).pivot(label, labels).count().fillna(0)


def mean_by_time(df: DataFrame, time: str, metric: str) -> DataFrame:
    return df.groupBy(time).agg(F.avg(metric).alias("mean"))


def frames(df: DataFrame, time: str) -> DataFrame:
    """Adds frame: the number of the row's distinct time, from 1. A cumulative frame t is the rows with frame <= t."""
    times = df.where(F.col(time).isNotNull()).groupBy(time).agg(F.lit(1).alias("__one"))
    numbered = od.cumulated(times, [], time, ["__one"]).select(time, (F.col("__one_before") + 1).cast("int").alias("frame"))
    return df.join(numbered, time)


def histogram(df: DataFrame, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 to bins - 1, the last closed) and n."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(metric) - low) / (high - low) * bins))
    return df.where(F.col(metric).between(low, high)).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


#: A series with fewer rows has no seasons; periods of series by their median step in whole days (up to that many), and of the rest.
SEASONAL_ROWS, PERIODS, LONGEST_PERIOD = 12, ((1, 7), (7, 4)), 12


def infer_period(df: DataFrame, time: str, by: list[str] | tuple = (), metric: str | None = None) -> DataFrame:
    """by, n, step (median distance of neighbouring times, in seconds) and period.

    The period: 7 for steps below two days, 4 below eight, else 12 (see
    ``PERIODS``); n div 2 where there are fewer than two periods; null below 12 rows.
    With a ``metric``, rows without one don't count.
    """
    by = list(by)
    rows = df.where(F.col(time).isNotNull() & (F.col(metric).isNotNull() if metric else F.lit(True)))
    near = od.with_neighbours(od.indexed(rows.select(*by, time), by, [time]), 1, 0)
    gap = (od.as_number(df, time) - F.lag(od.as_number(df, time)).over(od.over(by, "__c").orderBy("__i"))) / 1e6
    gaps = near.withColumn("__gap", gap).where("not __guest and __gap is not null")
    found = od.quantiles(gaps, "__gap", [0.5], by).select(*by, (F.col("n") + 1).alias("n"), F.col("q")[0].alias("step"))
    days, usual = F.floor(F.col("step") / 86_400), F.lit(LONGEST_PERIOD)
    for most, period in reversed(PERIODS):
        usual = F.when(days <= most, period).otherwise(usual)
    return found.withColumn("period", F.when(F.col("n") >= SEASONAL_ROWS, _fitting(usual, F.col("n"))).cast("int"))


def _fitting(period: Column, n: Column) -> Column:
    return F.when(n < 2 * period, F.floor(n / 2)).otherwise(period)


def seasonal(df: DataFrame, time: str, metric: str, period: int | None = None, by: list[str] | tuple = ()) -> DataFrame:
    """Additive decomposition: the columns of df (rows with a metric and a time) and period, trend, season and rest.

    ``period``: of all series, or inferred for each; n div 2 where a series has fewer
    than two. Trend: the centred mean over a period (an even period's ends at
    half weight); where that is incomplete, at both ends, the line of least
    squares through the nearest ``period`` full means (at the far end, those before the last one).
    Season: the phase means of what remains, centred. Series of fewer than 12 rows have none of them.
    """
    by = list(by)
    rows = df.where(F.col(metric).isNotNull() & F.col(time).isNotNull())
    if period is None:
        about = infer_period(rows, time, by).select(*by, F.col("n").alias("__n"), "period")
    else:
        size = rows.groupBy(*by).agg(F.count("*").alias("__n"))
        about = size.withColumn("period", F.when(F.col("__n") >= SEASONAL_ROWS, _fitting(F.lit(period), F.col("__n"))).cast("int"))
    reach = (period or max(LONGEST_PERIOD, *(p for _, p in PERIODS))) // 2
    placed = od.joined(od.indexed(rows.drop("period"), by, [time, metric]), about, by)
    near = od.with_neighbours(placed, reach, reach)
    half, i, n = F.floor(F.col("period") / 2).cast("int"), F.col("__i"), F.col("__n")
    around = F.collect_list(F.col(metric).cast("double")).over(od.over(by, "__c").orderBy("__i").rowsBetween(-reach, reach))
    window = near.withColumn("__v", around).where("not __guest").drop("__c", "__guest")
    own = F.slice(F.col("__v"), F.least(F.lit(reach), i).cast("int") - half + 1, 2 * half + 1)
    inner = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) - F.when(F.col("period") % 2 == 0, (F.get(own, F.lit(0)) + F.get(own, 2 * half)) / 2).otherwise(0.0)
    full = (i >= half) & (i < n - half)
    means = stored(window.withColumn("__t", F.when(full, inner / F.col("period"))).drop("__v"))
    last = n - 1 - half
    front = (i >= half) & (i < F.least(half + F.col("period"), last))
    back = (i >= F.greatest(half, last - F.col("period"))) & (i < last)
    fit = lambda f, near_: f(F.when(near_, F.col("__t")), i.cast("double"))
    lines = means.groupBy(*by).agg(*[fit(f, where).alias(name) for where, f, name in ((front, F.regr_slope, "__fk"), (front, F.regr_intercept, "__fn"), (back, F.regr_slope, "__bk"), (back, F.regr_intercept, "__bn"))])
    line = F.when(i < half, F.col("__fk") * i + F.col("__fn")).otherwise(F.col("__bk") * i + F.col("__bn"))
    trended = od.joined(means, lines, by).withColumn("trend", F.when(F.col("period").isNotNull(), F.coalesce("__t", line))).withColumn("__ph", i % F.col("period"))
    phases = trended.groupBy(*by, "__ph").agg(F.avg(F.col(metric) - F.col("trend")).alias("__s"))
    phases = phases.withColumn("season", F.col("__s") - F.avg("__s").over(od.over(by))).drop("__s")  # ``period`` rows a series
    out = od.joined(trended, phases, [*by, "__ph"]).withColumn("rest", F.col(metric) - F.col("trend") - F.col("season"))
    return out.select(*rows.drop("period").columns, "period", "trend", "season", "rest")


def seasonal_strength(parts: DataFrame, metric: str, by: list[str] | tuple = ()) -> DataFrame:
    """by, period and strength: the variance of the season over that of the metric (0 where that doesn't vary); from ``seasonal``."""
    share = F.try_divide(F.var_pop("season"), F.var_pop(metric))
    return parts.where("period is not null").groupBy(*by, "period").agg(F.coalesce(share, F.lit(0.0)).alias("strength"))


def ks_drift(df: DataFrame, metric: str, side: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples (side true and false): n1, n2, d."""
    rows = stored(df.where(F.col(metric).isNotNull()).groupBy(F.col(metric).alias("x")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b")))
    total = rows.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    upto = od.cumulated(rows, [], "x", ["a", "b"]).crossJoin(F.broadcast(total))  # one row
    gap = F.abs(F.try_divide(F.col("a_before") + F.col("a"), F.col("n1")) - F.try_divide(F.col("b_before") + F.col("b"), F.col("n2")))
    return upto.agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("d"))


def analysis(df: DataFrame, time: str, metric: str, groups: list[str] | tuple = (), version: str | None = None, least: int = 3) -> dict[str, DataFrame]:
    """The parts of a time analysis: the overall trend, trends by each group column (groups of ``least`` rows or more), stability, drift, the inferred period and, with a version column, versions and their changes."""
    out = {"trend": linear_trend(day_offset(df, time), metric), "stability": stability(df, time, metric), "drift": drift(df, time, metric), "period": infer_period(df, time, metric=metric)}
    for g in groups:
        out[f"trend_by_{g}"] = linear_trend(day_offset(df.where(F.col(g).isNotNull()), time, [g]), metric, by=[g]).where(F.col("n") >= least)
    if version:
        out |= {"versions": versions(df, version, metric), "version_changes": version_changes(df, version, metric)}
    return out
