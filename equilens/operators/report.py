"""Aggregates behind reports and charts: summaries, tables, crosstabs, correlations and networks."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from equilens.session import stored

from . import inference as inf
from . import ordered as od

#: Words in column names that mark bias metrics and demographic columns.
METRIC_WORDS = ("bias", "fairness", "parity", "odds", "impact", "accuracy", "difference")
DEMOGRAPHIC_WORDS = ("gender", "age", "ethnicity", "location", "race", "group")


def metric_columns(df: DataFrame, most: int = 8) -> list[str]:
    """Numeric columns whose name holds a metric word; where none does, numeric columns; at most ``most``."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    return ([c for c in numeric if any(w in c.lower() for w in METRIC_WORDS)] or numeric)[:most]


def demographic_columns(df: DataFrame, most: int = 8) -> list[str]:
    return [c for c, t in df.dtypes if any(w in c.lower() for w in DEMOGRAPHIC_WORDS)][:most]


def share_gap(df: DataFrame, group: str, label: str, by: list[str] | tuple = ()) -> DataFrame:
    """by and violation: the greatest range, over labels, of a label's share between groups (absent labels count as 0)."""
    by = list(by)
    cells = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(*by, group, label).agg(F.count("*").alias("o"))
    w = Window.partitionBy(*by, group)
    shares = cells.withColumn("s", F.col("o") / F.sum("o").over(w))
    n_groups = cells.groupBy(*by).agg(F.countDistinct(group).alias("g"))
    per = shares.groupBy(*by, label).agg(F.max("s").alias("hi"), F.min("s").alias("lo"), F.count("*").alias("k"))
    joined = per.join(n_groups, by) if by else per.crossJoin(n_groups)  # one row
    return joined.groupBy(*by).agg(F.max(F.col("hi") - F.when(F.col("k") < F.col("g"), 0.0).otherwise(F.col("lo"))).alias("violation"))


def accuracy_gap(df: DataFrame, group: str, correct: str) -> DataFrame:
    """Range over groups of correct rows per row of the group."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg((F.sum(F.coalesce(F.col(correct).cast("int"), F.lit(0))) / F.count("*")).alias("a"))
    return g.agg((F.max("a") - F.min("a")).alias("accuracy_gap"))


def summary(df: DataFrame, subject: str, model: str, ok: str, correct: str, seconds: str, cost: str) -> DataFrame:
    """One row: n, subjects, models, success_rate, accuracy, mean and median seconds, and total cost; zeros when empty.

    Distinct subjects and models are counted, and the median is found, from tables that are dealt out by value: no task gets all values.
    """
    z = lambda c: F.coalesce(c, F.lit(0.0))
    rows = stored(df.select(F.col(subject).alias("s"), F.col(model).alias("m"), F.col(ok).cast("double").alias("k"), F.col(correct).alias("c"), F.col(seconds).alias("t"), F.col(cost).alias("x")))
    totals = rows.agg(F.count("*").alias("n"), z(F.avg("k")).alias("success_rate"), z(F.avg("c")).alias("accuracy"), z(F.avg("t")).alias("mean_seconds"), z(F.sum("x")).alias("total_cost"))
    values = stored(rows.where("t is not null").groupBy("t").agg(F.count("*").alias("o")))
    one_row = [
        rows.select("s").distinct().agg(F.count("s").alias("subjects")), rows.select("m").distinct().agg(F.count("m").alias("models")),
        od.quantiles(values, "t", [0.5], weight="o").agg(z(F.max(F.col("q")[0])).alias("median_seconds")),
    ]
    for part in one_row:
        totals = totals.crossJoin(part)
    return totals.select("n", "subjects", "models", "success_rate", "accuracy", "mean_seconds", "median_seconds", "total_cost")


def cohens_d(df: DataFrame, value: str, side: Column, by: list[str] | tuple = ()) -> DataFrame:
    """by, n1, n2, d (absolute, pooled sample variance), t (pooled) and dof."""
    m = inf.two_sample(df, value, side, by)
    c = [F.col(x) for x in ("m1", "v1", "n1", "m2", "v2", "n2")]
    pooled = ((c[2] - 1) * c[1] + (c[5] - 1) * c[4]) / (c[2] + c[5] - 2)
    d = F.when((c[2] > 1) & (c[5] > 1) & (pooled > 0), F.abs(c[0] - c[3]) / F.sqrt(pooled))
    return m.select(*by, "n1", "n2", d.alias("d"), inf.t_pooled(*c).alias("t"), (c[2] + c[5] - 2).alias("dof"))


def mean_ci(df: DataFrame, value: str, by: list[str] | tuple = (), level: float = 0.95) -> DataFrame:
    """by, n, mean, sem, low and high: by t below 30 rows, else by the normal."""
    from equilens.functions.dist import norm_ppf, t_ppf_col

    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("sem"))
    p = 1 - (1 - level) / 2
    q = F.when(F.col("n") < 30, t_ppf_col(F.lit(p), F.col("n") - 1)).otherwise(norm_ppf(p))
    return g.withColumn("low", F.col("mean") - q * F.col("sem")).withColumn("high", F.col("mean") + q * F.col("sem"))


def crosstab_percent(df: DataFrame, row: str, col: str, columns: list[str]) -> DataFrame:
    """row and, for each of ``columns``, the row's percent with that value."""
    known = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return known.groupBy(row).agg(*[(100.0 * F.count_if(F.col(col) == c) / F.count("*")).alias(c) for c in columns])


def model_table(df: DataFrame, model: str, correct: str, seconds: str) -> DataFrame:
    """model, n, accuracy, sem and mean seconds, to three places (half to even)."""
    g = df.groupBy(model).agg(F.count("*").alias("n"), F.avg(correct).alias("accuracy"), (F.stddev_samp(correct) / F.sqrt(F.count(correct))).alias("sem"), F.avg(seconds).alias("seconds"))
    return g.select(model, "n", *[F.bround(c, 3).alias(c) for c in ("accuracy", "sem", "seconds")])


def counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label)


def banded(df: DataFrame, metric: str) -> DataFrame:
    """Adds band: Excellent below 0.05, Good below 0.1, Moderate below 0.2, else Poor."""
    x = F.col(metric)
    return df.withColumn("band", F.when(x < 0.05, "Excellent").when(x < 0.1, "Good").when(x < 0.2, "Moderate").otherwise("Poor"))


def radar(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric and 1 - value, in long form, of a one-row frame."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (1 - F.col(m)).alias("value")) for m in metrics])).alias("z")).select("z.*")


def surface(df: DataFrame, x: str, y: str, metric: str, columns: list[str]) -> DataFrame:
    """Means of a metric by x (rows) and y (columns), empty cells 0."""
    return df.where(F.col(x).isNotNull()).groupBy(x).pivot(y, columns).agg(F.avg(metric)).fillna(0.0)


def profile_1d(df: DataFrame, x: str, metric: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(x).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))


def projection(df: DataFrame, columns: list[str], k: int = 2):
    """Principal components of columns (texts as codes): adds component (a vector of ``k``). Null rows are left out."""
    from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler

    names = []
    for c, t in df.select(*columns).dtypes:
        if t == "string":
            df = StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="skip", stringOrderType="alphabetAsc").fit(df).transform(df)
        names.append(f"__{c}" if t == "string" else c)
    v = VectorAssembler(inputCols=names, outputCol="__v", handleInvalid="skip").transform(df)
    out = PCA(k=k, inputCol="__v", outputCol="component").fit(v).transform(v)
    return out.drop("__v", *[n for n in names if n.startswith("__")])


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """a, b, n and r of every two metrics, on the rows that have both.

    A first pass finds the means (so that sums of squares stay small), a second
    one the sums of products of all pairs, in Arrow batches; a task passes on one matrix.
    """
    import numpy as np
    import pyarrow as pa

    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    means = [m or 0.0 for m in df.agg(*[F.avg(F.col(m).cast("double")) for m in metrics]).first()]

    def moments(batches):
        total = np.zeros((6, len(metrics), len(metrics)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1) - means
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x, 0.0)
            total += np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
        at = [(i, j) for i in range(len(metrics)) for j in range(i + 1, len(metrics))]
        cols = [pa.array([metrics[i] for i, _ in at]), pa.array([metrics[j] for _, j in at]), *(pa.array([t[i, j] for i, j in at]) for t in total)]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    numbers = df.select(*[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(f"m{i}") for i, m in enumerate(metrics)])
    parts = numbers.mapInArrow(moments, "a string, b string, n double, x double, y double, xx double, yy double, xy double")
    s = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    c = {k: F.col(k) for k in ("n", "x", "y", "xx", "yy", "xy")}
    spread = (c["xx"] - F.try_divide(c["x"] * c["x"], c["n"])) * (c["yy"] - F.try_divide(c["y"] * c["y"], c["n"]))
    r = F.when(spread > 0, (c["xy"] - F.try_divide(c["x"] * c["y"], c["n"])) / F.sqrt(spread))
    return s.select("a", "b", c["n"].cast("bigint").alias("n"), r.alias("r"))


def network(df: DataFrame, metrics: list[str], least: float = 0.3) -> DataFrame:
    """Correlations of at least ``least`` in size: a, b, r, weight and the degrees of both ends."""
    e = correlations(df, metrics).where(F.abs("r") >= least)
    ends = e.select(F.explode(F.array("a", "b")).alias("m")).groupBy("m").agg(F.count("*").alias("d"))
    out = e.join(ends.select(F.col("m").alias("a"), F.col("d").alias("degree_a")), "a").join(ends.select(F.col("m").alias("b"), F.col("d").alias("degree_b")), "b")
    return out.select("a", "b", "r", F.abs("r").alias("weight"), "degree_a", "degree_b")


def influence(df: DataFrame, demographics: list[str], metrics: list[str], least: float = 0.1) -> DataFrame:
    """Correlations of demographic codes (rank of the value, by name; null is -1) with metrics: demographic, metric, n, r and t, where |r| exceeds ``least``."""
    coded = df
    for d in demographics:
        codes = od.numbered(df.select(d).distinct().where(F.col(d).isNotNull()), d, f"__{d}")
        coded = coded.join(codes.withColumnRenamed(d, f"__k{d}"), F.col(d) == F.col(f"__k{d}"), "left").withColumn(f"__{d}", F.coalesce(f"__{d}", F.lit(-1)))
    pairs = [(d, m) for d in demographics for m in metrics]
    one = coded.agg(*[F.struct(F.lit(d).alias("demographic"), F.lit(m).alias("metric"), F.count(m).alias("n"), F.corr(F.when(F.col(m).isNotNull(), F.col(f"__{d}")), m).alias("r")).alias(f"c{i}") for i, (d, m) in enumerate(pairs)])
    out = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(pairs))])).alias("z")).select("z.*").where(F.abs("r") > least)
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def metric_table(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """by, metric, mean and std, in long form."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("z")).select(by, "z.*")
    return long.groupBy(by, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def quartiles(df: DataFrame, by: str, metric: str) -> DataFrame:
    g = df.where(F.col(by).isNotNull() & F.col(metric).isNotNull()).groupBy(by).agg(F.percentile(metric, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"))
    return g.select(by, *[F.col("q")[i].alias(f"q{i}") for i in range(5)])


@F.pandas_udf(DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf)


def qq(df: DataFrame, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """Points of a Q-Q plot against the normal: by, i (from 1), theoretical and value, for each row with a value.

    theoretical: the normal's quantile at the median of the i-th order statistic,
    (i - 0.3175) / (n + 0.365), of the last 0.5 ** (1 / n), of the first what that leaves of 1. Ranks come from blocks, not from a task with all rows.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("value"))
    placed = od.joined(od.indexed(rows, by, ["value"], "__i"), rows.groupBy(*by).agg(F.count("*").alias("__n")), by).withColumn("i", F.col("__i") + 1)
    n, last = F.col("__n"), F.pow(F.lit(0.5), 1 / F.col("__n"))
    p = F.when(F.col("i") == n, last).when(F.col("i") == 1, 1 - last).otherwise((F.col("i") - 0.3175) / (n + 0.365))
    return placed.select(*by, "i", _normal_quantile(p).alias("theoretical"), "value")


def qq_fit(points: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """The line of least squares through the points of ``qq``: by, n, slope, intercept and r."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("value", "theoretical").alias("slope"), F.regr_intercept("value", "theoretical").alias("intercept"), F.corr("value", "theoretical").alias("r"))


def trapezoid(points: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """Area under points sorted by x: auc."""
    w = Window.partitionBy(F.lit(0)).orderBy(x, y)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("s", step).agg(F.sum("s").alias("auc"))


def stars(df: DataFrame, metric: str) -> DataFrame:
    """Adds stars: three above 0.8 of the greatest value, two above 0.6, one above 0.4."""
    top = F.max(metric).over(Window.partitionBy(F.lit(0)))
    return df.withColumn("stars", F.when(F.col(metric) > 0.8 * top, "***").when(F.col(metric) > 0.6 * top, "**").when(F.col(metric) > 0.4 * top, "*").otherwise(""))


def dashboard(df: DataFrame, model: str, models: list[str], time: str, low, high, order: list[str], rows: int = 100) -> DataFrame:
    """The first ``rows`` rows, in ``order``, of some models within some time."""
    return df.where(F.col(model).isin(models) & F.col(time).between(F.lit(low), F.lit(high))).orderBy(*order).limit(rows)


def refreshed(
    df: DataFrame, metric: str, demographics: list[str] | tuple = (), models: list[str] | tuple = (), low=None, high=None, model: str = "model", time: str | None = "timestamp",
    metrics: list[str] | tuple = (), order: list[str] | tuple = (), bins: int = 20, rows: int = 100,
) -> dict[str, DataFrame]:
    """The frames of a dashboard under its filters, each lazy: main, network, temporal, distribution and table.

    Filters: ``models`` (all where none is given) and the time from ``low`` to ``high``
    (both or neither). main: the mean of the metric and n by ``demographics``, or without any the histogram of distribution;
    network: correlated ``metrics`` (numeric columns where none are given); temporal: the mean by time, or
    without a time column its quartiles; distribution: ``bins`` equal bins from the least to the greatest value (bin, from, n);
    table: the first ``rows`` rows in ``order``. Columns that ``df`` doesn't have don't filter.
    """
    kept = df
    if models and model in df.columns:
        kept = kept.where(F.col(model).isin(list(models)))
    if low is not None and high is not None and time in df.columns:
        kept = kept.where(F.col(time).between(F.lit(low), F.lit(high)))
    known = kept.where(F.col(metric).isNotNull()).withColumn("__m", F.col(metric).cast("double"))
    span = known.agg(F.min("__m").alias("__low"), F.max("__m").alias("__high"))
    width = (F.col("__high") - F.col("__low")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("__m") - F.col("__low"), width)), F.lit(0))).cast("int")  # of one value: the first
    dealt = known.crossJoin(F.broadcast(span))  # one row
    distribution = dealt.groupBy(at.alias("bin"), (F.col("__low") + at * width).alias("from")).agg(F.count("*").alias("n"))
    main = kept.groupBy(*demographics).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n")) if demographics else distribution
    temporal = kept.where(F.col(time).isNotNull()).groupBy(time).agg(F.avg(metric).alias("mean")) if time in df.columns else quartiles(kept.withColumn("all", F.lit("all")), "all", metric)
    return {"main": main, "network": network(kept, list(metrics) or metric_columns(kept)), "temporal": temporal, "distribution": distribution, "table": (kept.orderBy(*order) if order else kept).limit(rows)}


def recommendations(df: DataFrame, n: int, metrics: list[str], demographics: list[str], models: int, timed: bool) -> list[str]:
    """What a table of ``n`` rows supports, as short advice."""
    rules = (
        (len(metrics) > 3, "compare metrics in a correlation network"), (len(demographics) > 2, "look at intersections of demographics"), (timed, "follow metrics over time"),
        (models > 2, "compare models pairwise with corrected p-values"), (n < 100, "collect more rows before drawing conclusions"),
    )
    return [text for holds, text in rules if holds]


class Chart:
    """A chart description built step by step; ``data`` gives the grouped frame that a renderer would draw, ``build`` all that it needs besides."""

    #: Geometries, and functions that a scale puts a continuous axis through.
    LAYERS = ("point", "line", "bar")
    SCALES = {"linear": lambda c: c, "log10": lambda c: F.when(c > 0, F.log10(c)), "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "reverse": lambda c: -c}

    def __init__(self, df: DataFrame):
        self.df, self.x, self.y, self.color, self.size, self.layers, self.titles = df, None, None, None, None, [], {}
        self.facets: list[str] = []
        self.scales: dict[str, str] = {}
        self.limits: dict[str, tuple[float, float]] = {}
        self.style: dict[str, str] = {}

    def aes(self, x: str, y: str, color: str | None = None, size: str | None = None) -> "Chart":
        self.x, self.y, self.color, self.size = x, y, color, size
        return self

    def layer(self, kind: str) -> "Chart":
        if kind not in self.LAYERS:
            raise ValueError(kind)
        self.layers.append(kind)
        return self

    def facet(self, *columns: str) -> "Chart":
        """One panel for each value of the columns."""
        self.facets += columns
        return self

    def scale(self, axis: str, kind: str = "linear", limits: tuple[float, float] | None = None) -> "Chart":
        """Put x or y through a function; rows whose value is outside ``limits``, before that, are left out."""
        if axis not in ("x", "y") or kind not in self.SCALES:
            raise ValueError(f"{axis}: {kind}")
        self.scales[axis] = kind
        if limits:
            self.limits[axis] = limits
        return self

    def theme(self, **style: str) -> "Chart":
        self.style |= style
        return self

    def labs(self, **titles: str) -> "Chart":
        self.titles |= titles
        return self

    def data(self) -> DataFrame:
        """Rows for points, else the mean of y by x, color and facets; y is averaged before its scale."""
        if self.x is None or self.y is None:
            raise ValueError("aes comes first")
        column = {"x": self.x, "y": self.y}
        df = self.df
        for axis, (low, high) in self.limits.items():
            df = df.where(F.col(column[axis]).between(low, high))
        keys = [c for c in dict.fromkeys((self.x, self.color, *self.facets)) if c]
        if "point" in self.layers:
            out = df.select(*dict.fromkeys([*keys, self.y, *([self.size] if self.size else [])]))
        else:
            out = df.groupBy(*keys).agg(F.avg(self.y).alias(self.y), *([F.avg(self.size).alias(self.size)] if self.size else []))
        for axis, kind in self.scales.items():
            out = out.withColumn(column[axis], self.SCALES[kind](F.col(column[axis])))
        return out if "point" in self.layers else out.orderBy(*self.facets, *[c for c in keys if c not in self.facets])

    def build(self) -> dict:
        """The description: aesthetics, layers, facets, scales, limits, theme and titles, and data."""
        aes = {k: v for k, v in (("x", self.x), ("y", self.y), ("color", self.color), ("size", self.size)) if v}
        return {"aes": aes, "layers": list(self.layers), "facets": list(self.facets), "scales": dict(self.scales), "limits": dict(self.limits), "theme": dict(self.style), "labs": dict(self.titles), "data": self.data()}
