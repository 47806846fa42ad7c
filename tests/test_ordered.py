"""Series operators over small blocks equal plain Python, and themselves over one block."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import inference as inf
from equilens.operators import ordered as od
from equilens.operators import temporal as te


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(od, "BLOCK_ROWS", 16)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randrange(10**6) if k % 9 else 777, rng.choice([round(rng.gauss(0, 1) + k / 100, 3), 1.5])) for k in range(150)]
    df = spark.createDataFrame([(k, s, t, x) for k, s, t, x in rows], "id int, s string, t long, x double").withColumn("ts", F.timestamp_seconds("t"))
    return rows, df.cache()


def test_positions(small, series):
    rows, df = series
    got = {r["id"]: r["__i"] for r in od.indexed(df, ["s"], ["ts", "id"]).collect()}
    for s in ("a", "b", None):
        own = sorted((t, k) for k, z, t, _ in rows if z == s)
        assert [got[k] for _, k in own] == list(range(len(own)))
    assert od.indexed(df.limit(0), [], ["ts"]).count() == 0
    dealt = od.in_blocks(df, "ts").groupBy("__b").count().collect()
    assert len(dealt) > 5


def test_cumulated_and_quantiles(small, series):
    rows, df = series
    cells = df.groupBy("s", "x").agg(F.count("*").alias("n"))
    for r in od.cumulated(cells, ["s"], "x", ["n"]).collect():
        assert r["n_before"] == sum(z == r["s"] and x < r["x"] for _, z, _, x in rows)
    for r in od.quantiles(df, "x", [0, 0.1, 0.5, 0.75, 1], ["s"]).collect():
        own = sorted(x for _, z, _, x in rows if z == r["s"])
        want = []
        for p in (0, 0.1, 0.5, 0.75, 1):
            at = p * (len(own) - 1)
            want.append(own[math.floor(at)] + (at - math.floor(at)) * (own[math.ceil(at)] - own[math.floor(at)]))
        assert r["n"] == len(own) and r["q"] == pytest.approx(want)
    assert od.quantiles(df, "x", [0.5]).first()["n"] == len(rows)


def same(a, b):
    order = lambda rows: sorted(([f"{v:.7g}" if isinstance(v, float) else str(v) for v in r] for r in rows))
    assert order(a) == order(b)


def test_blocks_equal_one_block(monkeypatch, series, by=("s",)):
    _, df = series
    df = df.withColumn("ts", F.timestamp_micros(F.col("t") * 1000 + F.col("id")))  # no ties: rolling means have one order
    parts = {
        "stability": lambda: te.stability(df, "ts", "x", by), "drift": lambda: te.drift(df, "ts", "x", by), "rolling": lambda: te.rolling_mean(df, "ts", "x", by, 7), "odd": lambda: te.seasonal(df, "ts", "x", 7, by),
        "even": lambda: te.seasonal(df, "ts", "x", 12, by), "ks": lambda: te.ks_drift(df, "x", F.col("id") < 60), "frames": lambda: te.frames(df, "t").select("id", "frame"),
        "kruskal": lambda: inf.kruskal(df.withColumn("g", F.col("id") % 3), "g", "x", by), "spearman": lambda: inf.spearman(df.where("s is not null"), "t", "x", by), "period": lambda: te.infer_period(df, "ts", by),
    }
    whole = {k: f().collect() for k, f in parts.items()}
    monkeypatch.setattr(od, "BLOCK_ROWS", 30)
    for k, f in parts.items():
        same(whole[k], f().collect())


def test_drift_equals_recursion(small, spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) + (2 if k > 120 else 0) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(xs)), "t int, x double")
    r = te.drift(df, "t", "x").first()
    base = xs[:66]
    m = sum(base) / 66
    sd = math.sqrt(sum((x - m) ** 2 for x in base) / 66)
    up = down = 0.0
    ups, downs = [0.0], [0.0]
    for x in xs[1:]:
        up, down = max(0, up + x - m - 1.5 * sd), max(0, down - (x - m) - 1.5 * sd)
        ups.append(up)
        downs.append(down)
    assert (r["cusum_up"], r["cusum_down"]) == pytest.approx((max(ups), max(downs)))
    assert r["first_up"] == next(i for i, v in enumerate(ups) if v > 3 * sd) and r["n"] == 200


def plain_seasons(x, period):
    """The decomposition by lists: trend, season."""
    n = len(x)
    period = period if n >= 2 * period else n // 2
    half = period // 2
    weight = [1.0 if period % 2 or 0 < k < 2 * half else 0.5 for k in range(2 * half + 1)]
    trend = [sum(w * x[i - half + k] for k, w in enumerate(weight)) / period if half <= i < n - half else None for i in range(n)]
    last = n - 1 - half
    for near, ends in ((range(half, min(half + period, last)), range(half)), (range(max(half, last - period), last), range(last + 1, n))):
        k, c = np.polyfit(list(near), [trend[i] for i in near], 1)
        for i in ends:
            trend[i] = k * i + c
    means = [np.mean([x[i] - trend[i] for i in range(p, n, period)]) for p in range(period)]
    return trend, [means[i % period] - np.mean(means) for i in range(n)]


@pytest.mark.parametrize("n, period", [(60, 7), (61, 12), (20, 12), (13, 7), (40, 4)])
def test_seasons_equal_lists(spark, monkeypatch, n, period):
    rng = random.Random(n)
    x = [rng.gauss(0, 1) + k / 10 + math.sin(k) for k in range(n)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "t int, x double")
    for rows in (od.BLOCK_ROWS, 16):
        monkeypatch.setattr(od, "BLOCK_ROWS", rows)
        got = te.seasonal(df, "t", "x", period).orderBy("t").collect()
        trend, season = plain_seasons(x, period)
        assert [r["trend"] for r in got] == pytest.approx(trend)
        assert [r["season"] for r in got] == pytest.approx(season)
        assert [r["rest"] for r in got] == pytest.approx([a - b - c for a, b, c in zip(x, trend, season)])
    strength = te.seasonal_strength(te.seasonal(df, "t", "x", period), "x").first()
    assert strength["strength"] == pytest.approx(np.var(season) / np.var(x))


def test_periods(spark):
    step = lambda seconds, n=200: spark.range(n).select(F.timestamp_seconds(F.col("id") * seconds).alias("ts"), F.sin("id").alias("x"))
    day = 86_400
    for seconds, period in ((3600, 7), (day, 7), (2 * day - 1, 7), (2 * day, 4), (7 * day, 4), (8 * day, 12), (30 * day, 12)):
        assert te.infer_period(step(seconds), "ts").first()["period"] == period
    assert te.infer_period(step(30 * day, 20), "ts").first()["period"] == 10
    assert te.infer_period(step(day, 11), "ts").first()["period"] is None
    few = te.seasonal(step(day, 11), "ts", "x").collect()
    assert len(few) == 11 and all(r["trend"] is None and r["season"] is None for r in few)
    assert te.seasonal_strength(te.seasonal(step(day, 11), "ts", "x"), "x").count() == 0
