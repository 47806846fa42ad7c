"""Change points equal an unpruned dynamic programme over the same costs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import changes as ch


def steps(rng, n):
    level, out = 0.0, []
    for k in range(n):
        if rng.random() < 0.02:
            level += rng.choice([-4, 3, 6])
        out.append(level + rng.gauss(0, 1))
    return out


def cheapest(x, penalty, jump, least):
    """By trying every last segment, with costs written out."""
    gamma = ch.bandwidth(np.array(x))
    n = len(x)

    def cost(a, b):
        return (b - a) - sum(math.exp(-gamma * (x[i] - x[j]) ** 2) for i in range(a, b) for j in range(a, b)) / (b - a)

    allowed = [*range(0, n, jump), n]
    best, begins = {0: 0.0}, {0: []}
    for b in allowed[1:]:
        options = [(best[a] + cost(a, b) + penalty, a) for a in allowed if a in best and b - a >= least]
        if options:
            total, a = min(options)
            best[b], begins[b] = total, [*begins[a], a]
    return begins[n]


@pytest.mark.parametrize("jump, least, penalty", [(5, 2, 3.0), (1, 2, 1.0), (1, 7, 2.0), (3, 1, 10.0)])
def test_equals_an_unpruned_programme(jump, least, penalty):
    rng = random.Random(jump * 10 + least)
    for n in (10, 23, 40, 60):
        x = np.array(steps(rng, n))
        cost = ch.GramCost(x, ch.bandwidth(x))
        got = ch.partition(cost, n, penalty, jump, least)
        assert got == ch.partition(cost, n, penalty, jump, least, pruned=False) == cheapest(list(x), penalty, jump, least)


def test_features_give_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, 300)
    gamma = ch.bandwidth(x)
    f = ch.features(x, gamma, x.min(), x.max())
    assert np.abs(f @ f.T - np.exp(-gamma * (x[:, None] - x[None, :]) ** 2)).max() < 1e-7
    begin, end = np.array([0, 17, 120]), 280
    assert np.allclose(ch.FeatureCost(np.ones(300), f)(begin, end), ch.GramCost(x, gamma)(begin, end), atol=1e-5)
    far = np.array([0.0, 1.0, 1e12])  # beyond what the features resolve: drawn in
    assert np.isfinite(ch.features(far, 1.0, 0.0, 1e12)).all()


def test_series_long_and_short(spark, monkeypatch):
    monkeypatch.setattr(ch, "CHUNK", 60)
    rng = random.Random(9)
    levels = [0, 0, 8, 8, 8, 0, 0, 0, 0, 16, 16]  # of 50 rows each
    long = [levels[k // 50] + rng.gauss(0, 1) for k in range(550)]
    short = [0.0 + rng.gauss(0, 0.1) for _ in range(25)] + [5.0 + rng.gauss(0, 0.1) for _ in range(20)]
    rows = [("long", k, x) for k, x in enumerate(long)] + [(None, k, x) for k, x in enumerate(short)] + [("few", k, 1.0 * k) for k in range(9)]
    rows += [("same", k, 2.0) for k in range(30)] + [("short", 1, None)]
    df = spark.createDataFrame(rows, "s string, k long, x double").withColumn("ts", F.timestamp_seconds("k"))
    # chunks of 60 rows in this process and in the workers: the size goes along with the function
    got = {}
    for r in ch.change_points(df, "ts", "x", ["s"], penalty=5.0).collect():
        got.setdefault(r["s"], []).append((r["begin"], r["n"]))
    assert sorted(got["long"]) == [(0, 100), (100, 150), (250, 200), (450, 100)]
    assert sorted(b for b, _ in got[None]) == cheapest(short, 5.0, 5, 2)
    assert got["same"] == [(0, 30)] and "few" not in got and "short" not in got
    assert ch.change_points(df.limit(0), "ts", "x").count() == 0


def test_query_equals_unpruned_programmes(spark):
    from equilens.plans.temporal import events, t03

    got, own = {}, {}
    for r in t03(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["event_type"], []).append(r["begin"])
    for r in sorted(events(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r["ts"], r["value"])):
        own.setdefault(r["event_type"], []).append(r["value"])
    assert got.keys() == own.keys()
    for kind, x in own.items():
        x = np.array(x)
        assert sorted(got[kind]) == ch.partition(ch.GramCost(x, ch.bandwidth(x)), len(x), 10.0, 5, 2, pruned=False)
