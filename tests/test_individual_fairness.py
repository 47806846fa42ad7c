"""Rows against each other, each two blocks once."""

import math
import random

import numpy as np
import pytest

from equilens.operators import uncertainty as un


def brute(rows):
    out = {}
    for k, v, p, g in rows:
        far = [(math.dist(v, w), abs(p - q), g is not None and g == h) for _, w, q, h in rows]
        weight = [(1 / (x + 1e-8), y) for x, y, same in far if same]
        out[k] = (max((y / x for x, y, _ in far if x > 0), default=0.0), sum(w * y for w, y in weight) / sum(w for w, _ in weight) if weight else None)
    return out


def test_copies_near_copies_and_far_vectors(spark):
    rng = random.Random(5)
    rows = [(k, [1e4 + rng.random() * (1 if k % 3 else 1e-7) for _ in range(3)], rng.random(), (None, "a", "b")[k % 3 if k % 7 else 0]) for k in range(60)]
    rows += [(100 + k, list(rows[k][1]), rng.random(), rows[k][3]) for k in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "k int, v array<double>, p double, g string")
    want = brute(rows)
    for block in (7, 1000):
        got = {r["k"]: (r["lipschitz"], r["disparity"]) for r in un.individual_fairness(df, "k", "v", "p", "g", block=block).collect()}
        assert got.keys() == want.keys()
        for k, (ratio, gap) in want.items():
            assert got[k][0] == pytest.approx(ratio, rel=1e-7) and (got[k][1] is None) == (gap is None)
            assert gap is None or got[k][1] == pytest.approx(gap, rel=1e-7, abs=1e-9)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k int, v array<float>, p double, g string")
    assert un.individual_fairness(none, "k", "v", "p", "g").collect() == []


def test_each_two_blocks_are_compared_once():
    rng = np.random.default_rng(1)
    one = (rng.normal(size=(700, 4)), rng.normal(size=700), np.sort(rng.integers(-1, 3, 700)))
    two = tuple(c[:600] for c in (rng.normal(size=(700, 4)), rng.normal(size=700), np.sort(rng.integers(-1, 3, 700))))
    here, there = un._compared(one, two, "euclidean")
    back, _ = un._compared(two, one, "euclidean")
    assert np.allclose(back, there)
    whole = un._compared(tuple(np.concatenate([a, b])[order] for a, b in zip(one, two) for order in [np.argsort(np.concatenate([one[2], two[2]]), kind="stable")]), None, "euclidean")[0]
    own = np.concatenate([un._compared(one, None, "euclidean")[0], un._compared(two, None, "euclidean")[0]], axis=1)
    both = np.concatenate([here, there], axis=1)
    order = np.argsort(np.concatenate([one[2], two[2]]), kind="stable")
    assert np.allclose(whole, np.concatenate([np.maximum(own[:1], both[:1]), own[1:] + both[1:]])[:, order])
