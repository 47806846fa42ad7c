"""Pruned top-k equals all pairs, for clustered and other vectors, broadcast and by cells."""

import random

import numpy as np
import pytest

from equilens.operators import nearest as ne


def vectors(rng, n, dim=6, centres=8):
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    out = [[x + rng.gauss(0, 0.08) for x in rng.choice(middles)] for _ in range(n)]
    out[3], out[4], out[5], out[17] = [0.0] * dim, out[9], out[9], [x * 30 for x in out[9]]
    return out


def brute(queries, entries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-round(float(np.dot(v, w)), 12), e) for e, w in entries if w is not None)[:k]
        out[q] = [e for _, e in scored]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["entry"])
    return out


@pytest.mark.parametrize("clusters", [None, 1, 12, 200])
@pytest.mark.parametrize("few", [True, False])
def test_equals_all_pairs(spark, monkeypatch, clusters, few):
    rng = random.Random(clusters or 0)
    if not few:
        monkeypatch.setattr(ne, "BROADCAST_BYTES", 100)
    vs = vectors(rng, 260)
    rows = [(i, v if i != 77 else None, f"m{i % 3}") for i, v in enumerate(vs)]
    e = spark.createDataFrame(rows, "entry long, vector array<double>, model string")
    asked = [(i, vs[i]) for i in range(0, 260, 9)]
    q = spark.createDataFrame([*asked, (999, None)], "query long, vector array<double>")
    ix = ne.index(e, extra=["model"], clusters=clusters)
    assert ix.counts.sum() == 259
    for k in (1, 5):
        found = ne.top_k(q, ix, k, query_block=7, entry_block=11)
        assert result(found) == brute(asked, [(i, v) for i, v, _ in rows], k)
        assert all(r["model"] == f"m{r['entry'] % 3}" for r in found.collect())


def test_more_neighbours_than_entries_and_empty_tables(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "entry long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.5])], "query long, vector array<double>")
    assert result(ne.top_k(q, ne.index(e), 5)) == {1: [1, 2]}
    assert ne.top_k(q, ne.index(e.limit(0)), 5).count() == 0
    assert ne.top_k(q.limit(0), ne.index(e), 5).count() == 0


def test_bounds_hold_and_clusters_are_skipped(spark):
    rng = random.Random(5)
    vs = np.array(vectors(rng, 900, centres=30))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "entry long, vector array<double>")
    ix = ne.index(e, clusters=60)
    q = vs[::45]
    bound = ne.bounds(q, ix)
    for r in ix.entries.collect():
        assert (q @ np.array(r["__v"]) <= bound[:, r["__cluster"]] + 1e-9).all()
    report = ne.pruning(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query long, vector array<double>"), ix)
    shares = sorted(r["share"] for r in report.collect())
    assert shares[len(shares) // 2] < 0.5  # clustered entries: most are never compared
    assert all(r["compared"] >= 5 for r in report.collect())
