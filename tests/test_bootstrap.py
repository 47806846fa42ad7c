"""Bootstrap intervals equal a replay in numpy of the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import bootstrap as bo

B, SEED = 60, 5


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(2)
    rows = []
    for k in range(700):
        g = rng.choice(["a", "b", "null", None])
        p = round(rng.random(), 3)
        rows.append((k, g, rng.choice(["m", "n"]), p if k % 40 else None, int(rng.random() < p), int(rng.random() < 0.4), float(k % 7)))
    df = spark.createDataFrame(rows, "k long, g string, m string, p double, y int, said int, x double").repartition(5).withColumn("h", F.xxhash64("k"))
    return df.cache(), df.collect()


def replay(rows, metric):
    """Values of the replicates of rows by weights drawn in one go."""
    w = bo.weights(np.array([r["h"] for r in rows], np.int64), 0, B + 1, SEED).astype(float)
    return np.array([metric(rows, w[b]) for b in range(B + 1)])


def rates(rows, w, hit, base):
    out = []
    for g in ("a", "b", "null"):
        own = np.array([r["g"] == g for r in rows])
        below = (w * own * np.array([base(r) for r in rows])).sum()
        if below:
            out.append((w * own * np.array([hit(r) * base(r) for r in rows])).sum() / below)
    return max(out) - min(out)


def ece(rows, w):
    total, n = 0.0, 0.0
    for b in range(10):
        own = np.array([r["p"] is not None and b / 10 < r["p"] <= (b + 1) / 10 for r in rows])
        gap = (w * own * np.array([(r["p"] or 0) - r["y"] for r in rows])).sum()
        total, n = total + abs(gap), n + (w * own).sum()
    return total / n


CASES = {
    "mean": (lambda: bo.mean("x"), lambda rows, w: (w * [r["x"] for r in rows]).sum() / w.sum()),
    "ratio": (lambda: bo.ratio("y", "x"), lambda rows, w: (w * [r["y"] for r in rows]).sum() / (w * [r["x"] for r in rows]).sum()),
    "range": (lambda: bo.rate_range("g", "y"), lambda rows, w: rates(rows, w, lambda r: r["y"], lambda r: 1)),
    "ece": (lambda: bo.calibration_error("p", "y"), ece),
    "tpr": (lambda: bo.odds_gap("g", F.col("said") == 1, F.col("y") == 1), lambda rows, w: rates(rows, w, lambda r: r["said"], lambda r: r["y"])),
    "odds": (
        lambda: bo.odds_gap("g", F.col("said") == 1, F.col("y") == 1, "odds"),
        lambda rows, w: max(rates(rows, w, lambda r: r["said"], lambda r: r["y"]), rates(rows, w, lambda r: r["said"], lambda r: 1 - r["y"])),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_a_replay(sample, name):
    df, rows = sample
    metric, plain = CASES[name]
    want = replay(rows, plain)
    got = bo.bootstrap(df, metric(), "k", replicates=B, seed=SEED).first()
    low, high = np.quantile(want[1:], [0.025, 0.975])
    assert (got["value"], got["low"], got["high"], got["n_replicates"]) == pytest.approx((want[0], low, high, B))


def test_by_groups_and_few_cells_in_memory(sample, monkeypatch):
    df, rows = sample
    whole = {r["m"]: r for r in bo.bootstrap(df, bo.rate_range("g", "y"), "k", ["m"], replicates=B, seed=SEED).collect()}
    monkeypatch.setattr(bo, "MOST_CELLS", 2)
    parts = {r["m"]: r for r in bo.bootstrap(df, bo.rate_range("g", "y"), "k", ["m"], replicates=B, seed=SEED).collect()}
    for m in ("m", "n"):
        want = replay([r for r in rows if r["m"] == m], CASES["range"][1])
        for r in (whole[m], parts[m]):
            assert (r["value"], r["low"]) == pytest.approx((want[0], np.quantile(want[1:], 0.025)))
    assert bo.bootstrap(df.limit(0), bo.mean("x"), "k", ["m"]).count() == 0


def test_weights_are_poisson():
    w = bo.weights(np.arange(4000, dtype=np.int64) * 7919, 1, 51, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06


def test_audit_intervals_equal_a_replay(spark):
    from equilens.plans.audit import audit
    from equilens.plans.uncertainty import intervals

    a = audit(spark, "/root/testdata/sf0.001").withColumn("h", F.xxhash64("subject_id", "run_idx", "condition"))
    rows = [r for r in a.select("h", "model", "name_group", "pred_label", "true_label", "acc", "confidence").collect() if r["model"] == "1-URGENT"]
    w = bo.weights(np.array([r["h"] for r in rows], np.int64), 0, 51, 42).astype(float)
    groups = sorted({r["name_group"] for r in rows if r["name_group"]})
    known = np.array([r["acc"] is not None for r in rows])
    acc = np.array([r["acc"] or 0 for r in rows])
    said, true = (np.array([r[c] == "High Growth" for r in rows]) for c in ("pred_label", "true_label"))

    def gap(hit, base):
        per = [((w * (own := np.array([r["name_group"] == g for r in rows]) & base & known)) @ hit) / (w @ own.astype(float)) for g in groups]
        return np.nanmax(per, 0) - np.nanmin(per, 0)

    p = np.array([r["confidence"] for r in rows])
    bins = [known & (b / 10 < p) & (p <= (b + 1) / 10) for b in range(10)]
    want = {
        "accuracy": (w @ acc) / (w @ known), "accuracy_range": gap(acc, known), "tpr_gap": gap(said, true), "odds_gap": np.maximum(gap(said, true), gap(said, ~true)),
        "calibration_error": sum(np.abs((w * b) @ (p - acc)) for b in bins) / sum(w @ b for b in bins),
    }
    got = {r["metric"]: r for r in intervals(a, 50).where("model = '1-URGENT'").collect()}
    for name, values in want.items():
        assert (got[name]["value"], got[name]["low"], got[name]["high"]) == pytest.approx((values[0], *np.quantile(values[1:], [0.025, 0.975])))
