"""Isotonic fits, Q-Q points, held-out predictions, differences of responses, and the versioned store."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import isotonic as iso
from equilens.operators import meta
from equilens.operators import nearest as ne
from equilens.operators import ordered as od
from equilens.operators import predict as pr
from equilens.operators import report as rp
from equilens.operators import responses as rs
from equilens.operators import store as st


def minimax(points):
    """Fit at each distinct x: the greatest over begins of the least mean over ends."""
    xs = sorted({x for x, _ in points})
    rows = [[y for x, y in points if x == v] for v in xs]
    mean = lambda a, b: np.mean([y for r in rows[a : b + 1] for y in r])
    return {v: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, v in enumerate(xs)}


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_isotonic_equals_minimax(spark, monkeypatch, chunk):
    monkeypatch.setattr(iso, "CHUNK", chunk)
    rng = random.Random(chunk)
    points = [(g, round(rng.random(), 2), None) for g in ("a", "b", None) for _ in range(70)]
    points = [(g, x, int(rng.random() < (x if g == "a" else 1 - x))) for g, x, _ in points]  # b falls: one pool
    rows = [*points, ("a", None, 1), ("a", 0.5, None)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    fit = iso.pools(df, "p", "y", ["g"])
    found = fit.collect()
    told = {(r["g"], r["p"]): r["v"] for r in iso.calibrated(df, fit, "p", ["g"], "v").collect()}
    for g in ("a", "b", None):
        want = minimax([(x, y) for k, x, y in points if k == g])
        assert all(told[g, x] == pytest.approx(v) for x, v in want.items())
        own = sorted((r["low"], r["high"], r["n"], r["value"]) for r in found if r["g"] == g)
        assert sum(r[2] for r in own) == 70 and all(a[1] < b[0] and a[3] < b[3] for a, b in zip(own, own[1:]))
    assert told["a", None] is None
    assert iso.pools(df.limit(0), "p", "y").count() == 0


def test_calibrated_between_and_outside_pools(spark, monkeypatch):
    monkeypatch.setattr(od, "BLOCK_ROWS", 2)
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 1)], "p double, y int")
    fit = iso.pools(df, "p", "y")
    asked = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.9)], "p double")
    got = {r["p"]: r["calibrated"] for r in iso.calibrated(asked, fit, "p").collect()}
    assert got == pytest.approx({0.0: 0, 0.2: 0, 0.25: 0.25, 0.3: 0.5, 0.35: 0.75, 0.4: 1, 0.5: 1, 0.6: 1, 0.9: 1})


def test_qq_points(spark, monkeypatch):
    monkeypatch.setattr(od, "BLOCK_ROWS", 9)
    rng = random.Random(1)
    xs = [round(rng.gauss(3, 2), 2) for _ in range(40)] + [1.0] * 5
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = sorted((r["i"], r["theoretical"], r["value"]) for r in rp.qq(df, "x").collect())
    n, nd = len(xs), NormalDist()
    p = [1 - 0.5 ** (1 / n), *((i - 0.3175) / (n + 0.365) for i in range(2, n)), 0.5 ** (1 / n)]
    assert [g[2] for g in got] == sorted(xs) and [g[0] for g in got] == list(range(1, n + 1))
    assert [g[1] for g in got] == pytest.approx([nd.inv_cdf(x) for x in p])
    fit = rp.qq_fit(rp.qq(df, "x")).first()
    slope, intercept = np.polyfit([g[1] for g in got], [g[2] for g in got], 1)
    assert (fit["n"], fit["slope"], fit["intercept"]) == pytest.approx((n, slope, intercept))


def test_numbers_of_values_in_order(spark):
    words = sorted({f"w{k % 37:02d}" for k in range(100)})
    got = {r["w"]: r["i"] for r in od.numbered(spark.createDataFrame([(w,) for w in words], "w string").repartition(6), "w", "i").collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_held_out_rows_are_not_seen(spark):
    rng = random.Random(4)
    rows = [(k, "ab"[k % 2], x := rng.random(), 0.2 * x + 0.05 * (k % 2) + rng.gauss(0, 0.01)) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, g string, x double, y double")
    got = pr.held_out(df, ["k"], ["g"], ["x"], "y", {"linear": {"kind": "linear"}, "forest": {"kind": "forest", "numTrees": 5}}, folds=3).collect()
    assert len(got) == 180
    own = {r["k"]: r for r in got if r["kind"] == "linear"}
    assert {r["k"]: r["fold"] for r in got if r["kind"] == "forest"} == {k: r["fold"] for k, r in own.items()}
    for fold in range(3):
        design = lambda some: np.array([[1, x, k % 2] for k, _, x, _ in some])
        seen, unseen = [r for r in rows if own[r[0]]["fold"] != fold], [r for r in rows if own[r[0]]["fold"] == fold]
        beta = np.linalg.lstsq(design(seen), np.array([r[3] for r in seen]), rcond=None)[0]
        assert [own[r[0]]["prediction"] for r in unseen] == pytest.approx(list(design(unseen) @ beta), abs=1e-6)
    errors = {r["kind"]: r for r in pr.fold_errors(spark.createDataFrame(got, "k int, g string, x double, y double, kind string, fold int, prediction double"), "y").collect()}
    e = np.array([own[k]["prediction"] - y for k, _, _, y in rows])
    y = np.array([r[3] for r in rows])
    assert (errors["linear"]["rmse"], errors["linear"]["mae"], errors["linear"]["r2"]) == pytest.approx((np.sqrt((e * e).mean()), np.abs(e).mean(), 1 - (e * e).sum() / ((y - y.mean()) ** 2).sum()))
    assert [k for k, r in errors.items() if r["best"]] == ["linear"]


def test_profiles_go_by_the_row_s_own_sample_size(spark):
    rows = [(k, "ab"[k % 2], n, 0.01 * (k % 30)) for k, n in enumerate([20, 99, 100, 500] * 15)]
    df = spark.createDataFrame(rows, "k int, g string, n int, y double")
    predicted = pr.held_out(df, ["k"], ["g"], ["n"], "y", {"linear": {"kind": "linear"}}, folds=2)
    got = pr.risk_profiles(predicted, pr.fold_errors(predicted, "y"), "n", {"n": 0.9}, "gpt").collect()
    assert len(got) == 60
    for r in got:
        assert ("small sample" in r["factors"]) == (r["n"] < 100) == ("collect at least 100 rows" in r["mitigations"])
        assert r["low"] < r["prediction"] < r["high"] and 0 <= r["power"] <= 1 and r["required_n"] >= 50 and "model family gpt" in r["factors"]


def test_contrasts_and_leave_one_out_in_blocks(spark, monkeypatch):
    effects = {f"c{k:02d}": (k * 37 % 50) / 100 for k in range(40)}
    df = spark.createDataFrame(list(effects.items()), "c string, e double")
    want = {(a, b) for a in effects for b in effects if a < b and abs(effects[a] - effects[b]) > 0.2}
    studies = spark.createDataFrame([(f"s{k}", 0.1 * (k % 7), 0.05 + 0.01 * (k % 5)) for k in range(20)], "study string, effect double, se double")
    whole = {r["study"]: r["estimate"] for r in meta.leave_one_out(studies, "study").collect()}
    blocks = od.blocks
    for size in (4096, 7):
        monkeypatch.setattr(od, "blocks", lambda n, _, size=size: blocks(n, size))
        assert {(r["a"], r["b"]) for r in pr.contrasts(df, "c", "e", 0.2).collect()} == want
        assert {r["study"]: r["estimate"] for r in meta.leave_one_out(studies, "study").collect()} == pytest.approx(whole)


def test_differences_of_responses(spark):
    case = ["buy 30 units now"] * 3 + ["Buy 30 units, now!", "now buy 30 units", "buy 40 units now", "buy 30 units", "buy 30 units now please", "sell 30 units now", "Error: timeout"]
    rows = [(1, r) for r in case] + [(2, "same")] * 4 + [(3, None), (4, "b"), (4, "a")]
    df = spark.createDataFrame(rows, "case int, r string")
    kinds = {r["r"]: (r["difference"], r["added"], r["dropped"]) for r in rs.differences(df, "case", "r").where("case = 1").collect()}
    assert kinds["buy 30 units now"] == (None, 0, 0) and kinds["sell 30 units now"] == ("wording", 1, 1) and kinds["buy 40 units now"] == ("numbers", 1, 1)
    assert [kinds[x][0] for x in case[3:5]] == ["spelling", "order"] and kinds["buy 30 units"][0] == "shortened" and kinds["buy 30 units now please"][0] == "extended" and kinds["Error: timeout"][0] == "error"
    got = {r["case"]: r for r in rs.instability(df, "case", "r").collect()}
    assert got[1]["sources"] == ["non_deterministic_sampling", "api_errors", "variable_response_length"] and got[1]["modal_share"] == 0.3 and got[1]["n_wording"] == 1
    assert got[2]["sources"] == [] and got[2]["distinct"] == 1 and 3 not in got and got[4]["sources"] == ["non_deterministic_sampling"]


def test_readers_see_one_version(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = lambda n, text: spark.createDataFrame([(f"k{i}", text, [float(i), 1.0], i) for i in range(n)], "key string, payload string, vector array<double>, n int")
    assert st.newest(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        st.current(spark, folder)
    assert st.publish(rows(6, "old"), folder) == 1
    reader = st.current(spark, folder)
    rows(9, "half written").write.parquet(f"{folder}/v-interrupted")  # a replacement that ended before it was pointed to
    assert st.current(spark, folder).count() == 6
    assert st.replace(rows(2, "new").withColumn("payload", F.when(F.col("n") > 0, F.col("payload"))), folder) == 2
    assert {r["payload"] for r in reader.collect()} == {"old"} and reader.count() == 6  # begun before, and still whole
    now = {r["key"]: r["payload"] for r in st.current(spark, folder).collect()}
    assert now == {"k0": None, "k1": "new", **{f"k{i}": "old" for i in range(2, 6)}}
    assert [(r["version"], r["entries"]) for r in st.versions(spark, folder).orderBy("version").collect()] == [(1, 6), (2, 6)]
    ix = st.rebuilt_index(spark, folder)
    found = ne.top_k(spark.createDataFrame([(1, [1.0, 0.0])], "query int, vector array<double>"), ix, 9).collect()
    assert [(r["key"], r["payload"]) for r in found] == [("k5", "old"), ("k4", "old"), ("k3", "old"), ("k2", "old"), ("k1", "new")]
