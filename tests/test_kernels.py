import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.functions import dist
from equilens.functions import rubric as ru
from equilens.operators import cache as ca
from equilens.operators import fairness as fa
from equilens.operators import generate as ge
from equilens.operators import inference as inf
from equilens.operators import meta as me
from equilens.operators import predict as pr
from equilens.operators import report as rp
from equilens.operators import responses as rs
from equilens.operators import temporal as te
from equilens.operators import uncertainty as un


def test_distributions_against_tables():
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(4.0, 4) == pytest.approx(math.exp(-2) * 3, abs=1e-12)
    assert dist.norm_p2(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_p2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(2.228139**2, 1, 10) == pytest.approx(dist.t_p2(2.228139, 10), abs=1e-10)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert dist.beta_ppf(0.5, 2, 2) == pytest.approx(0.5, abs=1e-9)
    assert dist.beta_i(1, 1, 0.3) == pytest.approx(0.3)
    assert math.isnan(dist.t_ppf(0.9, 0)) and math.isnan(dist.chi2_sf(-1, 2))
    assert 0.8 < dist.power_two_sample(0.5, 90) < 1


def test_arrow_p_values(spark):
    df = spark.createDataFrame([(3.841459, 1), (None, 1)], "x double, k int")
    got = [r["p_value"] for r in inf.with_p(df, "chi2", "x", "k").collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] is None
    assert inf.with_p(df.limit(0), "chi2", "x", "k").count() == 0


def test_rubric_cells(spark):
    cases = [(10, 2, "Cash"), (20, 3, "Capital Stable"), (23, 5, "Balanced"), (29, 7, "Growth"), (40, 10, "High Growth"), (-1, -1, None), (8, 11, None)]
    df = spark.createDataFrame(cases, "toi int, th int, want string").withColumn("got", ru.label_of(ru.label_ord(F.col("toi"), F.col("th"))))
    assert all(r["got"] == r["want"] for r in df.collect())
    grid = spark.range(8, 41).select(F.col("id").cast("int").alias("toi"), F.explode(F.sequence(F.lit(2), F.lit(10))).alias("th")).withColumn("o", ru.label_ord(F.col("toi"), F.col("th")))
    rows = grid.collect()
    assert len(rows) == 297
    for r in rows:
        assert r["o"] == sum(r["toi"] > ru.cut(r["th"], k) for k in range(5))


def test_ordinal_error_and_truth(spark):
    cases = [("Cash", "Cash", 0), ("Capital Stable", "Cash", 1), ("Balanced", "Cash", 2), ("Cash", "Capital Stable", -1), ("Cash", "High Growth", -5), ("High Growth", "Cash", 5), ("Nope", "Cash", None)]
    df = spark.createDataFrame(cases, "p string, t string, want int")
    assert all(r["e"] == r["want"] for r in df.withColumn("e", ru.ordinal_error(F.col("p"), F.col("t"))).collect())
    v = spark.createDataFrame([(23, 5, "Balanced", 52, 48), (23, 5, "Growth", 70, 30), (23, 5, "Balanced", 90, 10), (-1, -1, "Cash", None, None)], "toi int, th int, label string, g int, i int")
    got = ru.validate_truth(ru.ground_truth(v), "label", "g", "i").collect()
    assert got[0]["label_correct"] and got[0]["calibration_error"] == 0 and not got[1]["label_correct"] and got[2]["deviation"] > 0
    assert got[3]["expected_label"] == "UNMAPPED" and got[3]["mapping_error"]


def test_corrections_by_hand(spark):
    p = [("a", 0.001), ("b", 0.01), ("c", 0.04), ("d", 0.06), ("e", 0.15), ("f", 0.003), ("g", None)]
    got = {r["name"]: r for r in inf.adjust(spark.createDataFrame(p, "name string, p double"), "p", "name").collect()}
    want = {"a": (0.006, 0.006, 0.006), "f": (0.018, 0.015, 0.009), "b": (0.06, 0.04, 0.02), "c": (0.24, 0.12, 0.06), "d": (0.36, 0.12, 0.072), "e": (0.9, 0.15, 0.15)}
    for k, (bonf, holm, bh) in want.items():
        assert (got[k]["p_bonferroni"], got[k]["p_holm"], got[k]["p_bh"]) == pytest.approx((bonf, holm, bh))
        assert got[k]["p_holm"] >= got[k]["p"] and got[k]["p_bh"] <= got[k]["p_holm"]
    assert got["g"]["p_holm"] is None and got["g"]["reject_holm"] is False


def test_chi_square_edges(spark):
    rows = [("x", "a")] * 10 + [("x", "b")] * 20 + [("y", "a")] * 30 + [(None, "a")] * 5
    df = spark.createDataFrame(rows, "r string, c string")
    r = inf.chi_square(df, "r", "c").first()
    o = np.array([[10, 20], [30, 0]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert r["chi2"] == pytest.approx((((abs(o - e) - 0.5) ** 2) / e).sum()) and r["n"] == 60 and r["n_cells"] == 3
    assert inf.chi_square(df, "r", "c", yates=False).first()["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())
    assert inf.chi_square(df.where("r = 'x'"), "r", "c").first()["chi2"] is None
    assert inf.chi_square(df.limit(0), "r", "c").first()["chi2"] is None


def test_kruskal_equal_values_and_anova(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None)], "g string, v int")
    assert inf.kruskal(df, "g", "v").first()["h"] == 0
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)], "g string, v int")
    assert inf.kruskal(df, "g", "v").first()["h"] == pytest.approx(3.857142857)
    assert inf.anova(df, "g", "v").first()["f"] == pytest.approx(13.5)


def test_kappa_and_agreement(spark):
    rows = [(k, m, lab) for k, labs in enumerate([("a", "a"), ("b", "b"), ("a", "b"), ("b", "b")]) for m, lab in zip(("m1", "m2"), labs)]
    r = fa.agreement(spark.createDataFrame(rows, "k int, model string, pred_label string"), ["k"]).first()
    assert r["n"] == 4 and r["agreement"] == 0.75 and r["kappa"] == pytest.approx(0.5)
    same = spark.createDataFrame([(1, "m1", "a"), (1, "m2", "a")], "k int, model string, pred_label string")
    assert fa.agreement(same, ["k"]).first()["kappa"] is None


def test_cusum_identity(spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) + (i > 60) for i in range(100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "t int, v double")
    r = te.drift(df, "t", "v").first()
    base = xs[:33]
    m, sd = np.mean(base), np.std(base)
    up = down = ph = 0.0
    tops, firsts = [0.0] * 3, [None] * 3
    for i, x in enumerate(xs):
        if i:
            up, down, ph = max(0, up + x - m - 1.5 * sd), max(0, down - (x - m) - 1.5 * sd), max(0, ph + x - m - sd)
        for k, (s, lim) in enumerate(((up, 3 * sd), (down, 3 * sd), (ph, 10))):
            tops[k] = max(tops[k], s)
            if s > lim and firsts[k] is None:
                firsts[k] = i
    assert (r["cusum_up"], r["cusum_down"], r["ph_max"]) == pytest.approx(tuple(tops))
    assert [r["first_up"], r["first_down"], r["first_ph"]] == firsts
    assert te.drift(df.withColumn("v", F.lit(1.0)), "t", "v").count() == 0


def test_stratified_counts(spark):
    for n in (1, 6, 12, 30, 61):
        rows = ge.stratified_subjects(spark, n).collect()
        got = {x: sum(r["true_label"] == x for r in rows) for x in ru.LABELS}
        assert got == {x: n // 6 + (i < n % 6) for i, x in enumerate(ru.LABELS)}
        assert sorted(r["subject_id"] for r in rows) == list(range(1, n + 1))
        for r in rows:
            assert r["toi"] == sum(r["answers"][k] for k in ge.TOI_ITEMS) and r["th"] == sum(r["answers"][k] for k in ge.TH_ITEMS)
            assert all(1 <= v <= 5 for v in r["answers"].values()) and len(r["answers"]) == 10


def test_probes_and_batches(spark):
    assert ge.boundary_probes(spark).count() == 604
    b = ge.batches(spark.range(25).toDF("i"), ["i"], 10).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [(r["batch_id"], r["count"]) for r in b] == [("batch_0001", 10), ("batch_0002", 10), ("batch_0003", 5)]


def test_refusals(spark):
    rows = ["I cannot provide that", "This could be HARMFUL", "a neutral recommendation", None, "", "I shouldn't judge based on gender"]
    got = rs.refusal(spark.createDataFrame([(x,) for x in rows], "t string"), "t").collect()
    assert [r["refusal_type"] for r in got] == ["policy", "safety", None, None, None, "policy"]
    assert got[5]["demographic_sensitivity"] and not got[0]["demographic_sensitivity"]


def test_bootstrap_and_hierarchy(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.random()) for i in range(400)], "k int, v double")
    r = un.bootstrap_means(df, "v", "k", replicates=100).first()
    half = 1.96 * df.agg(F.stddev_samp("v")).first()[0] / 20
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] == pytest.approx(2 * half, rel=0.35)
    s = spark.createDataFrame([(0.2, 0.05), (0.25, 0.05), (0.3, 0.05), (0.22, 0.05)], "effect double, se double")
    h = me.hierarchical(s).first()
    assert h["mean_mu"] == pytest.approx(0.2425, abs=0.01) and h["p_positive"] > 0.99
    b = un.beta_posterior(spark.createDataFrame([(1,)] * 8 + [(0,)] * 2, "y int"), "y").first()
    assert b["mean"] == pytest.approx(9 / 12) and b["low"] < 0.75 < b["high"]
    iso = un.isotonic(spark.createDataFrame([(0.1, 0), (0.2, 0), (0.6, 1), (0.9, 1)], "p double, y int"), "p", "y")
    assert list(iso.boundaries) == sorted(iso.boundaries)


def test_prediction_models(spark):
    rng = random.Random(2)
    rows = [(f"m{i % 3}", float(i), 0.1 * (i % 3) + 0.001 * i + rng.random() * 0.01) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, n double, bias double")
    scores, models = pr.compare_models(df, ["model"], ["n"], "bias")
    assert scores["linear"]["r2"] > 0.9
    out = pr.intervals(models["forest"], df).collect()
    trees = models["forest"].stages[-1]
    assert all(r["low"] - 1e-9 <= r["prediction"] <= r["high"] + 0.2 for r in out)
    mean = [sum(t.predict(r["features"]) for t in trees.trees) / len(trees.trees) for r in out[:5]]
    assert mean == pytest.approx([r["prediction"] for r in out[:5]])
    with pytest.raises(ValueError):
        pr.compare_models(df.limit(5), ["model"], ["n"], "bias")
    best, rmse = pr.tune_forest(df, ["model"], ["n"], "bias", trees=(3,), depths=(2, 3), folds=2)
    assert rmse > 0 and best.stages


def test_tree_arrays_follow_the_trees(spark):
    df = spark.createDataFrame([(f"m{i % 3}", float(i), float(i % 3)) for i in range(60)], "model string, n double, bias double")
    m = pr.pipeline(["model"], ["n"], "bias", "forest", numTrees=4).fit(df)
    rows = m.transform(df).collect()
    for t in m.stages[-1].trees:
        f, cut, left, right, value = pr._as_arrays(t)
        for r in rows[:20]:
            node = 0
            while f[node] >= 0:
                node = left[node] if r["features"][int(f[node])] <= cut[node] else right[node]
            assert value[node] == pytest.approx(t.predict(r["features"]))


def test_cache_tables(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, timestamp int, response string")
    assert {(r["key"], r["response"]) for r in ca.latest(e).collect()} == {("a", "y"), ("b", "z")}
    new = spark.createDataFrame([("b", 3, "n"), ("c", 1, "c")], e.schema)
    assert {(r["key"], r["response"]) for r in ca.upsert(ca.latest(e), new).collect()} == {("a", "y"), ("b", "n"), ("c", "c")}
    req = spark.createDataFrame([("a",), ("q",)], "key string")
    assert {(r["key"], r["hit"]) for r in ca.probe(req, ca.latest(e)).collect()} == {("a", True), ("q", False)}
    got = ca.layered(req, {"one": ca.latest(e), "two": new}).collect()
    assert {(r["key"], r["hit_kind"], r["response"]) for r in got} == {("a", "one", "y"), ("q", "miss", None)}


def test_report_helpers(spark):
    df = spark.createDataFrame([("m", 1.0, 0.5, "f")], "model string, bias_score double, other double, gender string")
    assert rp.metric_columns(df) == ["bias_score"] and rp.demographic_columns(df) == ["gender"]
    assert rp.metric_columns(df.select("other")) == ["other"]
    assert len(rp.recommendations(df, 50, ["a"] * 4, ["d"] * 3, 3, True)) == 5
    with pytest.raises(ValueError):
        rp.Chart(df).layer("pie")
    assert rp.mean_ci(spark.createDataFrame([(float(i),) for i in range(10)], "v double"), "v").first()["high"] == pytest.approx(4.5 + 2.262157 * 3.02765 / math.sqrt(10), abs=1e-4)
    assert rp.summary(spark.createDataFrame([], "s int, m string, ok boolean, c int, t double, x double"), "s", "m", "ok", "c", "t", "x").first()["accuracy"] == 0


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "model string, condition string, name_group string, city string, acc int, pred_label string, true_label string, ordinal_error int, proposed_growth double, true_growth double, subject_id int, run_idx int")
    for out in (fa.accuracy_by(empty, ["model"]), fa.condition_z(empty, ["model"]), fa.paired_mcnemar(empty, ["model"], ["subject_id", "run_idx"]), fa.demographic_parity(empty, "name_group", ["model"]), fa.one_vs_rest(empty, "name_group", list(ru.LABELS)), fa.calibration(empty, ["model"]), fa.ordinal_bias(empty, "name_group"), fa.verdict(empty, "name_group", 0.1, 0.2, ["model"]), fa.model_verdicts(empty), fa.profile(empty, "name_group")):
        assert out.count() == 0


def test_narrative(spark):
    from equilens.operators import narrative as na

    spans = spark.createDataFrame([("demographic", 0.2), ("location", 0.01), ("accuracy", 0.5)], "kind string, range double")
    got = {r["kind"]: r["action"] for r in na.interventions(spans).collect()}
    assert got["location"] == "none" and got["demographic"] != "none" and got["accuracy"] != "none"
    assert na.factors({"a": 0.5, "b": 0.05}, 50, "gpt") == ["a (0.50)", "model family gpt", "small sample"]
    assert "collect at least 100 rows" in na.mitigations("low", 10)
    text = na.report("T", {"S": spans, "W": "words"})
    assert text.startswith("# T") and "| demographic | 0.2 |" in text
    s = spark.createDataFrame([(0.2, 0.05), (0.25, 0.06), (0.1, 0.05)], "effect double, se double")
    assert "Heterogeneity" in na.meta_report(s) and "tabular" in na.latex_table(spans)
    demo = na.demo_rows(spark, 50)
    assert demo.count() == 50 and demo.where("bias_score between 0 and 0.3 and accuracy between 0.6 and 1").count() == 50
