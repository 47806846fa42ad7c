"""Run folders, summaries, projections and caches against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from equilens.operators import cache as ca
from equilens.operators import classify as cl
from equilens.operators import narrative as na
from equilens.operators import predict as pr
from equilens.operators import responses as rs
from equilens.operators import runs
from equilens.operators import uncertainty as un
from equilens.streaming import monitor as mo


def test_a_run_from_its_folder(spark, tmp_path):
    rng = random.Random(1)
    lines = ["model,subject_id,gender,risk_label,risk_band_correct,confidence,error"]
    rows = [(f"m{k % 2}", k % 7, rng.choice(["F", "M"]), rng.choice(["Cash", "Growth"]), rng.randrange(2), round(rng.random(), 3), "late" if k % 10 == 0 else "") for k in range(60)]
    (tmp_path / "results.csv").write_text("\n".join([*lines, *(",".join(map(str, r)) for r in rows)]))
    (tmp_path / "experiment_report.json").write_text(json.dumps({"experiment_name": "first", "total_cost": 1.5, "duration_hours": 2.0}))
    (tmp_path / "stats_summary.json").write_text(json.dumps({"consistency_score": 0.75}))
    data = runs.load_run(spark, str(tmp_path))
    assert data["results"].count() == 60 and data["metadata"] is None and data["config"] is None
    s, text = runs.analyse_run(spark, str(tmp_path))
    assert len(s) == 24 and s["models_tested"] == ["m0", "m1"] and s["total_subjects"] == 7 and s["total_responses"] == 60
    assert s["success_rate"] == pytest.approx(0.9) and s["overall_accuracy"] == pytest.approx(sum(r[4] for r in rows) / 60)
    assert (s["experiment_name"], s["total_cost"], s["consistency_score"]) == ("first", 1.5, 0.75)
    share = lambda g, x: sum(r[2] == g and r[3] == x for r in rows) / sum(r[2] == g for r in rows)
    assert s["demographic_parity_violation"] == pytest.approx(max(abs(share("F", x) - share("M", x)) for x in ("Cash", "Growth")))
    acc = lambda g: sum(r[4] for r in rows if r[2] == g) / sum(r[2] == g for r in rows)
    assert s["equalized_odds_violation"] == pytest.approx(abs(acc("F") - acc("M"))) and 0 < s["chi_square_p_value"] <= 1
    assert s["accuracy_ci_lower"] < s["overall_accuracy"] < s["accuracy_ci_upper"] and s["bias_ci_upper"] == pytest.approx(s["demographic_parity_violation"] + 0.1)
    assert "Accuracy by model" in text and "first" in text
    (tmp_path / "empty").mkdir()
    assert runs.run_summary(runs.load_run(spark, str(tmp_path / "empty"))["results"])["chi_square_p_value"] == 1.0
    out, advice = runs.suite_summary(data["results"], ["confidence"], [])
    assert out["rows"] == 60 and "collect at least 100 rows" in advice
    for columns, many in ((["gender"], 2), (["gender", "risk_label"], 4)):
        assert runs.landscape(data["results"], "confidence", columns).count() == many
    assert runs.landscape(data["results"], "confidence", ["gender", "risk_label", "subject_id"], only=("model", ["m0"])).count() == 30


def test_costs_and_classes(spark):
    df = spark.createDataFrame([(k, "gpt-4o-mini" if k % 2 else "x", 1000) for k in range(6)], "i int, model string, t long")
    cost = cl.call_cost(F.col("model"), F.col("t"), F.col("t"), {"gpt-4o-mini": (0.1, 0.2)})
    got = cl.budget_guard(df.withColumn("cost", cost), "cost", "i", most_call=0.1, most_total=0.5).orderBy("i").collect()
    assert [r["running"] for r in got] == pytest.approx([0.02, 0.32, 0.34, 0.64, 0.66, 0.96]) and [r["over_total"] for r in got] == [False] * 3 + [True] * 3
    r = df.select(cl.model_family(F.col("model")).alias("f"), cl.vendor(F.col("model")).alias("v"), cl.model_size(F.col("model")).alias("s")).distinct().collect()
    assert {tuple(x) for x in r} == {("gpt", "openai", "mini"), ("other", "unknown", "unknown")}
    with pytest.raises(ValueError):
        cl.zipped(df, df.limit(2), "i", "i")


def test_individual_fairness_distances(spark):
    rng = random.Random(2)
    rows = [(k, [rng.random() for _ in range(3)], rng.random(), "ab"[k % 2]) for k in range(25)]
    df = spark.createDataFrame(rows, "k int, v array<double>, p double, g string")
    dist = {
        "euclidean": lambda a, b: math.dist(a, b), "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)),
        "cosine": lambda a, b: max(0.0, 1 - sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)),
    }
    for name, d in dist.items():
        got = {r["k"]: r for r in un.individual_fairness(df, "k", "v", "p", "g", name, block=8).collect()}
        for k, v, p, g in rows:
            far = [(d(v, w), abs(p - q), g == h) for _, w, q, h in rows]
            weight = [(1 / (x + 1e-8), y) for x, y, same in far if same]
            assert got[k]["disparity"] == pytest.approx(sum(w * y for w, y in weight) / sum(w for w, _ in weight), abs=1e-5)
            if name != "cosine":
                assert got[k]["lipschitz"] == pytest.approx(max(y / x for x, y, _ in far if x > 0))


def test_top_k_in_cells_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(90)] + [(90, None), (91, [0.0] * 4)]
    e = spark.createDataFrame(rows, "entry int, vector array<double>")
    q = e.where("entry % 9 = 0 and vector is not null").withColumnRenamed("entry", "query")
    got = {(r["query"], r["rank"]): r["entry"] for r in ca.top_k(q, e, 3, clusters=5).collect()}
    for k, v in rows[::9]:
        if v:
            best = sorted((-round(sum(a * b for a, b in zip(v, w)), 12), j) for j, w in rows if w)[:3]
            assert [got[k, i + 1] for i in range(3)] == [j for _, j in best]
    assert ca.top_k(q, e.limit(0), 3).count() == 0


def test_cache_layers(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "query int, key string")
    local = spark.createDataFrame([("a", "A", 1)], "key string, response string, timestamp int")
    remote = spark.createDataFrame([("b", "B", 2), ("z", None, 3)], "key string, response string, timestamp int")
    near = spark.createDataFrame([(3, "C")], "query int, response string")
    got = {r["query"]: (r["hit_kind"], r["response"]) for r in ca.layered(req, {"local": local, "shared": remote}, similar=near).collect()}
    assert got == {1: ("local", "A"), 2: ("shared", "B"), 3: ("semantic", "C"), 4: ("miss", None)}
    assert ca.stored_locally(local, remote.where("key = 'b'")).count() == 2
    assert [tuple(r) for r in ca.rebuilt(remote).collect()] == [("b", "B", 2, 1)]


def test_ablation_and_forecast_text(spark):
    prompts = spark.createDataFrame([(1, 23, 5), (2, 23, 5), (3, 23, 5)], "id int, toi int, th int")
    answers = spark.createDataFrame([(1, "Balanced", 52, 48, "fine", None), (2, "Growth", 82, 18, "I cannot provide advice", None)], "id int, risk_label string, growth_pct int, income_pct int, text string, error string")
    got = {r["id"]: r for r in rs.ablation(prompts, answers, "id").collect()}
    assert [got[k]["ok"] for k in (1, 2, 3)] == [True, True, False] and got[1]["label_correct"] and got[2]["is_refusal"]
    text = na.forecast_report({"forest": {"r2": 0.5}}, {"forest": {"age": 0.7, "city": 0.2}})
    assert "r2: 0.500" in text and "feature age: 0.700" in text and "No trained" in na.forecast_report({}, {})
    assert "first 2 rows" in na.latex_table(prompts, 2) and "first" not in na.latex_table(prompts, 3)


def test_search(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(x := rng.random(), x * 0.3 + rng.random() * 0.01) for _ in range(60)], "x double, y double")
    model, settings, rmse = pr.search_forest(df, [], ["x"], "y", draws=2, trees=(3, 5), depths=(2, 4))
    assert rmse < 0.1 and 3 <= settings["numTrees"] <= 5


def test_upsert_keeps_the_newest_row(spark, tmp_path):
    write = mo.upsert_into(str(tmp_path), ["k"])
    rows = lambda *x: spark.createDataFrame(list(x), "k int, ts int, v string")
    write(rows((1, 5, "new"), (1, 3, "old"), (2, 1, "a")), 0)
    write(rows((2, 9, "b"), (1, 4, "late")), 1)
    assert {r["k"]: r["v"] for r in mo.latest(spark, str(tmp_path), ["k"]).collect()} == {1: "new", 2: "b"}
