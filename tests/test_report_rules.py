"""Rules of the run summary and the statistics report on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import runs
from equilens.operators import statsreport as sr


def rows_of(n):
    """Alternating genders, and a third one that sorts first; two confidences, of which only one counts."""
    return [(k, ("Female", "Male", "Another")[k % 3], int(k % 4 != 0), (k % 11) / 10, 0.99, "AB"[k % 2]) for k in range(n)]


@pytest.mark.parametrize("n, quantile", [(20, 2.093024), (60, 1.959964)])
def test_run_summary_as_surveyed(spark, n, quantile):
    rows = rows_of(n)
    s = runs.run_summary(spark.createDataFrame(rows, "subject_id int, gender string, risk_band_correct int, prediction_confidence double, confidence double, risk_label string"))
    y = np.array([r[2] for r in rows])
    reach = quantile * y.std(ddof=1) / math.sqrt(n)
    assert (s["accuracy_ci_lower"], s["accuracy_ci_upper"]) == pytest.approx((y.mean() - reach, y.mean() + reach), abs=1e-5)
    m, f = (np.array([r[2] for r in rows if r[1] == g]) for g in ("Male", "Female"))
    pooled = math.sqrt(((len(m) - 1) * m.var(ddof=1) + (len(f) - 1) * f.var(ddof=1)) / (len(m) + len(f) - 2))
    assert s["cohens_d"] == pytest.approx(abs(m.mean() - f.mean()) / pooled)
    p, ece = np.array([r[3] for r in rows]), 0.0
    for b in range(10):
        inside = (p > b / 10) & (p <= (b + 1) / 10)
        if inside.any():
            ece += abs(p[inside].mean() - y[inside].mean()) * inside.mean()
    assert s["calibration_error"] == pytest.approx(ece)


def test_other_confidence_gives_no_calibration_error(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8)], "risk_band_correct int, confidence double")
    assert runs.run_summary(rows)["calibration_error"] == 0.0 and runs.run_summary(rows)["cohens_d"] == 0.0


def test_statistics_read_their_input_once(spark, tmp_path):
    from equilens.plans.audit import audit

    a = audit(spark, "/root/testdata/sf0.001")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = a.mapInArrow(count, a.schema)
    report = sr.stats_report(counted)
    assert report.count() > 1000
    assert seen.value == a.count()
    assert report.where("test = 'two_proportion' and p is not null and p_holm >= p").count() > 0
    assert report.where("dimension = 'city' and p_holm is not null").count() == 0
    assert report.where("test = 'accuracy' and (p is not null or reject_bh)").count() == 0
    by_label = report.where("test in ('odds_true', 'odds_false')").select("label").distinct().count()
    assert by_label == 6


def test_statistics_of_no_rows(spark):
    from equilens.plans.audit import audit

    assert sr.statistics(audit(spark, "/root/testdata/sf0.001").where(F.lit(False))).count() == 0


def test_charts_with_facets_scales_and_themes(spark):
    from equilens.operators import report as rp

    df = spark.createDataFrame([("a", "u", 1.0, 1.0), ("a", "u", 99.0, 3.0), ("a", "v", 1000.0, 1.0), ("b", "v", 5000.0, 1.0)], "g string, panel string, y double, s double")
    made = rp.Chart(df).aes("g", "y", size="s").layer("line").facet("panel").scale("y", "log10", (1.0, 2000.0)).theme(font="serif").labs(title="t").build()
    assert made["facets"] == ["panel"] and made["scales"] == {"y": "log10"} and made["theme"] == {"font": "serif"} and made["labs"] == {"title": "t"} and made["aes"] == {"x": "g", "y": "y", "size": "s"}
    got = {(r["panel"], r["g"]): (r["y"], r["s"]) for r in made["data"].collect()}
    assert got == {("u", "a"): (pytest.approx(math.log10(50)), 2.0), ("v", "a"): (3.0, 1.0)}
    points = rp.Chart(df).aes("s", "y").layer("point").scale("y", "reverse").data().collect()
    assert sorted(r["y"] for r in points) == [-5000.0, -1000.0, -99.0, -1.0]
    for wrong in (lambda: rp.Chart(df).scale("z"), lambda: rp.Chart(df).scale("x", "cube"), lambda: rp.Chart(df).layer("bar").data()):
        with pytest.raises(ValueError):
            wrong()


def test_dashboard_without_filters_and_times(spark):
    from equilens.operators import report as rp

    df = spark.createDataFrame([(k, float(k % 10), float(k)) for k in range(100)] + [(200, None, 1.0)], "k int, bias double, other double")
    parts = rp.refreshed(df, "bias", models=["x"], low=1, high=2, time="timestamp", bins=5, order=["k"], rows=7)
    assert {r["bin"]: r["n"] for r in parts["main"].collect()} == {b: 20 for b in range(5)} == {r["bin"]: r["n"] for r in parts["distribution"].collect()}
    assert parts["temporal"].first()["q2"] == 4.5 and [r["k"] for r in parts["table"].collect()] == list(range(7)) and parts["network"].count() == 0
    same = rp.refreshed(df.where("k < 1"), "bias", bins=5)
    assert [(r["bin"], r["n"]) for r in same["distribution"].collect()] == [(0, 1)]
    assert rp.refreshed(df.limit(0), "bias")["distribution"].count() == 0
