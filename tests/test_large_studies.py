"""Studies so large that their standard errors are all at the floor of 0.01."""

import math

from equilens.operators import inference as inf
from equilens.operators import meta as me


def flat(spark):
    return spark.createDataFrame([("a", 0.1, 0.01), ("b", 0.2, 0.01), ("c", 0.4, 0.01)], "study string, effect double, se double")


def test_begg_without_variance(spark):
    r = me.begg(flat(spark)).first()
    assert r["n"] == 3 and math.isnan(r["rho"])


def test_spearman_by_group(spark):
    rows = [("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("one", 1.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 3.0), ("up", 3.0, 9.0), ("mixed", 1.0, 2.0), ("mixed", 2.0, 2.0), ("mixed", 3.0, 1.0)]
    got = {r["g"]: (r["n"], r["rho"]) for r in inf.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["up"] == (3, 1.0) and got["flat"][0] == 2 and math.isnan(got["flat"][1]) and math.isnan(got["one"][1])
    assert math.isclose(got["mixed"][1], -math.sqrt(3) / 2)
    assert inf.spearman(spark.createDataFrame([], "x double, y double"), "x", "y").first() == (0, None)


def test_egger_without_a_line(spark):
    r = me.egger(flat(spark)).first()
    assert (r["k"], r["dof"], r["intercept"], r["t"]) == (3, 1, None, None) and math.isnan(r["slope"]) and math.isnan(r["se"])


def test_egger_on_an_exact_line(spark):
    # effect / se = 1 + 2 / se
    exact = spark.createDataFrame([(2.0 + s, s) for s in (1.0, 0.5, 0.25)], "effect double, se double")
    r = me.egger(exact).first()
    assert (r["intercept"], r["slope"], r["se"], r["t"]) == (1.0, 2.0, 0.0, math.inf)
    few = me.egger(exact.limit(2)).first()
    assert few[1:] == (None,) * 5 and few["k"] == 2
