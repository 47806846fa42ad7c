"""Designs over given subjects: drawn answers, strata, pairs and probes."""

import random

import pytest
from pyspark.sql import functions as F

from equilens.functions import rubric as ru
from equilens.operators import generate as ge
from equilens.operators import ordered as od


def test_random_answers_go_by_the_key(spark):
    subjects = spark.range(3000).select((F.col("id") * 7).alias("who"), F.lit("x").alias("extra"))
    got = ge.random_answers(subjects, "who").collect()
    again = {r["who"]: r["answers"] for r in ge.random_answers(subjects.repartition(7), "who").collect()}
    assert all(again[r["who"]] == r["answers"] and r["extra"] == "x" for r in got)
    for r in got[:200]:
        assert r["toi"] == sum(r["answers"][k] for k in ge.TOI_ITEMS) and r["th"] == sum(r["answers"][k] for k in ge.TH_ITEMS)
        assert set(r["answers"].values()) <= set(range(1, 6)) and r["true_label"] == ru.LABELS[sum(r["toi"] > ru.cut(r["th"], k) for k in range(5))]
    every = [v for r in got for v in r["answers"].values()]
    assert abs(sum(every) / len(every) - 3) < 0.05
    assert 0.33 < sum(v == 3 for v in every) / len(every) < 0.44  # a rounded normal around 3


@pytest.mark.parametrize("n", [0, 1, 5, 6, 64, 125])
def test_strata_of_given_subjects(spark, monkeypatch, n):
    monkeypatch.setattr(od, "BLOCK_ROWS", 20)
    rng = random.Random(n)
    keys = rng.sample(range(10_000), n)
    got = ge.stratified_answers(spark.createDataFrame([(k, "x") for k in keys], "who long, extra string"), "who").collect()
    assert sorted(r["who"] for r in got) == sorted(keys)
    counts = [sum(r["true_label"] == x for r in got) for x in ru.LABELS]
    assert counts == [n // 6 + (j < n % 6) for j in range(6)]
    for r in got:
        assert set(r["answers"].values()) <= set(range(1, 6)) and r["toi"] == sum(r["answers"][k] for k in ge.TOI_ITEMS) and 2 <= r["th"] <= 10


def test_pairs_and_probes(spark):
    names = spark.createDataFrame([("a",), ("b",), ("a",)], "name_group string")
    cities = spark.createDataFrame([("x",), ("y",), ("z",)], "city string")
    every = {(r["name_group"], r["city"]) for r in ge.sample_pairs(names, cities, 99).collect()}
    assert every == {(a, c) for a in "ab" for c in "xyz"}
    two = ge.sample_pairs(names, cities, 2).collect()
    assert len(two) == 2 and {(r["name_group"], r["city"]) for r in two} < every
    probes = spark.createDataFrame([(20, 5, "p"), (21, 5, "q")], "toi_score int, th_score int, probe_type string")
    subjects = spark.createDataFrame([(20, 5), (20, 5), (20, 6)], "toi int, th int")
    assert {r["probe_type"]: r["n_subjects"] for r in ge.at_probes(probes, subjects).collect()} == {"p": 2, "q": 0}


def test_label_lookup_at_the_edges(spark):
    rows = [(t, h) for t in (None, -5, 8, 10, 11, 18, 19, 33, 34, 35, 40, 900) for h in (None, 1, 2, 7, 10, 11)]
    df = spark.createDataFrame(rows, "toi int, th int").withColumn("o", ru.label_ord(F.col("toi"), F.col("th"))).withColumn("d", ru.label_ord(F.col("toi").cast("double"), F.col("th").cast("double")))
    for r in df.collect():
        want = None if r["toi"] is None or r["th"] not in ru.CUT_TABLE else sum(r["toi"] > c for c in ru.CUT_TABLE[r["th"]])
        assert r["o"] == r["d"] == want
    half = spark.createDataFrame([(18.5, 2.0), (18.0, 2.0), (18.5, 2.5)], "toi double, th double")
    assert [r[0] for r in half.select(ru.label_ord(F.col("toi"), F.col("th"))).collect()] == [1, 0, None]
    own = {3: (1, 2, 3, 4, 5), 8: (2, 4, 6, 8, 10)}
    other = spark.createDataFrame([(5, 3), (5, 8), (5, 2)], "toi int, th int").select(ru.label_ord(F.col("toi"), F.col("th"), own)).collect()
    assert [r[0] for r in other] == [4, 2, None]
