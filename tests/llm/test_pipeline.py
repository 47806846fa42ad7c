import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.exists(SF):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, out = tmp_path_factory.mktemp("stages"), [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_columns_and_rows(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == corpus_pipeline.COLUMNS
        assert after.join(before, "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= before.count()
    assert stages[-1].count() == stages[-2].count()


def test_line_stage_equals_brute_force(stages):
    from test_lines_toxicity_imatch import brute_lines

    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = []
    for line in brute_lines(rows):
        k, text, _, removed = eval(line)
        if not (removed and not (text or "").strip(" \t\n\x0b\x0c\r")):
            want.append((k, text))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in stages[2].collect())


def test_near_duplicate_stage_equals_brute_force(stages):
    from test_dup_mix_url_warc import brute_components, brute_fp

    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    parts = brute_components([k for k, _ in rows], [brute_fp(t, 5) for _, t in rows])
    assert sorted(k for (k, _), c in zip(rows, parts) if k == c) == sorted(r["doc_id"] for r in stages[3].collect())


def test_near_duplicate_stage_drops_all_of_similarity(spark):
    import random

    rng = random.Random(8)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    rows = [(1, ""), (2, "One two"), (3, "one  TWO"), (4, "two one")]
    for k in range(60):
        base = [f"b{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        for j in range(3):
            text = list(base)
            for _ in range(rng.choice([1, 2, 3, 5]) * j):
                text[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            rows.append((10 + rng.randrange(10**6), " ".join(text)))
    sets = {k: shingles(t) for k, t in rows if t}
    near = {k for k, s in sets.items() if any(j < k and 10 * len(s & o) >= 8 * len(s | o) for j, o in sets.items())}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from equilens.llm.neardup import keep_one

    simhash = {r["doc_id"] for r in keep_one(docs, shingle=5).select("doc_id").collect()}
    assert simhash & near  # those that 3 bits leave
    got = [r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got) == sorted(simhash - near)


def test_decontamination_stage_equals_brute_force(spark, stages):
    from test_tokens_language_overlap import brute

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = []
    for r in stages[3].collect():
        n, hit, _ = brute(r["text"], items)
        if not (hit and 20 * hit >= n):
            keep.append(r["doc_id"])
    assert sorted(keep) == sorted(r["doc_id"] for r in stages[4].collect())


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1].collect()))
    assert got.agg(F.sum("taken")).first()[0] > 0


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark):
    if not os.path.exists(SF):
        pytest.skip("no tables")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, N_LINES int, fp string, score double, Copies int, __h int"
    rows = [(1, None, None, None, None, 1, "a", 0.1, 1, 1), (2, "", "en", None, 0, 1, "a", 0.1, 1, 1), (None, "one\ntwo", "en", "s", 7, 1, "a", 0.1, 1, 1), (3, "x" * 300_000, "en", "s", 300_000, 1, "a", 0.1, 1, 1), (3, "x" * 300_000, "en", "s", 300_000, 1, "a", 0.1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            got = stage(spark, some, SF)
            n = len(got.collect())
            assert n <= len(rows) and (name == "mixing" or got.columns == corpus_pipeline.COLUMNS)
            assert n == 0 if some is not docs else n >= 2
