import random
import re

import pytest

from equilens.llm import licenses as li

SCHEMA = "doc_id bigint, text string, SCORE string, extra int"
PHRASES = [(t.label, t.text.split()) for t in li.TEMPLATES if t.base]
NOTICE = next(t.text for t in li.TEMPLATES if t.label == "lgpl").split()


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def places(text):
    w = words_of(text)
    return sorted((i, label) for label, p in PHRASES for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)


def notices(text, slack=2, least=0.9):
    """Greatest share by label, by brute force: words of the template covered by equal grams on diagonals within slack of each one."""
    w, out = words_of(text), {}
    for t in li.TEMPLATES:
        if t.base:
            continue
        p = t.text.split()
        k = min(li.GRAM, len(p))
        hits = [(i - j, j) for i in range(len(w) - k + 1) for j in range(len(p) - k + 1) if w[i : i + k] == p[j : j + k]]
        for at, _ in hits:
            share = len({j + x for d, j in hits if abs(d - at) <= slack for x in range(k)}) / len(p)
            if share >= least:
                out[t.label] = max(out.get(t.label, 0), share)
    return out


def check(rows, got):
    assert len(got) == len(rows)
    for i, (_, text, _, extra) in enumerate(rows):
        r, found, more = got[extra], places(text), notices(text)
        assert r["n_words"] == len(words_of(text)) and r["n_base"] == len(found)
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert r["labels"] == ",".join(sorted({x for _, x in found} | set(more)))
        assert r["score"] == pytest.approx(max([1.0] * bool(found) + list(more.values()) + [0.0]))


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = "the MIT license Apache, cc-by CC by nc 4.0 gnu general public License licensed under x 日本 Ünï this work all rights reserved".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    for t in li.TEMPLATES:  # each template whole, with a word changed, put in, and left out
        w = t.text.split()
        i = rng.randrange(len(w))
        texts += [" ".join(["so", *x, "end"]) for x in (w, [*w[:i], "qq", *w[i + 1 :]], [*w[:i], "qq", *w[i:]], [*w[:i], *w[i + 1 :]])]
    texts += [None, "", "\0\n", "mit\0license", "MIT", "Kit license KMIT LICENSE", "gnu general public license general public license"]
    texts += ["cc by " * 20_000, "word " * 50_000 + "apache license", "same mit license", "same mit license"]
    rows = [(i if i % 40 else None, t, "old", i) for i, t in enumerate(texts)]
    quick = [r for r in rows if len(r[1] or "") < 10_000]
    made = li.scan_licenses(spark.createDataFrame(rows, SCHEMA))
    assert made.columns == ["doc_id", "extra", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r["extra"]: r for r in made.collect()}
    assert len(got) == len(rows)
    check(quick, {r[3]: got[r[3]] for r in quick})
    many, late = (got[r[3]] for r in rows if len(r[1] or "") > 10_000)
    assert (many["n_words"], many["n_base"], many["first_word"], many["last_word"]) == (40_000, 20_000, 0, 39_998)
    assert (late["n_base"], late["first_word"], late["labels"]) == (1, 50_000, "apache")


def test_edited_notice_is_one_span(spark):
    w = NOTICE
    edited = [*w[:6], *w[7:15], "quite", *w[15:]]  # one word less, later one more
    text = " ".join(["a"] * 9 + edited + ["b"] * 9 + w)
    spans = li.find_spans(spark.createDataFrame([(1, text, "", 1)], SCHEMA)).where("label = 'lgpl'").orderBy("first_word").collect()
    assert [(s["first_word"], s["end_word"]) for s in spans] == [(9, 9 + len(edited)), (18 + len(edited), 18 + len(edited) + len(w))]
    assert spans[1]["share"] == 1.0 and 0.9 <= spans[0]["share"] < 1.0


def test_repeated_rows_ties_and_empty_table(spark):
    rows = [(1, "the mit license", "", 1)] * 3 + [(1, "an apache license", "", 2), (None, "cc by", "", 3), (None, "cc by", "", 3)]
    got = li.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["extra"], r["labels"], r["n_base"]) for r in got) == [(1, "mit", 1)] * 3 + [(2, "apache", 1)] + [(3, "cc-by", 1)] * 2
    assert li.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_and_short_templates(spark):
    long = [f"w{i}" for i in range(150)]
    own = [li.Template("long", " ".join(long)), li.Template("one", "ONE", True)]
    assert [len(w) for _, _, w in li.pieces(own)] == [50, 50, 50, 1]
    rows = [(1, " ".join(long[20:120]), "", 1), (2, "One, two one", "", 2)]
    got = {r["extra"]: r for r in li.scan_licenses(spark.createDataFrame(rows, SCHEMA), own).collect()}
    assert (got[1]["labels"], got[1]["n_base"]) == ("long", 0)  # the middle piece is whole
    assert (got[2]["labels"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == ("one", 2, 0, 2)
    with pytest.raises(ValueError):
        li.pieces([li.Template("none", "...")])


def test_no_python_in_the_plan(spark):
    made = li.scan_licenses(spark.createDataFrame([(1, "x", "", 1)], SCHEMA))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
