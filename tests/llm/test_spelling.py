import random
import re
import zlib
from collections import Counter

import pytest

from equilens.llm import spelling as sp

SCHEMA = "doc_id bigint, text string, WORD string, n int"


def near(u, v):
    """Exactly one code point inserted, deleted or replaced."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        others = [(-counts[v], v) for v in counts if near(w, v)]
        best = min(others) if others else None
        strong = best is not None and -best[0] >= ratio * n
        out[w] = [best[1] if strong else None, n, len(others), -best[0] if strong else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def rows_by_word(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("most", [1 << 17, 12])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(11)
    counts = {"".join(rng.choice("aab") for _ in range(rng.randrange(1, 8))): rng.choice([1, 2, 4, 9, 20, 50]) for _ in range(170)}
    counts |= {"zürich": 40, "zurich": 3, "zürch": 10, "zürichh": 40, "日本日本": 5, "日本x本": 2, "🤦ab": 4, "ab": 9}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_by_word(sp.group_variants(frame, most=most)) == brute(counts)
    pairs = sp.near_words(frame, most).collect()
    assert len(pairs) == len({(r["word"], r["near"]) for r in pairs})  # each once


def test_a_cell_whose_words_share_much_is_dealt_out_again(spark):
    stem = "electro" * 3
    counts = {stem + a + b + c: 1 + (ord(a) * ord(b) + len(c)) % 40 for a in "abcdef" for b in "abcdef" for c in ["", "x", "y"]}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    dealt = sp.cells(frame, most=40)
    sizes = dealt.groupBy("cell").count().agg({"count": "max"}).first()[0]
    assert sizes <= 40
    assert rows_by_word(sp.group_variants(frame, most=40)) == brute(counts)


def test_chains_of_forms_end_at_their_root(spark):
    chain = {"a" * 5 + "b" * k: 3**k for k in range(1, 12)}
    got = rows_by_word(sp.group_variants(spark.createDataFrame(list(chain.items()), "word string, n bigint")))
    assert {r[1] for r in got.values()} == {"a" * 5 + "b" * 11}


def spoiled(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        word = run.translate(str.maketrans(sp.CAPITALS, sp.SMALL))
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
        yield word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word


def test_whole_texts(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeinrstÉé×") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    vocabulary += ["Straße", "STRASSE", "Éclair", "éclair", "dont", "abcde", "abcdf"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ".", "1", "\n"]) for _ in range(rng.randrange(120))) for _ in range(200)]
    texts += [None, "", "123 456", "same words here", "same words here", "abcde " * 30_000, "q" * 200_000]
    rows = [(i if i % 30 else None, t, "old", i) for i, t in enumerate(texts)] + [(900 + i, "q" * (200_000 - i % 2), "old", i) for i in range(8)]
    counts = Counter(w for r in rows for w in spoiled(r[0], r[1]))
    wanted = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = rows_by_word(sp.spelling_variants(spark.createDataFrame(rows, SCHEMA), drop=97))
    assert got == brute(wanted)
    assert sum(len(w) > 100_000 for w in got) == 2  # one is the other's form


def test_empty_tables_nulls_and_repeated_words(spark):
    assert sp.spelling_variants(spark.createDataFrame([], SCHEMA), drop=97).count() == 0
    rows = [("word", 1), ("word", 2), ("wordy", 7), (None, 5), ("", 5), ("ward", None)]
    assert rows_by_word(sp.group_variants(spark.createDataFrame(rows, "word string, n bigint"))) == brute({"word": 3, "wordy": 7})
    with pytest.raises(ValueError):
        sp.group_variants(spark.createDataFrame(rows, "word string, n bigint"), ratio=1)


def test_trie_pairs_equal_all_pairs():
    rng = random.Random(6)
    for _ in range(200):
        rests = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12))})
        found = [tuple(sorted(p)) for p in sp.Trie(rests).pairs()]
        assert len(found) == len(set(found))
        assert set(found) == {(i, j) for j in range(len(rests)) for i in range(j) if near(rests[i], rests[j])}
