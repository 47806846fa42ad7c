import random
import re

import pytest

from equilens.llm import decontaminate as de
from equilens.llm import language as la
from equilens.llm import tokens as tk

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def model_path():
    return str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


TEXTS = [None, "", " ", "  a  b \n <s> </s> x", "word " * 3000, "ünï 日本 \t\t end ", "a", "a", "\n", "no-break space  two   three ", "tail   x"]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    docs = spark.createDataFrame([(i, t, "en", "s", -1) for i, t in enumerate(TEXTS)], SCHEMA).withColumnRenamed("n_chars", "N_TOKENS")
    got = {r["doc_id"]: r for r in tk.count_tokens(docs, model_path()).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(sp.encode(t or ""))
        assert got[i]["n_bytes"] == len((t or "").encode())
    assert "N_TOKENS" not in tk.count_tokens(docs, model_path()).columns
    assert tk.count_tokens(docs.limit(0), model_path()).count() == 0


def test_json_tokenizers(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(docs, path).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}


@pytest.mark.parametrize("call", [1 << 18, 20])
def test_random_strings_equal_the_library(monkeypatch, call):
    import sentencepiece

    monkeypatch.setattr(tk, "CALL_BYTES", call)  # 20: nearly every part is split before a character that joins nothing
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    count, rng = tk._sentencepiece(model_path()), random.Random(7)
    for alphabet in ("abcTh <s>   ▁▁\n\t中国文é①", "abcdeh▁\n\n中国é①"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(1500)] + ["▁ ▁", "▁", " ▁ ", "a▁ ▁b"]
        assert count(texts) == [len(sp.encode(t)) for t in texts]
    long = "中\nab" * 200_000
    assert count([long]) == [len(sp.encode(long))]


def test_split_safely_keeps_text():
    for t in ["a b", " a", "a ", "a  b c", "", "  ", "a b  c d ", " a b"]:
        parts = tk.split_safely(t)
        assert " ".join(parts) == t


def brute(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit |= set(range(i, i + m))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_overlaps_equal_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = ["the", "of", "an", "ré", "x1", "日本", "Ab"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 5, 13, 14, 30, 30, 0])] + [(None, "zz yy"), (9, None), (10, "uu"), (3, "the of")]
    texts = [None, "", "!?", "ZZ, yy"]
    for _ in range(30):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            at = rng.randrange(len(t) + 1)
            t[at:at] = items[rng.randrange(3, 7)][1].split()
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, Spans int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in de.contamination(de.find_overlaps(docs, bench, block_bytes=block)).collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute(t, [("null" if a is None else a, b) for a, b in items])
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, names)
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    empty = de.contamination(de.find_overlaps(docs, bench.limit(0))).collect()
    assert not any(r["n_hit"] for r in empty)
    assert de.find_overlaps(docs.limit(0), bench).count() == 0


def test_suffix_automaton_accepts_substrings():
    sample = bytes([1, 2, 1, 1, 2, 3, 1, 2, 1])
    moves = la.suffix_automaton(sample)

    def accepts(s):
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    for i in range(len(sample)):
        for j in range(i, len(sample) + 1):
            assert accepts(sample[i:j])
    assert not accepts(bytes([3, 3])) and not accepts(bytes([1, 3]))


def greedy(text, sample):
    """Phrases of one parse of the whole text: each as long as it occurs in the sample, one byte at least."""
    import numpy as np

    folded, sample = (bytes(la.FOLD[np.frombuffer(x, np.uint8)]) for x in (text, sample))
    count = at = 0
    while at < len(folded):
        n = 1
        while at + n <= len(folded) and folded[at : at + n] in sample:
            n += 1
        count += 1
        at += max(1, n - 1)
    return count


@pytest.mark.parametrize("segment", [1024, 7, 1])
def test_phrases_equal_greedy_parse(monkeypatch, segment):
    import numpy as np

    monkeypatch.setattr(la, "SEGMENT", segment)
    samples = {"a": b"the cat sat on the mat", "b": b"der hund und die katze", "c": b"zzzzzzzzzzzzzzzzzzzzzzzzz"}
    parser = la.Parser(samples)
    rng = random.Random(1)
    words = ["the cat ", "sat on the mat", "der hund ", "und die ", "zzz", "!", "q", "at", "nd"]
    texts = ["".join(rng.choice("the cats und!Z ") for _ in range(rng.randrange(0, 90))).encode() for _ in range(40)] + [b"", b"x" * 2500, b"z" * 3000, b"the cat sat on the mat" * 300]
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(600, 900))).encode() for _ in range(3)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = parser.phrases(data, at)
    for t, row in zip(texts, got):
        assert list(row) == [greedy(t, samples[k]) for k in parser.languages]


def test_a_long_text_is_parsed_whole(spark):
    rng = random.Random(2)
    samples = {"en": b"the cat sat on the mat and the dog", "de": b"der hund und die katze"}
    text = " ".join(rng.choice(["the", "cat", "sat", "hund", "und", "xq"]) for _ in range(250_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id bigint, text string")
    for r in la.identify(docs.withColumn("t", docs["text"]), samples).collect():
        assert r["phrases"] == [greedy(r["t"].encode(), samples[k]) for k in sorted(samples)]


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "the cat"), (5, "der hund"), (5, "der hund"), (6, "日本")], "doc_id bigint, text string")
    got = la.identify(docs, {"en": b"the cat sat on the mat", "de": b"der hund und die katze"}).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == "und" and by[4] == "en" and by[5] == "de" and by[6] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in la.identify(docs, {}).collect()} == {"und"}
    assert la.learn(docs.selectExpr("text", "cast(null as string) as lang")) == {}


def test_language_samples_distinct_texts_of_all_languages(spark):
    rows = [(f"text number {i}", "aa") for i in range(20) for _ in range(50)] + [("copy", "aa")] * 5000
    rows += [(f"{lang} {i}", lang) for lang, n in (("bb", 9), ("cc", 40), ("dd", 10)) for i in range(n)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    got = la.learn(labelled, max_docs=8)
    assert sorted(got) == ["aa", "bb", "cc", "dd"]
    assert len(set(got["aa"].decode().replace("copy", "text number copy").split("text number ")[1:])) == 8
    many = spark.createDataFrame([(f"word{k} {i}" * 9, f"l{k:03}") for k in range(70) for i in range(6)], "text string, lang string")
    got = la.learn(many, max_total=70 * 256 * 2)
    assert len(got) == 70 and all(len(v) <= 2 * 257 for v in got.values())


def test_samples_of_unequal_size(spark):
    """A language with a small sample isn't at a loss against one with a large sample."""
    rng = random.Random(6)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for k, letters in (("big", "abcdefghij"), ("few", "efghijklmn"))}
    write = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    samples = {"big": write("big", 8000).encode(), "few": write("few", 250).encode()}
    docs = spark.createDataFrame([(i, write(k, 60), k) for i, k in enumerate(["big", "few"] * 100)], "doc_id bigint, text string, LANG_PRED string").withColumnRenamed("LANG_PRED", "truth")
    got = la.identify(docs, samples).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in got) >= 195


def test_language_empty_clashing_and_ties(spark):
    docs = spark.createDataFrame([(1, "zz", "x", 5)], "doc_id bigint, text string, Lang_Pred string, SCORE int")
    got = la.identify(docs, {"b": b"the cat", "a": b"the cat"})
    assert got.columns == ["doc_id", "lang_pred", "score", "phrases"]
    assert [(r["lang_pred"], r["score"]) for r in got.collect()] == [("a", 0.0)]
    assert la.identify(docs.limit(0), {"a": b"the cat"}).count() == 0
    assert la.learn(docs.limit(0), lang="Lang_Pred") == {}


def test_language_held_out(spark):
    import os

    from equilens.llm import queries

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    got = queries.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_memo_has_short_parts_only():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    count = tk._sentencepiece(model_path())
    memo = next(c.cell_contents for c in count.__closure__ if isinstance(c.cell_contents, dict))
    texts = ["日本語" * 40 + " short words " + "x" * 33, "short " * 9, "ü" * 32]
    assert count(texts) == count(texts) == [len(sp.encode(t)) for t in texts]
    assert max(map(len, memo)) <= tk.MEMO_CHARS and "日本語" * 40 not in memo


def test_shift_table_grows_with_the_block():
    rng = random.Random(1)
    for n in (50, 20_000):
        text = " ".join(f"w{rng.randrange(n)}" for _ in range(n))
        table = de.build_patterns([("a", text)], 13).tables[0]
        assert len(table.shift) >= 16 * n / 2
        assert (table.shift == table.shift.max()).mean() > 0.9  # most slots let the search skip a whole window
