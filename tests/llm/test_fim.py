import hashlib
import random

import pytest

from equilens.llm import fim

SCHEMA = "doc_id bigint, text string, FORM string, extra int"


def brute(doc_id, text):
    """The contract by plain string operations."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(text), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows_of(rng):
    alphabet = "ab <>PSM\n\té日🤦́\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", " ", "<P>", "a<S>b", "x<M", "<<P>>", "word " * 30_000, "日" * 100_000, "same", "same"]
    return [(i if i % 50 else None, t, "old", i) for i, t in enumerate(texts)]


def test_outputs_equal_plain_string_operations(spark):
    rows = rows_of(random.Random(3))
    made = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA))
    assert made.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "cuts_in_words", "output"]  # FORM clashes and goes
    got = {r["extra"]: r for r in fim.restore(made).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, i in rows:
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(doc_id, text)
        assert r["restored"] == (text or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_empty_table_and_repeated_rows(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0
    twice = fim.fill_in_middle(spark.createDataFrame([(7, "some text here", "", 1)] * 3, SCHEMA))
    assert twice.distinct().count() == 1 and twice.count() == 3


def words_brute(text):
    """Begins of the word units of a text."""
    begins = [i for i in range(len(text)) if text[i] not in fim.SPACES and i > 0 and text[i - 1] in fim.SPACES and text[:i].strip(fim.SPACES)]
    return [0, *begins] if text else []


def test_ranks_of_words_and_characters():
    rng, found = random.Random(5), fim.automaton()
    for _ in range(500):
        text = "".join(rng.choice("ab \n日<P>") for _ in range(rng.randrange(25)))
        events = fim.scan(text, found)
        begins, words, chars = words_brute(text), fim.Ranks(events, "word"), fim.Ranks(events, "char")
        assert words.n == len(begins) and chars.n == len(text)
        assert [words.place(k) for k in range(words.n)] == begins
        assert [chars.place(k) for k in range(len(text) + 1)] == list(range(len(text) + 1))
        for k in range(len(text) + 1):
            inside = 0 < k < len(text) and text[k - 1] not in fim.SPACES and text[k] not in fim.SPACES
            assert words.inside_word(k) == inside
    with pytest.raises(ValueError):
        fim.Ranks(events, "line")


def test_word_units_cut_between_words_and_come_back(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abc  \n") for _ in range(rng.randrange(60))), "", i) for i in range(300)]
    made = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit="word", plain=0, spm=50)
    got = fim.restore(made).collect()
    assert all(r["restored"] == rows[r["extra"]][1] for r in got)
    assert all(not r["cuts_in_words"] for r in got)
    assert {r["form"] for r in got} >= {"psm", "spm"}
