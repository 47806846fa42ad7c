import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from equilens.llm import imatch, linededup, toxicity


def sets_of(text):
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    return [frozenset(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(x))) for x in text.split("\n")]


def brute_lines(rows, percent=80, least=5):
    flat = [((-(1 << 63) if k is None else k), i, s, r) for r, (k, t) in enumerate(rows) if t is not None for i, s in enumerate(sets_of(t))]
    gone = set()
    for k, i, s, r in flat:
        if len(s) < least:
            continue
        for k2, i2, s2, _ in flat:
            if len(s2) >= least and (k2, i2) < (k, i) and 100 * len(s & s2) >= percent * len(s | s2):
                gone.add((r, i))
                break
    out = []
    for r, (k, t) in enumerate(rows):
        out.append((k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (r, i) not in gone), 0 if t is None else t.count("\n") + 1, sum(1 for a, _ in gone if a == r)))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed,first", [(1, 3), (2, 0)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, seed, first):
    monkeypatch.setattr(linededup, "FIRST_CANDIDATES", first)  # 0: every pair is found among the rest
    monkeypatch.setattr(linededup, "BUCKET_ROWS", 200)
    monkeypatch.setattr(linededup, "HOT_ROWS", 15)  # many words are split into cells
    monkeypatch.setattr(linededup, "HOT_CLASSES", 3)
    rng = random.Random(seed)
    common = ["the", "of", "and", "in", "to"]
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(common if rng.random() < 0.5 else words) for _ in range(rng.randrange(3, 40))] for _ in range(30)]
    rows = [(None, "a b c d e f"), (3, None), (4, ""), (5, "\n\n"), (6, "A, b c D e f!\nx"), (7, "short line"), (8, "short line")]
    for k in range(70):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(words)
            rng.shuffle(line)
            lines.append(" ".join(line))
        rows.append((rng.randrange(500), "\n".join(lines)))
    near = base[0] + words[:30]
    for k in range(40):  # one large group of near copies, each different
        line = list(near)
        line[rng.randrange(len(line))] = f"n{k}"
        line[rng.randrange(len(line))] = f"m{k}"
        rows.append((1000 + k, " ".join(line)))
    rows.append(rows[20])
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id bigint, text string, N_LINES int, k int, gone int")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "k", "gone", "n_lines", "n_removed"]
    assert sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_removed"])) for r in got.collect()) == brute_lines(rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_rest_pass_meets_all_that_the_first_pass_left(spark):
    """Early unlike partners of long lines pass the 64-bit filter and fail the 256-bit one; the match comes behind them."""
    rng = random.Random(5)
    shared, pool = [f"p{i}" for i in range(41)], [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(shared + rng.sample(pool, 159))) for k in range(6)]
    body = rng.sample(pool, 169)
    rows += [(10, " ".join(shared + body[:159])), (11, " ".join(shared + body[10:]))]
    rows += [(100 + k, " ".join(rng.sample(pool, 200))) for k in range(60)]  # make the words of the pool frequent
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_removed"])) for r in linededup.dedup_lines(docs).collect())
    want = brute_lines(rows)
    assert sum(x.endswith(", 1)") for x in want) == 1
    assert got == want


def test_rest_pass_takes_the_rows_of_the_first_pass(spark, monkeypatch):
    """All texts are cut into prefix words once, also where a second round is needed."""
    made, real = [], linededup.entries_of
    monkeypatch.setattr(linededup, "entries_of", lambda *a, **b: made.append(1) or real(*a, **b))
    monkeypatch.setattr(linededup, "FIRST_CANDIDATES", 0)
    monkeypatch.setattr(linededup, "GATHER", 3)  # the rows of a word come in several pieces
    rows = [(k, f"one two three four five six seven eight nine n{k % 3}\nmark{k} is a line that no other line is like {k}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_removed"])) for r in linededup.dedup_lines(docs).collect())
    assert got == brute_lines(rows)
    assert len(made) == 1


def test_few_tables_are_written_down(spark, monkeypatch):
    """Each file of a scratch table costs processes, so that only what is used several times is written down."""
    written, store = [], linededup.tx.stored
    monkeypatch.setattr(linededup.tx, "stored", lambda df: written.append(df) or store(df))
    monkeypatch.setattr(linededup, "FIRST_CANDIDATES", 0)  # a second round is needed
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(14)] for _ in range(8)]
    rows = [(k, " ".join(w if rng.random() > 0.1 else "x" for w in base[k % 8])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = linededup.dedup_lines(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines(rows)
    assert len(written) == 12


def test_bitmap_has_the_values_of_all_columns(spark):
    table = linededup.bitmap(spark.createDataFrame([(1, -5), (2, 7)], "a bigint, b bigint"))
    assert linededup.in_bitmap(table, np.array([1, 2, -5, 7], np.int64).view(np.uint64)).all()
    assert not linededup.in_bitmap(table, np.array([3, 5, -7], np.int64).view(np.uint64)).any()


def test_lines_that_are_not_wanted_are_not_read():
    texts = ["Alpha b\nc d e\n", "", "c d e", "f" * 100 + "\n" + "é g"]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    for sets_of, lines in ((linededup.line_sets, 7), (linededup.shingle_sets, 4)):
        line, hashes, counts, sets, size = sets_of(data, at)
        assert counts.sum() == lines == len(sets)
        for some in range(1 << lines):
            wanted = (some >> np.arange(lines)) & 1 == 1
            line2, hashes2, counts2, sets2, size2 = sets_of(data, at, lambda c: wanted)
            assert (line2 == line[wanted[line]]).all() and (hashes2 == hashes[wanted[line]]).all() and (counts2 == counts).all()
            assert (sets2 == np.where(wanted[:, None], sets, 0)).all() and (size2 == np.where(wanted, size, 0)).all()


def test_hashes_by_blocks_tell_words_apart():
    """The words are those that are hashed by bytes; equal words have equal hashes wherever they stand, others have others."""
    rng = random.Random(4)
    seen = {}
    for _ in range(150):
        rows = ["".join(rng.choice(["a", "b", "Z", "é", "0", " ", "\n", "日", "-"]) for _ in range(rng.randrange(90))) + "x" * rng.choice([0, 0, 7, 8, 9, 63, 64, 65, 150]) for _ in range(8)]
        data, at = np.frombuffer(("qqq" + "".join(rows) + "zz").encode(), np.uint8), np.cumsum([3] + [len(r.encode()) for r in rows])
        plain, blocks = (f(data, at, linededup.tx.ALNUM) for f in (linededup.tx.words, linededup.tx.words_by_blocks))
        assert all((plain[i] == blocks[i]).all() for i in (0, 1, 3))
        for begin, length, value in zip(*blocks[:3]):
            assert seen.setdefault(bytes(data[3 + begin : 3 + begin + length]).lower(), value) == value
    apart = {int(value) >> 21 for value in seen.values()}
    assert len(apart) == len(seen) > 3000


def test_a_document_of_a_million_lines(spark):
    """Marking is linear in lines, however many go."""
    import time

    began = time.time()
    text = "one and the same line of seven words\n" * 1_000_000 + "another line of quite other words here"
    got = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, "x\none and the same line of seven words\ny")], "doc_id bigint, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] == "one and the same line of seven words\nanother line of quite other words here"
    assert (by[1]["n_lines"], by[1]["n_removed"]) == (1_000_001, 999_999)
    assert (by[2]["text"], by[2]["n_removed"]) == ("x\ny", 1)
    assert time.time() - began < 120


def test_words_of_many_lines_are_split_beyond_the_table(spark, monkeypatch):
    monkeypatch.setattr(linededup, "KNOWN_WORDS", 4)
    counts = spark.createDataFrame([(k, 1000 - k) for k in range(60)], "word bigint, n bigint")
    words, cells = linededup.known_words(counts, 100)
    assert len(words) >= 60 and (cells > 1).all()
    monkeypatch.setattr(linededup, "MOST_KNOWN", 20)  # the bound rises with all words' lines, so that the table stays small
    words, cells = linededup.known_words(counts, 100)
    assert len(words) <= 24


def test_equal_lines_of_few_words_go(spark):
    chinese, thai, few = "本网站所有内容版权归本公司所有，未经许可不得转载", "สงวนลิขสิทธิ์ตามกฎหมายห้ามทำซ้ำ", "Alpha_bravo charlie delta " * 4
    rows = [(1, f"{chinese}\nhome\n{few}"), (2, f"x\n{chinese}\n{thai}"), (3, f"{thai}\nhome\n{few.lower()}.\n{chinese[1:]}"), (4, "-" * 80 + "\n" + "-" * 80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"x\n{thai}", 1), 3: (f"home\n{chinese[1:]}", 2), 4: (rows[3][1], 0)}


def brute_terms(text):
    return {xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\W_]+", (text or "").lower())}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_imatch_edges_and_edits(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(80)] + ["the", "of"] * 20
    texts = [None, "", "a", "ab", "日本語 é", "!!"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += [texts[10], texts[11]]
    rows = [(None if i == 4 else 3 * i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int").select("text", "doc_id", "fingerprint")
    got = {r["doc_id"]: r for r in imatch.fingerprints_with_edits(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(((-1 if k is None else k), t or "") for k, t, _ in rows)
    import hashlib

    for n, (k, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        r = got[None if k < 0 else k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = [r["fingerprint"] for k, r in got.items() if k is not None and (rows[k // 3][1] or "") == texts[10]]
    assert len(same) >= 2 and len(set(same)) == 1
    assert imatch.fingerprints_with_edits(docs.limit(0)).count() == 0
    one = imatch.fingerprints_with_edits(docs.where("doc_id = 30")).collect()
    assert one[0]["near_next"] == 1.0


@pytest.mark.parametrize("cuts,nulls", [([], 0), ([0, 10, 20, 21, 50], 0), ([5, 10, 30, 30, 30, 30, 41], 3)])
def test_imatch_ranges_follow_each_other(spark, cuts, nulls):
    rng = random.Random(9)
    rows = [(rng.choice([30, rng.randrange(60)]), "".join(rng.choice("ab ") for _ in range(rng.randrange(20)))) for _ in range(120)] + [(None, f"x{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "key bigint, text string")
    got = imatch.with_next(docs, imatch.ranges(cuts, nulls), "key", "text", ["text"]).collect()
    h = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((-1 if k is None else k), h(t), t) for k, t in rows)
    want = sorted((a[0], a[2], order[(i + 1) % len(order)][2]) for i, a in enumerate(order))
    assert sorted(((-1 if r["key"] is None else r["key"]), r["text"], r["next"]["text"]) for r in got) == want


def brute_frequent(texts, low):
    df = {}
    for t in texts:
        for x in brute_terms(t):
            df[x] = df.get(x, 0) + 1
    n = max(2, len(texts))
    full = {x for x, c in df.items() if np.log(n / c) / np.log(n) < low}
    return lambda x: x in full


def brute_fingerprint(text, frequent):
    def long_hash(x, seed):
        return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)

    def part(kept):
        seed = 42
        for x in kept:
            seed = long_hash(x, seed)
        return f"{seed:016x}" if kept else "-"

    own = sorted(signed(x) for x in brute_terms(text) if not frequent(x))
    chains = []
    for turn in range(imatch.REPEATS):
        kept, parts = own, [part(own)]
        for level in range(imatch.LEVELS):
            kept = [x for x in kept if xxhash.xxh64_intdigest(turn.to_bytes(4, "little"), long_hash(x, 42)) >> 2 * level & 3 == 0]
            parts.append(part(kept))
        chains.append(",".join(parts))
    return " ".join(chains)


def brute_likeness(a, b):
    same = 0
    for x, y in zip(a.split(" "), b.split(" ")):
        pairs = [(p, q) for p, q in zip(x.split(","), y.split(",")) if p != "-" or q != "-"]
        same += not pairs or pairs[-1][0] == pairs[-1][1]
    return same / imatch.REPEATS


def test_imatch_fingerprints_equal_brute_force(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(400)]
    texts = [None, "", "the", "!!"] + [" ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(["the", "of"]) for _ in range(rng.randrange(1, 300))) for _ in range(80)]
    texts += [texts[9], texts[9] + " more", "w" * 300_000, "long " + " ".join(f"t{i}" for i in range(60_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints_with_edits(docs, low=0.3).collect()}
    frequent = brute_frequent(texts, 0.3)
    assert frequent(xxhash.xxh64_intdigest(b"the", 42)) and not frequent(xxhash.xxh64_intdigest(b"v1", 42))
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, own_edited, own_next = (brute_fingerprint(x, frequent) for x in (t, edited, after))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, own_edited)
        assert abs(got[i]["near_edited"] - brute_likeness(own, own_edited)) < 1e-9
        assert abs(got[i]["near_next"] - brute_likeness(own, own_next)) < 1e-9


def test_imatch_keeps_documents_apart_with_a_large_vocabulary(spark):
    """Many more terms than the map has bits: the lexicon stays full."""
    n, terms = 4000, 120
    docs = spark.range(n).selectExpr("id as doc_id", f"concat('the of and ', array_join(transform(sequence(1, {terms}), x -> concat('t', id * {terms} + x)), ' ')) as text")
    got = imatch.fingerprints_with_edits(docs).select("fingerprint", "near_next").collect()
    assert len({r["fingerprint"] for r in got}) == n
    assert max(r["near_next"] for r in got) < 0.5


def test_imatch_terms_and_lexicon(spark):
    texts = ["The cat, the DOG", "cat mouse", "cat house", "dog"] + ["filler"] * 10
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    df = {r["term"] % (1 << 64): r["df"] for r in imatch.document_frequencies(docs).collect()}
    want = {}
    for t in texts:
        for x in brute_terms(t):
            want[x] = want.get(x, 0) + 1
    assert df == want
    found = imatch.frequent_terms(imatch.document_frequencies(docs), len(texts), 0.3)
    outside = brute_frequent(texts, 0.3)
    assert {x % (1 << 64) for x in found} == {x for x in want if outside(x)}


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_imatch_table_of_frequent_terms_is_exact(spark, n):
    """Terms that share all low bits with frequent ones stay rare, however full the map is."""
    rng = random.Random(n)
    frequent = [signed(rng.getrandbits(64)) for _ in range(n)]
    others = [signed((x ^ (1 << 40 + k % 20)) % (1 << 64)) for k, x in enumerate(frequent)] + [signed(rng.getrandbits(64)) for _ in range(500)]
    table = imatch.frequent_table(sorted(frequent))
    rows = spark.createDataFrame([(x, k < n) for k, x in enumerate(frequent + others)], "t bigint, want boolean")
    got = rows.select("want", F.filter(F.array("t"), lambda t: table.has(t)).alias("f")).selectExpr("want", "size(f) = 1 as got").collect()
    assert all(r["got"] == r["want"] for r in got) and len(got) == 2 * n + 500


def test_label_model_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, np.where(y, 1, -1), np.where(y, -1, 1))
    weak = np.where(rng.random(4000) < 0.6, np.where(y, 1, -1), np.where(y, -1, 1))
    votes = np.stack([good, weak, weak, weak, weak], 1).astype(np.int8)
    labels = np.where(np.arange(4000) < 1500, y, -1).astype(int)
    posterior, table, corr, prior = toxicity.label_model(votes, labels)
    assert abs(prior - 0.3) < 0.05
    assert corr[1, 2] > 0.9 > 0.3 > abs(corr[0, 1])
    assert ((posterior > 0.5) == y)[1500:].mean() > 0.88
    assert abs(table[0, 1, 2] - 0.9) < 0.05


def test_wrong_labels_are_outvoted_and_unlabelled_rows_count():
    rng = np.random.default_rng(4)
    n = 4000
    truth = (rng.random(n) < 0.2).astype(int)
    votes = np.stack([np.where(rng.random(n) < 0.6, np.where(rng.random(n) < 0.92, 2 * truth - 1, 1 - 2 * truth), 0) for _ in range(8)], 1).astype(np.int8)
    given = np.where(rng.random(n) < 0.5, np.where(rng.random(n) < 0.85, truth, 1 - truth), -1)  # half have a label, of which one in seven is wrong
    posterior, table, _ = toxicity.weak_labels(votes, given, np.ones(n, bool))
    wrong = (given >= 0) & (given != truth)
    assert ((posterior[wrong] > 0.5) == truth[wrong]).mean() > 0.9
    assert ((posterior > 0.5) == truth).mean() > 0.97
    assert abs(table[-1, 1, 2] / (table[-1, 1, 0] + table[-1, 1, 2]) - 0.85) < 0.06  # the label's own accuracy on toxic documents is found
    alone, _, _ = toxicity.weak_labels(votes[given >= 0], given[given >= 0], np.ones((given >= 0).sum(), bool))
    assert not np.allclose(alone, posterior[given >= 0])  # rows without a label take part


def test_label_model_equals_brute_force():
    """One voter at a time, one row at a time: EM with abstentions as no evidence and shared evidence divided."""
    import math

    rng = np.random.default_rng(4)
    votes = rng.choice([-1, 0, 1], (60, 3)).astype(np.int8)
    votes[:, 2] = np.where(rng.random(60) < 0.8, votes[:, 1], votes[:, 2])
    labels = rng.choice([-1, 0, 1], 60)
    n, m = votes.shape
    known = [y for y in labels if y >= 0]
    p = (sum(known) + 1) / (len(known) + 2)
    q = [p if y < 0 else float(y) for y in labels]
    corr = [[float(i == j) for j in range(m)] for i in range(m)]
    for step in range(6):
        table = [[[(sum((q[r] if c else 1 - q[r]) for r in range(n) if votes[r][k] == v) + 0.5) / (sum(q[r] if c else 1 - q[r] for r in range(n)) + 1.5) for v in (-1, 0, 1)] for c in (0, 1)] for k in range(m)]
        p = sum(q) / n
        if step >= 2:
            mean = lambda k, r: q[r] * (table[k][1][2] - table[k][1][0]) + (1 - q[r]) * (table[k][0][2] - table[k][0][0])
            rest = [[votes[r][k] - mean(k, r) for k in range(m)] for r in range(n)]
            size = [math.sqrt(sum(x[k] ** 2 for x in rest) / n) + 1e-9 for k in range(m)]
            corr = [[sum(x[i] * x[j] for x in rest) / size[i] / size[j] / n for j in range(m)] for i in range(m)]
        share = [1 / (1 + sum(max(0, corr[k][j] - (k == j)) for j in range(m))) for k in range(m)]
        logit = [math.log(p / (1 - p)) + sum(share[k] * math.log(table[k][1][votes[r][k] + 1] / table[k][0][votes[r][k] + 1]) for k in range(m) if votes[r][k]) for r in range(n)]
        posterior = [1 / (1 + math.exp(-x)) for x in logit]
        q = [posterior[r] if labels[r] < 0 else float(labels[r]) for r in range(n)]
    got, got_table, got_corr, got_p = toxicity.label_model(votes, labels, rounds=6)
    assert np.allclose(got, posterior) and np.allclose(got_table, table) and np.allclose(got_corr, corr, atol=1e-6) and abs(got_p - p) < 1e-9


def test_toxicity_sample_is_of_distinct_whole_texts(spark):
    rows = [(i, f"tree river stone {i} " + "cloud " * 6000 + ("scum" if i % 3 == 0 else "bird"), int(i % 3 == 0)) for i in range(600)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    copies = labelled.unionByName(spark.range(3000).selectExpr("id + 1000 as doc_id", "'one text copied often' as text", "0 as toxic"))
    model = toxicity.train(copies, max_rows=300)
    got = toxicity.score(spark.createDataFrame([(1, "cloud " * 9000 + " scum"), (2, "cloud bird"), (3, "one text copied often"), (4, "x" * 2_000_000)], "doc_id bigint, text string"), model).collect()
    assert [r["predicted"] for r in sorted(got)] == [1, 0, 0, 0]  # the word stands behind 30,000 characters


def test_toxicity_edges(spark):
    rng = random.Random(4)
    clean = ["sun", "tree", "river", "stone", "cloud", "bird"]
    rows = []
    for i in range(300):
        t = [rng.choice(clean) for _ in range(rng.randrange(5, 30))]
        bad = i % 4 == 0
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["Scum", "moronic", "moron"])
        rows.append((i, " ".join(t), int(bad)))
    rows += [(900, None, 1), (901, "no label", None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(labelled)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "sun tree"), (4, "sun SCUM tree"), (5, "morons"), (5, "morons")], "doc_id bigint, text string").selectExpr("*", "5 as Score")
    got = toxicity.score(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and [by[i]["predicted"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    for some in (labelled.limit(0), labelled.where("toxic = 0"), labelled.where("toxic = 1")):
        assert toxicity.score(docs, toxicity.train(some)).count() == 6


def test_toxicity_held_out(spark):
    import os

    from equilens.llm import queries

    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 3 == 1)).all()
    hit = got[got.toxic == 1].predicted.mean()
    false = got[got.toxic == 0].predicted.mean()
    assert hit > 0.7 and false < 0.015
