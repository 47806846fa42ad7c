import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from equilens.llm import mixing, neardup, urls, warc


def brute_fp(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(keys, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)].append(k)
    return [min(least[find(i)], default=None) for i in range(len(fps))]


def test_simhash_and_components_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "ré", "x\u00a0y", "the", "of", "Z"]
    texts = [None, "", " \t", "one", "two words", "A b c"]
    base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(150)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            t[rng.randrange(len(t))] = str(rng.random())
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += [texts[-1]] * 3 + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    keys = [None if i == 3 else 500 - i for i in range(len(texts))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in zip(keys, texts)], "doc_id bigint, text string, FP int")
    got = neardup.near_duplicates(docs.select("doc_id", "text")).collect()
    fps = [brute_fp(t) for t in texts]
    want = brute_components(keys, fps)
    assert sorted((r["doc_id"] or -1, r["fp"] & (1 << 64) - 1, r["component_id"] if r["component_id"] is not None else -1) for r in got) == sorted(
        (k or -1, f, c if c is not None else -1) for k, f, c in zip(keys, fps, want)
    )
    kept = neardup.keep_one(docs)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted([-1] + [k for k, c in zip(keys, want) if k is not None and k == c])
    assert kept.columns == docs.columns
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_anchors_find_every_close_pair():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    for a, b in zip(x, y):
        shared = 0
        for which in (0, 1):
            one, two = ({int(k) for k in neardup.anchors(np.array([v >> np.uint64(32 * which)]).astype(np.uint32))[1]} for v in (a, b))
            shared += len(one & two)
            assert len(one) <= 17
        assert shared


def test_large_anchor_and_long_chains(spark):
    rng = random.Random(4)
    # a chain: neighbours differ in 3 bits; and a dense cluster of one half
    chain, x = [], 0
    for i in range(20):
        chain.append(x)
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
    cluster = list({(7 << 40) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)})
    fps = list(dict.fromkeys(chain + cluster))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in neardup.components(neardup.links(nodes)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for f, c in zip(signed, want):
        groups[c].add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size string")
    return [r.asDict() for r in mixing.mix_sources(docs).collect()]


def fill(sizes, weights=(3, 1, 2)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = budget / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "é", None]), " ".join(["w"] * rng.randrange(0, 60)) or None, "x") for i in range(900)] + [(5, "a", "w w", "x")] * 3 + [(None, "solo", "w w w", "x"), (1, "none", "", "x"), (2, "none", None, "x")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = fill(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest[s])
    order = lambda x: sorted(map(str, x))
    assert order(mixed(spark, rows)) == order(got)
    assert mixed(spark, []) == [] if False else mixing.mix_sources(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_mixing_of_repeated_rows(spark):
    """Thousands of equal rows, and of rows without a key, are rounded together: their sum is within one document of what they are wanted."""
    rows = [(1, "a", "w w w", "x")] * 3000 + [(None, "a", "v v", "x")] * 2000 + [(k, "a", "u " * (k % 9), "x") for k in range(10, 400)] + [(k, "b", "z " * 40, "x") for k in range(500, 700)]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    target, size = next((r["target"], r["source_size"]) for r in got if r["source"] == "a")
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - target) <= 9
    equal = [r["copies"] for r in got if r["doc_id"] == 1]
    assert len(equal) == 3000 and abs(sum(equal) - 3000 * target / size) <= 1
    assert sum(r["doc_id"] is None for r in got) == 2000


def test_pivots_keep_expectations(spark):
    """Over many seeds, each document is taken about as often as its fraction says."""
    rows = [(k, "a", "w " * (1 + k % 5), "x") for k in range(12)] + [(k, "b", "w " * 30, "x") for k in range(20, 22)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size string")
    total, want = defaultdict(int), {}
    for seed in range(12):
        for r in mixing.mix_sources(docs, seed=seed, fan_in=4).where("source = 'b'").collect():
            total[r["doc_id"]] += r["copies"]
            want[r["doc_id"]] = r["target"] / r["source_size"]
    assert all(abs(total[k] / 12 - want[k]) < 0.5 for k in want)


def test_urls(spark):
    rows = [(1, "http://A.Example.net/en/x?q"), (2, "https://example.net/fr/"), (3, "x://example.net"), (4, None), (5, "no scheme"), (6, "http://blog.example.com/de/1#a"), (7, "http://z.org/fr/"), (8, "http://z.org/x"), (9, "http://notexample.net/en/"), (9, "http://bad.site/"), (10, "http://u:p@H:80/?a://b"), (11, "x\ny://h\n/p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as HOST")
    rules = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]
    outcomes = spark.createDataFrame([("bad.site", 1)] * 30 + [("good.site", 0)] * 60 + [("mixed.org", k % 2) for k in range(10)] + [("", 1), ("z.org", None)], "host string, bad int")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, outcomes, rules).collect()}
    assert got == {
        rows[0][1]: ("a.example.net", "/en/x", "example.net/en/", "allow"), rows[1][1]: ("example.net", "/fr/", "net/", "block"), rows[2][1]: ("example.net", "", None, "allow"),
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), rows[5][1]: ("blog.example.com", "/de/1", "example.com/de/", "block"), rows[6][1]: ("z.org", "/fr/", "org/fr/", "allow"),
        rows[7][1]: ("z.org", "/x", None, "allow"), rows[8][1]: ("notexample.net", "/en/", "net/", "block"), rows[9][1]: ("bad.site", "/", None, "block"), rows[10][1]: ("u:p@h:80", "/", None, "allow"), rows[11][1]: ("h\n", "/p", None, "allow"),
    }
    rep = {r["host"]: r for r in urls.reputation(outcomes).collect()}
    assert rep["bad.site"]["rate"] > rep["mixed.org"]["rate"] > rep["good.site"]["rate"]
    assert urls.judge_urls(pages, outcomes.limit(0), rules).where("verdict = 'block' and rule is null").count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted((rng.randrange(20), j) for _ in range(rng.randrange(0, 15))) for j in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("gzip", [True, False])
def test_warc_round_trip(spark, tmp_path, gzip):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
    rows = [(1, "http://b.x/1", long), (2, "http://a.x/\r\n2", long), (3, None, None), (4, "u", ""), (5, "http://a.x/2", "short"), (6, "http://a.x/2", "short"), (None, "n", "q"), (None, "n", long), (7, "http://a.x/2", long + " "), (7, "http://a.x/2", long + " ")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), gzip=gzip, file_bytes=5000)  # about three records
    records = warc.read_warc(spark, str(tmp_path / "w"))
    said = sorted((r["id"], r["record_type"], bytes(r["payload"]).decode()) for r in records.collect())
    assert said == sorted((str(k) if k is not None else "", "revisit" if h == long and k != 2 else "response", "" if h is None or (h == long and k != 2) else h) for k, _, h in rows)
    merged = warc.merge_indexes(records, per_range=4).collect()
    ordered = sorted(merged, key=lambda r: r["place"])
    keys = [(r["urlkey"], r["at"]) for r in ordered]
    assert keys == sorted(keys) and len(keys) == len(rows) and len({r["range"] for r in merged}) > 1
    assert [r["place"] for r in ordered] == list(range(len(rows))) and [r["range"] for r in ordered] == sorted(r["range"] for r in merged)
    seen = defaultdict(int)
    for r in ordered:  # numbers of captures go on across ranges
        seen[r["urlkey"]] += 1
        assert r["capture"] == seen[r["urlkey"]]
    got = warc.archive(pages, str(tmp_path / "v")).collect()
    import hashlib

    want = []
    for k, _, h in rows:
        body = (h or "").encode()
        revisit = h == long and k != 2
        want.append((k or -1, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert warc.archive(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_warc_one_url_over_many_ranges_and_large_payloads(spark, tmp_path):
    ends = ["\r\n", "\r\n\r", "\r", "\r\n\r\n", "\r\n\r\n\r\n\r\n", "\n\r\n\r", "\r\r\n\r\n\r", "x"]
    rows = [(k, "http://hot.example/", ends[k % 8] * (1 + k % 5) + "é" * (k % 7) + ends[(k + 3) % 8]) for k in range(200)] + [(1000 + k, f"http://b.example/{k % 3}", "p" * 3_000_000 + str(k)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "7 as payload_bytes", "'x' as Place")
    at = F.date_format(F.timestamp_seconds(F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    warc.write_warc(pages, str(tmp_path / "w"), at=at, file_bytes=200_000)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    assert {int(r["id"]): bytes(r["payload"]).decode() for r in records.collect()} == {k: h for k, _, h in rows}
    merged = warc.merge_indexes(records.drop("payload"), per_range=16)
    hot = sorted((r["place"], r["range"], r["capture"]) for r in merged.where("urlkey like 'example,hot%'").collect())
    assert len({r for _, r, _ in hot}) > 4 and [c for _, _, c in hot] == list(range(1, 201))
    assert warc.archive(pages, str(tmp_path / "v")).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "place", "capture"]


def test_record_stream_in_any_chunks():
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p) for p in (b"", b"\r\n\r\n", b"abc", b"\r\n"))
    for n in (1, 3, 7, 1000):
        stream, got = warc.RecordStream(), []
        for k in range(0, len(data), n):
            got += [(body, start) for _, body, start in stream.feed(data[k : k + n])]
        stream.close()
        assert [b for b, _ in got] == [b"", b"\r\n\r\n", b"abc", b"\r\n"] and all(data[s : s + 5] == b"WARC/" for _, s in got)
    with pytest.raises(ValueError):
        list(warc.parse(data[:-2]))


def test_registered_domains(spark):
    hosts = ["www.a.co.uk", "a.co.uk", "co.uk", "x.y.example.com:80", "10.0.0.1:8080", "[::1]:80", "u:p@h.example.org", "localhost"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.registered_domain(F.col("h")).alias("d"), urls.suffix(F.col("h")).alias("s"))
    assert {r["h"]: (r["d"], r["s"]) for r in df.collect()} == {
        "www.a.co.uk": ("a.co.uk", "co.uk"), "a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com:80": ("example.com", "com"), "10.0.0.1:8080": ("10.0.0.1", "ip"), "[::1]:80": ("[::1]", "ip"),
        "u:p@h.example.org": ("example.org", "org"), "localhost": ("localhost", "localhost"),
    }


def test_reputation_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"h{rng.randrange(4)}.d{rng.randrange(6)}.{rng.choice(['com', 'org', 'co.uk'])}", int(rng.random() < 0.4)) for _ in range(400)]
    got = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    suffix_of = lambda h: "co.uk" if h.endswith("co.uk") else h.split(".")[-1]
    domain_of = lambda h: h.split(".", 1)[1]
    count = lambda f: {x: (sum(f(h) == x for h, _ in rows), sum(b for h, b in rows if f(h) == x)) for x in {f(h) for h, _ in rows}}

    def level(children, parent_of, rates):
        out = {}
        for p, r in rates.items():
            own = {c: nk for c, nk in children.items() if parent_of(c) == p}
            v = sum((k / n - r) ** 2 * n - r * (1 - r) for n, k in own.values()) / sum(n for n, _ in own.values())
            m = min(1000.0, max(1.0, r * (1 - r) / v - 1)) if v > 0 else 1000.0
            out |= {c: (m * r + k) / (m + n) for c, (n, k) in own.items()}
        return out

    root = {0: (sum(b for _, b in rows) + 1) / (len(rows) + 2)}
    by_domain = level(count(domain_of), suffix_of, level(count(suffix_of), lambda _: 0, root))
    want = level(count(lambda h: h), domain_of, by_domain)
    assert set(want) == set(got) and all(abs(got[h]["rate"] - want[h]) < 1e-9 for h in want)
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame(rows, "host string, bad int"), []).count() == 0


def test_plain_warc_files_are_read_in_linear_time():
    import time

    from equilens.llm import warc

    def record(i):
        body = b"x" * 900
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    one = b"".join(record(i) for i in range(8000))
    times = []
    for data in (one, one * 8):
        began = time.time()
        found = [(h["warc-record-id"], len(b), s) for h, b, s in warc.parse(data)]
        times.append(time.time() - began)
        assert len(found) == 8000 * len(data) // len(one) and found[1][2] == len(record(0))
    assert times[1] < 20 * times[0] + 0.5
    stream = warc.RecordStream()  # the same in pieces of all sizes
    pieces, at = [], 0
    while at < 60_000:
        pieces.append(one[at : at + 1 + at % 777])
        at += len(pieces[-1])
    got = [(h["warc-record-id"], s) for p in pieces for h, _, s in stream.feed(p)]
    assert got == [(r, s) for r, _, s in found[: len(got)]] and len(got) >= 55


def test_near_duplicates_of_long_texts_with_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("k1", long, 1), ("k2", long + " more", 2), ("k3", "x" * 1_000_000, 3), ("k4", None, 4), ("k5", " ", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, FP int").selectExpr("*", "0 as Component_Id", "FP as extra")
    made = neardup.near_duplicates(docs)
    assert sorted(made.columns) == ["component_id", "doc_id", "extra", "fp"]
    assert {r["doc_id"]: r["component_id"] for r in made.collect()} == {"k1": "k1", "k2": "k1", "k3": "k3", "k4": "k4", "k5": "k4"}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_long_urls_and_empty_tables(spark):
    far = "http://" + "a." * 50_000 + "example.net/" + "p" * 100_000
    pages = spark.createDataFrame([(1, far, 9), (2, None, 9)], "page_id int, url string, VERDICT int")
    outcomes = spark.createDataFrame([("x.org", 1)], "host string, bad int")
    rules = [urls.Rule("block", "example.net", "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"])) for r in urls.judge_urls(pages, outcomes, rules).collect()}
    assert got == {1: ("example.net/", "block", 100_011), 2: (None, "allow", 0)}
    assert urls.judge_urls(pages.limit(0), outcomes.limit(0), rules).count() == 0
