"""I-Match fingerprints in DataFrame operations only.

A document's terms are its distinct words (runs of letters and digits, lower
case), as 64-bit hashes. Every term is counted by document frequency over all
documents. The lexicon is the terms whose inverse document frequency is at least a
share ``low`` of the highest there is (a term of one document). The terms
outside it are few: there are at most (terms a document) x documents ** low of them.
They are told exactly, by a bit map sized by their number and the terms
themselves behind it. REPEATS chains of randomised subsets of the lexicon are drawn by hash: the
whole lexicon, a quarter of it, a quarter of that, and so on, so that long and
short documents have some in which few of their terms fall. For each subset the
document's terms in it, distinct and sorted, are hashed: one part of the
fingerprint each.

The likeness of two fingerprints is the share of chains whose smallest subset
with a term of either document has the same hash for both.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chains of subsets of the lexicon, and subsets in each besides the whole.
REPEATS, LEVELS = 6, 6


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.array_distinct(F.transform(F.array_remove(parts, ""), lambda t: F.xxhash64(t)))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents by term (term, df), over all of ``docs``."""
    return docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def frequent_terms(frequencies: DataFrame, n_docs: int, low: float) -> list[int]:
    """The terms whose inverse document frequency ln(n_docs / df) is below a share ``low`` of ln(n_docs).

    A term of them is in more than n_docs ** (1 - low) documents, so there are at
    most (terms a document) x n_docs ** low: with 400 and a quarter, 150,000 of 2e10 documents.
    """
    whole = F.log(F.lit(float(max(2, n_docs))))
    frequent = frequencies.where(F.log(F.lit(float(max(2, n_docs))) / F.col("df")) / whole < low)
    return sorted(r["term"] for r in frequent.select("term").collect())


class Frequent(NamedTuple):
    """The frequent terms as literals: a bit map by a term's low ``width`` bits, and the terms themselves in buckets by four bits less, from ``starts`` on."""

    width: int
    bits: Column
    starts: Column
    terms: Column

    def has(self, term: Column) -> Column:
        """Whether a term is frequent: the map tells most others, and the bucket's terms (one on average) decide."""
        one = F.lit(1).cast("bigint")
        place = term.bitwiseAND(F.lit((1 << self.width) - 1).cast("bigint")).cast("int")
        bit = F.call_function("shiftright", F.get(self.bits, F.shiftright(place, 6)), place.bitwiseAND(63)).bitwiseAND(one)
        bucket = place.bitwiseAND((1 << self.width - 4) - 1)
        begin, end = F.get(self.starts, bucket), F.get(self.starts, bucket + 1)
        return F.when(bit == 1, F.array_contains(F.slice(self.terms, begin + 1, end - begin), term)).otherwise(False)


def frequent_table(terms: list[int]) -> Frequent:
    """``terms`` as a table that has 16 bits or more for each."""
    width = max(10, (16 * len(terms)).bit_length())
    words, buckets = [0] * ((1 << width) // 64), [[] for _ in range(1 << width - 4)]
    for t in terms:
        place = t % (1 << width)
        words[place // 64] |= 1 << place % 64
        buckets[place % len(buckets)].append(t)
    starts = list(accumulate(map(len, buckets), initial=0))
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    return Frequent(width, _literal(signed, "bigint"), _literal(starts, "int"), _literal([t for b in buckets for t in b], "bigint"))


def _literal(values: list[int], kind: str) -> Column:
    """One array literal (folded once, instead of a node for each value)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def fingerprint(text: Column, frequent: Frequent) -> Column:
    """Parts of the fingerprint, chains apart by spaces and subsets by commas: a 64-bit hash (hex) of the text's sorted terms in the subset, or '-' if it has none.

    ``frequent``: the terms outside the lexicon.
    """

    def part(kept: Column) -> Column:
        return F.when(F.size(kept) == 0, "-").otherwise(F.lpad(F.lower(F.hex(F.xxhash64(kept))), 16, "0"))

    def chain(own: Column, turn: Column) -> Column:
        shape = "struct<kept:array<bigint>,out:string>"
        start = F.struct(own.alias("kept"), part(own).alias("out")).cast(shape)

        def step(state: Column, level: Column) -> Column:
            def stays(t: Column) -> Column:
                return F.call_function("shiftright", F.xxhash64(t, turn), level * 2).bitwiseAND(F.lit(3).cast("bigint")) == 0

            kept = F.filter(state["kept"], stays)
            return F.transform(F.array(kept), lambda k: F.struct(k.alias("kept"), F.concat(state["out"], F.lit(","), part(k)).alias("out")).cast(shape))[0]

        return F.aggregate(F.array(*[F.lit(k) for k in range(LEVELS)]), start, step, lambda state: state["out"])

    turns = F.array(*[F.lit(k) for k in range(REPEATS)])
    own = F.array_sort(F.filter(terms(text), lambda t: ~frequent.has(t)))
    return F.transform(F.array(own), lambda kept: F.array_join(F.transform(turns, lambda turn: chain(kept, turn)), " "))[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of chains in which the smallest subset with a term of either has equal hashes; chains without any term are equal."""

    def equal(x: Column, y: Column) -> Column:
        pairs = F.zip_with(F.split(x, ","), F.split(y, ","), lambda p, q: F.when((p != "-") | (q != "-"), p == q))
        return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p.isNotNull()), F.lit(-1)), F.lit(True)).cast("double")

    return F.aggregate(F.zip_with(F.split(a, " "), F.split(b, " "), equal), F.lit(0.0), lambda s, x: s + x) / float(REPEATS)


#: Ranges that rows are dealt into at most (their first keys are part of the plan), and characters of text in one.
MOST_RANGES, RANGE_CHARS = 1024, 6_000_000


def ranges(cuts: list, nulls: int) -> list[tuple]:
    """(first key, parts) of ranges by ascending ``cuts``: a key that is cut at several times has as many parts; null keys, first, have ``nulls``."""
    return [(None, max(1, nulls)), *((k, cuts.count(k)) for k in sorted(set(cuts)))]


def with_next(docs: DataFrame, starts: list[tuple], key: str, text: str, columns: list[str]) -> DataFrame:
    """Each row with ``next``: the ``columns`` of the row that follows by key; the first follows the last.

    ``starts``: ranges that the rows are dealt into, as ``ranges`` gives them.
    Rows of a key with several parts are dealt out by their texts' hashes.
    Rows with equal keys follow each other by their texts' hashes (equal rows
    in any order); null keys come first. A single row is followed by itself.
    Rows are dealt out once; the first row of a range also goes to the range
    before it, so that no range needs another.
    """
    keys, parts = [k for k, _ in starts[1:]], [n for _, n in starts]
    # a range's numbers: one for each part of its first key, and one for the keys behind it
    base = [sum(n + 1 for n in parts[:i]) for i in range(len(parts))]
    literal = lambda x: F.array(*[F.lit(v) for v in x])
    place = F.coalesce(F.greatest(F.lit(1), F.size(F.filter(literal(keys), lambda s: s <= F.col(key)))), F.lit(0)) if keys else F.lit(0)
    place = F.when(F.col(key).isNull(), 0).otherwise(place)
    of = F.get(literal(parts), place)
    share = F.least(of - 1, F.floor((F.xxhash64(text) / float(1 << 64) + 0.5) * of)).cast("int")
    here = F.col(key).isNull() | (F.col(key) == F.get(literal(keys), place - 1)) if keys else F.col(key).isNull()
    behind = F.when(F.col(key) < F.get(literal(keys), F.lit(0)), 0).otherwise(of) if keys else of
    bucket = F.get(literal(base), place) + F.when(here, share).otherwise(behind)
    dealt = docs.withColumn("h", F.xxhash64(text)).withColumn("bucket", bucket)
    marks = {r["bucket"]: r["m"] for r in dealt.groupBy("bucket").agg(F.min(F.struct(F.col(key).alias("k"), "h")).alias("m")).collect()}  # a row for each range
    used = sorted(marks)
    kind = docs.schema[key].dataType.simpleString()
    firsts = docs.sparkSession.createDataFrame([(marks[b]["k"], marks[b]["h"], used[i - 1]) for i, b in enumerate(used)], f"__k {kind}, __h bigint, __to int")
    at_edge = dealt.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("__k")) & (F.col("h") == F.col("__h")), "left")  # at most MOST_RANGES rows
    places = F.array(F.struct(F.lit(0).alias("guest"), F.col("bucket").alias("b")), F.struct(F.lit(1).alias("guest"), F.col("__to").alias("b")))
    together = at_edge.withColumn("place", F.explode(F.filter(places, lambda p: p["b"].isNotNull()))).drop("__k", "__h", "__to", "bucket")
    w = Window.partitionBy("place.b").orderBy(F.col("place.guest"), F.col(key).asc_nulls_first(), F.col("h"))
    return together.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("place.guest = 0").drop("place", "h")


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = 0.25) -> DataFrame:
    """The key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text is the text with its last floor(n_chars / 2) characters
    replaced by the first as many (or all) of the next row's text, by key.
    Null texts are empty. Equal texts have equal fingerprints. The key is a
    number; repeated keys and null keys (first) follow each other by their texts.
    A text of any length is one row, whole. ``low``: the least inverse document
    frequency of the lexicon's terms, as a share of the highest.
    """
    body = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    many = [k / MOST_RANGES for k in range(MOST_RANGES)]
    n_docs, n_keys, chars, cuts = body.agg(F.count("*"), F.count("key"), F.sum(F.length("text")), F.percentile_approx("key", many, 10_000)).first()
    wanted = max(1, min(MOST_RANGES, (chars or 0) // RANGE_CHARS))
    step = -(-MOST_RANGES // wanted)
    starts = ranges((cuts or [])[::step], (n_docs - n_keys) * wanted // max(1, n_docs))
    frequent = frequent_table(frequent_terms(document_frequencies(body), n_docs, low))
    printed = body.withColumn("fingerprint", fingerprint(F.col("text"), frequent))
    follow = with_next(printed, starts, "key", "text", ["fingerprint", "text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    made = follow.select("key", n.cast("bigint").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    printed = made.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), frequent).alias("edited_fingerprint"), "next_fingerprint")
    own = F.col("fingerprint")
    near = [likeness(own, F.col(other)).alias(name) for other, name in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return printed.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
