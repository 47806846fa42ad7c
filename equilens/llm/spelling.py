"""Spelling variants: a trie self-join of the vocabulary with active-node sets.

Two words are near if one insertion, deletion or replacement of a code point
leads from one to the other. The edit lies in the first or in the second half of
the shorter word, so that the words share the other half: the vocabulary's trie
is dealt out by first halves, and, for edits in front, by second halves. Each
cell's words, without what they share, make a trie of their own. Going down it,
each node's active nodes (those whose strings are within distance one) follow
from its parent's: matches of the parent's active nodes, the parent, the
siblings and the children. Active nodes of a word's last node that end a word
are its near words.

The halves are those of the shorter word, so a word goes to the cells of its
own length and of the length before. A cell of many characters is dealt out
again by the halves of what its words don't share, until it is small or one
code point is left; no cell is then larger than that bound or the pairs of its
alphabet, whatever the vocabulary looks like.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Characters of a cell's tries; larger cells are dealt out again.
CELL_CHARS = 1 << 17
#: A run, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """``word`` with A-Z lower-cased (a word that ``lower`` leaves alone has none)."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, CAPITALS, SMALL))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int | None = None) -> DataFrame:
    """(word, n): occurrences of each lower-cased run over all texts.

    ``drop``: where the crc32 of ``<key>:<run>`` is a multiple of it, the run
    loses the code point at that number modulo its length (a null key is empty).
    """
    run = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    word = run.select("k", lower_ascii(F.col("run")).alias("word"))
    if drop:
        drawn = word.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "word").cast("binary")))
        place = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
        word = drawn.select(F.when(F.col("h") % drop == 0, less).otherwise(F.col("word")).alias("word"))
    return word.groupBy("word").agg(F.count("*").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of a cell (cell, lo, hi, m, word, n) as one row of a cell of words that share the first half, and one of those that share the second.

    A cell's words share their first ``lo`` and last ``hi`` code points; the shorter ones have ``m`` between, the longer ones m + 1.
    """
    a = F.floor(F.col("m") / 2).cast("int")
    b = F.col("m") - a
    front = F.substring(F.col("word"), F.col("lo") + 1, a)
    back = F.substring(F.col("word"), F.length("word") - F.col("hi") - b + 1, b)
    first = F.struct(F.xxhash64("cell", F.lit("front"), front).alias("cell"), (F.col("lo") + a).alias("lo"), F.col("hi"), b.alias("m"))
    second = F.struct(F.xxhash64("cell", F.lit("back"), back).alias("cell"), F.col("lo"), (F.col("hi") + b).alias("hi"), a.alias("m"))
    both = rows.select("word", "n", F.explode(F.array(first, second)).alias("c"))
    return both.select("c.cell", "c.lo", "c.hi", "c.m", "word", "n").where("m > 0")


def cells(vocabulary: DataFrame, most: int = CELL_CHARS) -> DataFrame:
    """Rows (cell, lo, hi, m, word, n) of ``vocabulary`` (word, n) in cells of at most ``most`` characters, or with one code point left."""
    length = F.length("word")
    classes = vocabulary.where(length > 0).select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    rows = _halves(classes.select(F.col("m").cast("bigint").alias("cell"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "m", "word", "n"))
    done = None
    while True:
        weight = rows.groupBy("cell").agg(F.sum(F.length("word") - F.col("lo") - F.col("hi")).alias("chars"), F.max("m").alias("m"), F.count("*").alias("words"))
        large = tx.stored(weight.where((F.col("chars") > most) & (F.col("m") > 1) & (F.col("words") > 1)).select("cell"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = tx.stored(_halves(rows.join(large, "cell", "left_semi")))


class Trie:
    """Trie of a cell's rests; node 0 is the root."""

    def __init__(self, rests: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, rest in enumerate(rests):
            node = 0
            for c in rest:
                below = self.children[node].get(c)
                if below is None:
                    below = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = below
            self.ends[node] = i

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Numbers i, j of rests at distance one, each pair once."""
        children, ends = self.children, self.ends
        stack = [(0, set(children[0].values()))]
        while stack:
            node, active = stack.pop()
            end = ends[node]
            if end >= 0:
                for x in active:
                    if ends[x] >= 0 and x < node:
                        yield end, ends[x]
            below = children[node]
            for c, child in below.items():
                near = {children[x][c] for x in active if c in children[x]}  # the active nodes' matches
                near.update(below.values())  # a replacement
                near.update(children[child].values())  # an insertion
                near.add(node)  # a deletion
                near.discard(child)
                stack.append((child, near))


def near_in_cell(words: list[str], lo: int, hi: int, m: int) -> Iterator[tuple[int, int]]:
    """Numbers of the words of a cell that are near each other, for pairs whose shorter word has ``m`` code points between the shared ends.

    Where an inserted code point equals its neighbour, the edit has several
    places; the last one counts, so that a pair comes from one cell only.
    """
    shared = defaultdict(list)
    for i, w in enumerate(words):  # the cell is a hash: words with other ends are told apart
        shared[w[:lo], w[len(w) - hi :]].append(i)
    for some in shared.values():
        if len(some) < 2:
            continue
        rests = [words[i][lo : len(words[i]) - hi] for i in some]
        for i, j in Trie(rests).pairs():
            short, long = sorted((rests[i], rests[j]), key=len)
            if len(short) == m and not (hi and len(long) > m and long.startswith(short)):
                yield some[i], some[j]


_FIELDS = "word string, near string, near_n bigint"


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table.column("cell").to_numpy()
        edge = np.flatnonzero(np.diff(cell)) + 1
        begin = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([begin, [len(cell)]]))
        many = np.repeat(size > 1, size)  # most cells have one word
        kept = table.filter(pa.array(many))
        words, counts = kept.column("word").to_pylist(), kept.column("n").to_pylist()
        lo, hi, m = (kept.column(c).to_pylist() for c in ("lo", "hi", "m"))
        left, right, n = [], [], []
        at = 0
        for k in size[size > 1].tolist():
            for i, j in near_in_cell(words[at : at + k], lo[at], hi[at], m[at]):
                left += (words[at + i], words[at + j])
                right += (words[at + j], words[at + i])
                n += (counts[at + j], counts[at + i])
            at += k
            if len(n) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])
                left, right, n = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    for batch in batches:
        cell = batch.column(0).to_numpy()
        if not len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut or (held and held[0].column(0)[0].as_py() != cell[-1]):
            yield from emit(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from emit(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, most: int = CELL_CHARS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words of ``vocabulary`` (word, n; distinct words) at distance one, each once."""
    dealt = cells(vocabulary, most).repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "lo", "hi", "m", "word", "n").mapInArrow(_join, _FIELDS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the last word reached over forms, which are acyclic. Every round doubles the steps taken."""
    hop = tx.checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        up = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = tx.checkpointed(hop.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hop = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return hop


def group_variants(vocabulary: DataFrame, ratio: int = 2, most: int = CELL_CHARS) -> DataFrame:
    """One row for each word of ``vocabulary`` (word, n): word, form, root, n, n_near, form_n.

    n_near: words at distance one. form: that of largest n (ties: the smallest in
    code-point order) if its n is at least ``ratio`` (above 1) times the word's, else null;
    form_n its n. root: the last word reached from form to form, the word itself without a form.
    Rows of one word are added up; null and empty words, and null counts, are
    left out. Words of any length are compared whole. Other columns are
    ignored. An empty table gives an empty one.
    """
    if ratio <= 1:
        raise ValueError("forms may form cycles unless ratio is above 1")
    known = tx.stored(vocabulary.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").alias("n")))
    best = near_words(known, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    found = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    strong = F.col("near_n") >= ratio * F.col("n")
    formed = tx.stored(found.select("word", "n", "n_near", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    rooted = roots(formed.where("form is not null"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, drop: int | None = None) -> DataFrame:
    """Spelling variants (see group_variants) among the words of whole texts with at least ``least_length`` code points and ``least_count`` occurrences.

    Null and empty texts have no words; repeated rows count as often as they
    are there, with one key or several. Extra columns are ignored.
    """
    counts = word_counts(docs, key, text, drop)
    return group_variants(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)))
