"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. For each pattern length m there are a
shift table by the hash of a block of words (how far a window end may move
without skipping an occurrence), and buckets by the block that ends a pattern.
Texts are scanned in many lanes at once: every lane jumps by its own shift, and
where a shift is 0 the bucket's patterns are compared, first by their leading
word, then word by word (64-bit word hashes).

The benchmark is the query set: its patterns are built in blocks of at most
``block_bytes`` of text, each broadcast by itself, and every block is held
against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Words that a lane covers.
LANE = 64
#: Pairs of positions and patterns compared at once.
COMPARE = 1 << 18
#: Slots of a shift table for each distinct block of words, about, and bits of their number at least and at most.
SLOTS_A_BLOCK, LEAST_BITS, MOST_BITS = 16, 12, 24
BLOCK = 3
MULTIPLIER = 0x9E3779B1


@dataclass
class PatternTable:
    """Distinct patterns of one length, with shifts and buckets."""

    m: int
    patterns: np.ndarray  # p x m word numbers
    shift: np.ndarray  # by block slot
    bucket: np.ndarray  # first entry by block slot, in ``members``
    members: np.ndarray
    item_from: np.ndarray  # first entry by pattern, in ``items``
    items: np.ndarray
    bits: int  # of a slot's number


@dataclass
class Patterns:
    """Patterns of a block of the benchmark. ``vocabulary``: sorted hashes of its words; word numbers count from 1."""

    vocabulary: np.ndarray
    known: np.ndarray
    tables: list[PatternTable]
    names: list[str]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words that the block doesn't have."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.known[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _block(ids: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the blocks of ``width`` words that end at ``end``."""
    key = ids[end].astype(np.uint64)
    for back in range(1, width):
        key = key * np.uint64(MULTIPLIER) + ids[end - back].astype(np.uint64)
    key ^= key >> np.uint64(23)
    key *= np.uint64(0x2545F4914F6CDD1D)
    return key


def _slot(ids: np.ndarray, end: np.ndarray, width: int, bits: int) -> np.ndarray:
    return (_block(ids, end, width) >> np.uint64(64 - bits)).astype(np.int64)


def _table(m: int, windows: np.ndarray, owner: np.ndarray) -> PatternTable:
    patterns, which = np.unique(windows, axis=0, return_inverse=True)
    which = which.reshape(-1)
    pairs = np.unique(np.stack([which, owner], 1), axis=0)
    width = min(BLOCK, m)
    flat = np.ascontiguousarray(patterns).reshape(-1)
    first = np.arange(len(patterns)) * m
    blocks = len(np.unique(np.concatenate([_block(flat, first + at, width) for at in range(width - 1, m)])))
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(SLOTS_A_BLOCK * blocks)))))
    shift = np.full(1 << bits, m - width + 1, np.int8 if m < 128 else np.int32)
    for at in range(width - 1, m):  # from the greatest shift to the least, which stays
        shift[_slot(flat, first + at, width, bits)] = m - 1 - at
    slot = _slot(flat, first + m - 1, width, bits)
    members = np.argsort(slot, kind="stable")
    bucket = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount(slot, minlength=1 << bits), out=bucket[1:])
    return PatternTable(m, patterns, shift, bucket, members, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1], bits)


def build_patterns(rows: list[tuple[str, str | None]], window: int) -> Patterns:
    """Windows of ``window`` consecutive words of (item, text) rows; an item of fewer words, but not none, is one window."""
    data, at = tx.text_buffers(pa.array([t for _, t in rows], pa.large_string()))
    _, _, hashes, before = tx.words(data, at, tx.ALNUM)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    number = (number.reshape(-1) + 1).astype(np.int32)
    names, owner = np.unique([str(i) for i, _ in rows], return_inverse=True)
    known = np.zeros(1 << 20, bool)
    known[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    by_length: dict[int, list] = {}
    for k in range(len(rows)):
        own = number[before[k] : before[k + 1]]
        if len(own):
            m = min(window, len(own))
            view = np.lib.stride_tricks.sliding_window_view(own, m)
            by_length.setdefault(m, []).append((view, np.full(len(view), owner[k])))
    tables = [_table(m, np.concatenate([v for v, _ in got]), np.concatenate([o for _, o in got])) for m, got in sorted(by_length.items())]
    return Patterns(vocabulary, known, tables, [str(x) for x in names])


def search(table: PatternTable, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in ``ids`` (numbers; 0 matches nothing): last word and pattern of each."""
    m, width = table.m, min(BLOCK, table.m)
    none = np.zeros(0, np.int64)
    if len(ids) < m:
        return none, none
    at = np.arange(m - 1, len(ids), LANE, dtype=np.int64)
    limit = np.minimum(at + LANE, len(ids))
    stops = []
    while len(at):
        shift = table.shift[_slot(ids, at, width, table.bits)]
        stops.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        go = at < limit
        at, limit = at[go], limit[go]
    stop = np.concatenate(stops)
    slot = _slot(ids, stop, width, table.bits)
    low = table.bucket[slot]
    many = table.bucket[slot + 1] - low
    ends, found = [none], [none]
    edges = np.concatenate([[0], np.cumsum(many)])
    k = 0
    while k < len(stop):  # the pairs of some positions at a time
        to = max(k + 1, int(np.searchsorted(edges, edges[k] + COMPARE, "right")) - 1)
        n = many[k:to]
        end = np.repeat(stop[k:to], n)
        pattern = table.members[np.repeat(low[k:to], n) + np.arange(len(end)) - np.repeat(edges[k:to] - edges[k], n)]
        same = ids[end - (m - 1)] == table.patterns[pattern, 0]
        end, pattern = end[same], pattern[same]
        for j in range(1, m):
            same = ids[end - (m - 1 - j)] == table.patterns[pattern, j]
            end, pattern = end[same], pattern[same]
        ends.append(end)
        found.append(pattern)
        k = to
    return np.concatenate(ends), np.concatenate(found)


def _scan(data: np.ndarray, at: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, ...]:
    """Of some rows: words per row, spans per row, their begins and ends, items per row and their numbers."""
    _, _, hashes, before = tx.words(data, at, tx.ALNUM)
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(before))
    ids = np.zeros(len(hashes) + n, np.int32)  # a 0 after each row keeps windows within rows
    place = np.arange(len(hashes)) + row
    ids[place] = patterns.number(hashes)
    row_of = np.zeros(len(ids), np.int64)
    row_of[place] = row
    edge = np.zeros(len(ids) + 1, np.int32)
    pairs = [np.zeros((0, 2), np.int64)]
    for table in patterns.tables:
        end, pattern = search(table, ids)
        np.add.at(edge, end - (table.m - 1), 1)
        np.add.at(edge, end + 1, -1)
        low = table.item_from[pattern]
        many = table.item_from[pattern + 1] - low
        item = table.items[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        pairs.append(np.unique(np.stack([np.repeat(row_of[end], many), item], 1), axis=0))
    hit = (np.cumsum(edge) > 0).astype(np.int8)
    turn = np.diff(hit, prepend=np.int8(0))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    owner = row_of[begin]
    first = before[:-1] + np.arange(n)  # place of each row's first word
    got = np.unique(np.concatenate(pairs), axis=0)
    return np.diff(before), np.bincount(owner, minlength=n), begin - first[owner], end - first[owner], np.bincount(got[:, 0], minlength=n), got[:, 1]


MADE = ["n_words", "spans", "items"]
TYPES = "n_words bigint, spans array<struct<begin:int,end:int>>, items array<string>"


def _merged(old: list, new: list) -> list:
    out: list = []
    for s in sorted([*old, *new], key=lambda s: s["begin"]):
        if out and s["begin"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with the words that occur in the benchmark.

    Adds n_words (words of the whole text), spans (begin and end, in words, of
    the runs of words inside occurrences of a window) and items (ids, as text,
    of the items with occurring windows, distinct and sorted as text).

    Words are runs of digits, letters A-Z (lower-cased) and characters beyond
    ASCII. Null and empty texts have no words and so no spans. Items without
    words match nothing; repeated items and equal windows count for each item
    id once. An empty benchmark leaves every document without spans. Texts and
    words of any length are read whole, a slice of rows at a time. Rows are
    independent: repeated rows get equal results. Columns of ``docs`` named
    like a result column are replaced by it.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    queries = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null").withColumn("i", F.coalesce("i", F.lit("null")))
    out = docs.select(*tx.others(docs, MADE))
    for k in range(n):
        block = queries.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        out = _with_block(out, spark.sparkContext.broadcast(build_patterns([tuple(r) for r in block], window)), text, first=not k)
    return out


def _with_block(docs: DataFrame, shared, text: str, first: bool) -> DataFrame:
    kept = docs.columns if first else [c for c in docs.columns if c not in MADE]
    which = docs.columns.index(text)
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), TYPES])
    structs = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        names = np.array([*patterns.names, ""], object)
        for batch in batches:
            data, at = tx.text_buffers(batch.column(which))
            got = [_scan(data, at[a : b + 1], patterns) for a, b in tx.slices(at)]
            if not got:
                continue
            n_words, n_spans, begin, end, n_items, items = (np.concatenate(x) for x in zip(*got))
            spans = tx.list_array(pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], fields=list(structs)), n_spans)
            items = tx.list_array(pa.array(names[items], pa.string()), n_items)
            if not first:  # add what earlier blocks have found
                old = batch.select(MADE).to_pydict()
                spans = pa.array([_merged(a, b) for a, b in zip(old["spans"], spans.to_pylist())], pa.list_(structs))
                items = pa.array([sorted({*a, *b}) for a, b in zip(old["items"], items.to_pylist())], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_words, pa.int64()), spans, items], names=[*kept, *MADE])

    return docs.mapInArrow(run, fields)


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """Digest of ``find_overlaps``: n_hit, n_items, items_sha256 and contaminated (words inside occurrences are at least one in ``share``)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["begin"]).cast("bigint"))
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )
