"""Line deduplication by an exact set-similarity join.

A line is the set of its words (runs of digits, letters A-Z lower-cased, and
characters beyond ASCII). A line is removed if an earlier line, in this or an
earlier document, has a set whose Jaccard similarity with it is at least the
threshold. Lines of fewer than ``min_words`` distinct words only go if the sets
are equal and the line's words have ``min_bytes`` bytes or more: in scripts
without spaces a long line is one word.

Equal sets (by two 64-bit hashes) are one class. Classes are joined by prefix
filtering. Words are ordered by rarity: every word's lines are counted, the
KNOWN_WORDS most frequent words are broadcast in the order of their counts, and
all others, which are rarer, come before them in the order of their hashes. Of
two sets of the needed similarity the larger one has a shared word among its
first n - ceil(t n) + 1 (probe), the smaller one among its first
n - ceil(2 t / (1 + t) n) + 1 (index). The rows of these words are dealt out by
word; a word of more than HOT_ROWS lines is split into a grid of cells, in one of
which each pair meets. Where sets meet, the length filter, the positional filter
and a bound on the overlap from 128-bit signatures leave few pairs; a set leaves
with its first few candidates only, as it needs one match. These are verified on
the whole sets. Sets without a match that have more candidates meet all of them
in a second round.

Words are 43-bit hashes, within a word's rows told apart by 32 bits (a clash only
costs a comparison).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: The most frequent words, whose order is broadcast (a bound on the table, not on the words that are joined).
KNOWN_WORDS = 1 << 18
#: Words at most that are in the broadcast table because they are split.
MOST_KNOWN = 1 << 20
#: Candidates by each shared word with which a class leaves the first round.
FIRST_CANDIDATES = 6
#: Lines of a word from which its rows are split into cells of about that many.
HOT_ROWS = 1 << 17
#: Rows of words that are looked at together, about.
BUCKET_ROWS = 1 << 17
#: Pairs that are compared at once.
PAIR_BLOCK = 1 << 17
#: Rows of words, and distinct words, that a task gathers before it passes them on.
GATHER = 1 << 19
#: Slots of the bit maps that tell which classes, words and rows are wanted (a bound on what is broadcast, not on them).
MAP_BITS = 1 << 23
#: Classes of the most lines that are broadcast, so that no task gets all lines of one.
HOT_CLASSES = 1 << 16

#: Bits of a word's hash within a line's set: lines of a slice, words and their ranks are sorted together in 64 bits.
WORD_BITS = 43
LOW = np.uint64((1 << WORD_BITS) - 1)
KEY_BITS = np.uint64(WORD_BITS + 1)
#: Parts that counted words are dealt into, as bits of the hash.
PART_BITS = 12
PROBE, INDEX = 1, 2
#: Columns of a word's rows as they are shipped.
ENTRY = {"word": "u4", "set": "u8", "n": "u4", "place": "u4", "role": "u1", "k": "i8", "line": "i4", "s0": "u8", "s1": "u8"}


def _line_offsets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of the rows within ``at``, and lines per row. A row of n line feeds has n + 1 lines."""
    low, high = int(at[0]), int(at[-1])
    feeds = np.flatnonzero(data[low:high] == 10) + low
    counts = np.searchsorted(feeds, at[1:]) - np.searchsorted(feeds, at[:-1]) + 1
    # a line begins at the row's start and behind each feed; the feed itself stays in the line before it, as no word
    begins = np.sort(np.concatenate([at[:-1], feeds + 1]), kind="stable")
    return np.concatenate([begins, at[-1:]]), counts


def _picked(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the lines with those that aren't wanted empty."""
    some = np.flatnonzero(wanted)
    lines = [data[a:b] for a, b in zip(offsets[some], offsets[some + 1])]
    return np.concatenate([data[:0], *lines]), np.append(0, np.cumsum(np.where(wanted, np.diff(offsets), 0)))


def line_sets(data: np.ndarray, at: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line: line of each word, its hash (of WORD_BITS; sorted by line and hash), lines per row, and by line the sets' two hashes and the bytes of all words.

    ``wanted`` tells of which lines, from the lines per row; the others' words aren't read.
    """
    offsets, counts = _line_offsets(data, at)
    if wanted is not None:
        data, offsets = _picked(data, offsets, wanted(counts))
    _, length, hashes, before = tx.words_by_blocks(data, offsets, tx.ALNUM)
    lines = len(offsets) - 1
    line = np.repeat(np.arange(lines), np.diff(before))
    size = np.bincount(line, weights=length, minlength=lines)
    line, hashes = _sorted_distinct(line, hashes >> np.uint64(64 - WORD_BITS), lines)
    return line, hashes, counts, _set_hashes(line, hashes, lines), size


def _set_hashes(line: np.ndarray, hashes: np.ndarray, lines: int) -> np.ndarray:
    """Two hashes (lines x 2) of each line's set."""
    total = np.zeros((lines, 2), np.uint64)
    if len(line):
        first = np.flatnonzero(np.diff(line, prepend=-1))
        for way, turn in enumerate((1, 1 << 50)):
            total[line[first], way] = np.add.reduceat(tx.mix64(hashes + np.uint64(turn)), first)
    return tx.mix64(total)


def _sorted_distinct(line: np.ndarray, value: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of line and value (below 2 ** (WORD_BITS + 1)), sorted."""
    if lines < 1 << (63 - int(KEY_BITS)):
        key = np.sort((line.astype(np.uint64) << KEY_BITS) | value)
        key = key[np.diff(key, prepend=~key[:1]) != 0]
        return (key >> KEY_BITS).astype(np.int64), key & np.uint64((1 << int(KEY_BITS)) - 1)
    order = np.lexsort((value, line))  # a single text of very many lines
    line, value = line[order], value[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (value[1:] != value[:-1])
    return line[new], value[new]


def shingle_sets(data: np.ndarray, at: np.ndarray, wanted=None, shingle: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``line_sets``, with each whole row as one line and its shingles (runs of ``shingle`` words between white space; all words where there are fewer) as its words."""
    rows = len(at) - 1
    if wanted is not None:
        data, at = _picked(data, at, wanted(np.ones(rows, np.int64)))
    _, length, words, before = tx.words_by_blocks(data, at, tx.SOLID)
    row = np.repeat(np.arange(rows), np.diff(before))
    size = np.bincount(row, weights=length, minlength=rows)
    place, end = np.arange(len(words)), before[1:][row]
    whole = np.zeros(len(words), np.uint64)
    for i, m in enumerate(tx.multipliers(shingle)[:shingle]):
        inside = np.flatnonzero(place + i < end)
        whole[inside] += m * words[inside + i]
    begins = (place + shingle <= end) | (place == before[row])
    row, hashes = _sorted_distinct(row[begins], tx.mix64(whole[begins]) >> np.uint64(64 - WORD_BITS), rows)
    return row, hashes, np.ones(rows, np.int64), _set_hashes(row, hashes, rows), size


def _rows(batches: Iterator[pa.RecordBatch], sets_of, wanted=None):
    """The batches by slices of rows, with the sets of their lines (of those that ``wanted`` tells from keys and numbers)."""
    for batch in batches:
        data, at = tx.text_buffers(batch.column(batch.num_columns - 1))
        k = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in tx.slices(at):
            yield batch, a, b, sets_of(data, at[a : b + 1], wanted and partial(_wanted, wanted, k, a, b))


def _wanted(wanted, k: np.ndarray, a: int, b: int, counts: np.ndarray) -> np.ndarray:
    owner, number = _owners(a, b, counts)
    return wanted(k[owner], number)


def _places(k: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of lines' keys and numbers."""
    return tx.mix64(k.view(np.uint64)) + line.astype(np.uint64)


def _owners(a: int, b: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each line, and its number within the row."""
    owner = np.repeat(np.arange(a, b), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of a and b words: the least o with o / (a + b - o) >= percent / 100."""
    return -(-(percent * (a + b)) // (100 + percent))


def _probe_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def _index_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-2 * percent * n // (100 + percent))) + 1


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, byte by byte (all first bytes, all second bytes, and so on): what hardly varies compresses well."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)


def unpack(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    kinds = [np.dtype(t) for t in types]
    width = sum(t.itemsize for t in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        planes, at = np.frombuffer(blob, np.uint8), 0
        n = len(planes) // width
        for kind, to in zip(kinds, out):
            to.append(np.ascontiguousarray(planes[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
            at += n * kind.itemsize
    return [np.concatenate(x) for x in out]


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    word, n = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(word, kind="stable")
    word, n = word[order], n[order]
    first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
    return word[first], np.add.reduceat(n, first) if len(first) else n


def lines_of(docs: DataFrame, least: int, min_bytes: int, percent: int, sets_of=line_sets, seldom: int = 1) -> DataFrame:
    """The lines that can go, as rows with a set; and, as rows with a part, how many lines have each word.

    Lines: (k, h, line, set, set2), of at least ``least`` distinct words or of
    ``min_bytes`` bytes of words. Parts: (part, words: their hashes and counts, packed,
    and entries: the number of rows of prefix words to come). Words of which
    a task has fewer than ``seldom`` lines aren't counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size, entries = [], [], 0, 0

        def counted():
            word, n = _summed(held, counts)
            often = n >= seldom
            word, n = word[often], n[often]
            edge = np.searchsorted(word, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(WORD_BITS - PART_BITS))
            parts = np.flatnonzero(np.diff(edge))
            blobs = [pack([word[a:b], n[a:b].astype(np.uint32)]) for a, b in zip(edge[parts], edge[parts + 1])]
            none = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(parts.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(len(parts), pa.int64())], names=names)

        names = ["k", "h", "line", "set", "set2", "part", "words", "entries"]
        for batch, a, b, (line, hashes, per_row, sets, bytes_) in _rows(batches, sets_of):
            owner, number = _owners(a, b, per_row)
            n = np.bincount(line, minlength=len(owner))
            entries += int(_probe_length(n[n >= least], percent).sum())
            word, times = np.unique(hashes, return_counts=True)
            held.append(word)
            counts.append(times)
            size += len(word)
            if size > 8 * GATHER:
                one = _summed(held, counts)
                held, counts, size = [one[0]], [one[1]], len(one[0])
                if size > 4 * GATHER:
                    yield counted()
                    held, counts, size = [], [], 0
            keep = np.flatnonzero((n >= least) | (bytes_ >= min_bytes))
            of = pa.array(owner[keep])
            own = [batch.column(0).take(of), batch.column(1).take(of), pa.array(number[keep].astype(np.int32)), *(pa.array(np.ascontiguousarray(sets[keep, w]).view(np.int64)) for w in (0, 1))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(keep), t) for t in (pa.int32(), pa.binary(), pa.int64()))], names=names)
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())), pa.array([entries], pa.int64())], names=names)

    return docs.select("k", "h", "t").mapInArrow(run, "k bigint, h bigint, line int, set bigint, set2 bigint, part int, words binary, entries bigint")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packed rows (second column) of each run of equal keys (first column)."""
    key, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key and blobs:
                yield blobs
                blobs = []
            key = k
            blobs.append(blob.as_py())
    if blobs:
        yield blobs


def word_counts(found: DataFrame) -> DataFrame:
    """(word, n): the words of two lines or more, and their lines, from the parts of ``lines_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _grouped(batches):
            word, n = unpack(blobs, ["u8", "u4"])
            word, n = _summed([word], [n.astype(np.int64)])
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], names=["word", "n"])

    parts = found.where("part is not null").select("part", "words")
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "word bigint, n bigint")


def _highest(table: DataFrame, most: int) -> float:
    """The least of a scale of values of n (16 a power of two) at or above which the table has at most ``most`` rows."""
    level = F.floor(F.log2("n") * 16).alias("level")
    rows, limit = 0, 1 << 10
    for r in sorted(table.groupBy(level).count().collect(), reverse=True):  # at most 1,024 rows
        if rows + r["count"] > most:
            break
        rows, limit = rows + r["count"], r["level"]
    return limit


def known_words(counts: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words by rising count (ties by hash), and into how many cells a side each is split.

    The table has every word that is split: beyond ``hot`` lines, or, of very many words, beyond a 2^20th of all words' lines, so that there are at most MOST_KNOWN of them.
    """
    n_hot, total = counts.agg(F.count_if(F.col("n") > hot), F.sum("n")).first()
    hot = max(hot, -(-(total or 0) // MOST_KNOWN)) if n_hot > KNOWN_WORDS else hot
    least = _highest(counts, KNOWN_WORDS)
    got = counts.where((F.floor(F.log2("n") * 16) >= least) | (F.col("n") > hot)).toPandas()  # at most KNOWN_WORDS and MOST_KNOWN rows
    word, n = got["word"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.lexsort((word, n))
    return word[order], np.maximum(1, -(-n[order] // hot)).astype(np.int32)


class _Prefixes:
    """Prefix words of lines. Words are ordered by rank, those without one before them by hash."""

    def __init__(self, ranked: np.ndarray, cells: np.ndarray, percent: int):
        self.ranked, self.cells, self.percent = ranked, cells, percent
        self.rank = np.argsort(ranked)
        self.hashes = ranked[self.rank]
        self.start = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(WORD_BITS - 20))

    def _ranks(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(WORD_BITS - 20)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(hashes), -1)
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.hashes[at] == hashes[todo]
            out[todo[same]] = self.rank[at[same]]
            go = ~same & (at + 1 < end)
            todo, at, end = todo[go], at[go] + 1, end[go]
        return out

    def of(self, line: np.ndarray, hashes: np.ndarray, lines: int):
        """Sizes of the lines' sets; line, hash, position and rank (-1 for none) of their probe words."""
        size = np.bincount(line, minlength=lines)
        rank = self._ranks(hashes)
        line, key = _sorted_distinct(line, np.where(rank >= 0, np.uint64(1 << WORD_BITS) + rank.astype(np.uint64), hashes), lines)
        place = np.arange(len(line)) - np.searchsorted(line, np.arange(lines))[line]
        take = place < _probe_length(size, self.percent)[line]
        line, key, place = line[take], key[take], place[take]
        rank = np.where(key >> np.uint64(WORD_BITS), key & LOW, 0).astype(np.int64) - (key >> np.uint64(WORD_BITS) == 0)
        hashes = key.copy()
        hashes[rank >= 0] = self.ranked[rank[rank >= 0]]
        return size, line, hashes, place, rank


def signatures(line: np.ndarray, hashes: np.ndarray, lines: int) -> np.ndarray:
    """128-bit signatures (lines x 2): the parity of a line's words by hash. Sets differ in at least as many words as their signatures in bits."""
    out = np.zeros((lines, 2), np.uint64)
    if len(line):
        first = np.flatnonzero(np.diff(line, prepend=-1))
        slot = hashes & np.uint64(127)
        bit = np.uint64(1) << (slot & np.uint64(63))
        for w in (0, 1):
            out[line[first], w] = np.bitwise_xor.reduceat(np.where((slot >> np.uint64(6)) == w, bit, np.uint64(0)), first)
    return out


def in_bitmap(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the values' slots are set in a map that ``bitmap`` made."""
    slot = tx.mix64(values) >> np.uint64(64 - (MAP_BITS.bit_length() - 1))
    return ((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap(values: DataFrame) -> np.ndarray:
    """A bit map of the hashed values of all columns of ``values`` (long): MAP_BITS wide, whatever their number. Where it is full, it tells nothing apart, and more rows are looked at."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.concatenate([c.to_numpy().view(np.uint64) for c in batch.columns])
            slot = np.unique(tx.mix64(value) >> np.uint64(64 - (MAP_BITS.bit_length() - 1)))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["w", "b"])

    got = values.mapInArrow(slots, "w int, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most MAP_BITS / 64 rows
    table = np.zeros(MAP_BITS // 64, np.uint64)
    table[got["w"]] = got["b"].to_numpy(np.int64).view(np.uint64)
    return table


def entries_of(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], percent: int, least: int, buckets: int, sets_of=line_sets) -> DataFrame:
    """(bucket, rows): for each prefix word of each distinct set within a slice of rows a row (ENTRY), packed by bucket of words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # KNOWN_WORDS and MOST_KNOWN ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, cells = shared.value
        prefixes = _Prefixes(ranked, cells, percent)
        held, size = [], 0

        def packed():
            cols = {c: np.concatenate([h[c] for h in held]) for c in ENTRY}
            order = np.argsort(cols["word"], kind="stable")
            cols = [cols[c][order] for c in ENTRY]
            bucket = (cols[0].astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
            at = np.append(np.flatnonzero(np.diff(bucket.view(np.int64), prepend=-1)), len(bucket))
            blobs = [pack([c[a:b] for c in cols]) for a, b in zip(at, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].view(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

        for batch, a, b, (line, hashes, per_row, sets, _) in _rows(batches, sets_of):
            owner, number = _owners(a, b, per_row)
            k = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            # equal sets of a slice: the first line by key and number speaks for all
            order = np.lexsort((number, k, sets[:, 1], sets[:, 0]))
            some = sets[order]
            first = np.zeros(len(owner), bool)
            first[order[np.append(True, (some[1:] != some[:-1]).any(1))[: len(order)]]] = True
            chosen = np.flatnonzero(first & (np.bincount(line, minlength=len(owner)) >= least))
            new = np.full(len(owner), -1)
            new[chosen] = np.arange(len(chosen))
            keep = new[line] >= 0
            line, hashes = new[line[keep]], hashes[keep]
            n, at, word, place, rank = prefixes.of(line, hashes, len(chosen))
            sig = signatures(line, hashes, len(chosen))
            role = np.where(place < _index_length(n, percent)[at], PROBE | INDEX, PROBE).astype(np.uint8)
            word = (word >> np.uint64(WORD_BITS - 32)).astype(np.uint32)
            hot = np.flatnonzero((rank >= 0) & (cells[rank] > 1)) if len(cells) else np.zeros(0, np.int64)
            if len(hot):
                at, word, place, role = _dealt(hot, cells[rank[hot]], at, word, place, role, sets[chosen, 0])
            of = chosen[at]
            held.append({"word": word, "set": sets[of, 0], "n": n[at].astype(np.uint32), "place": place.astype(np.uint32), "role": role, "k": k[of], "line": number[of].astype(np.int32), "s0": sig[at, 0], "s1": sig[at, 1]})
            size += len(word)
            if size >= GATHER:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return docs.select("k", "t").mapInArrow(run, "bucket bigint, rows binary")


def _dealt(hot: np.ndarray, side: np.ndarray, at: np.ndarray, word: np.ndarray, place: np.ndarray, role: np.ndarray, sets: np.ndarray) -> tuple:
    """Rows of hot words dealt into side x side cells: as an index row to a line of cells, as a probe row to a column, so that two rows meet in one cell."""
    mine = tx.mix64(sets[at[hot]] ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    for kind in (INDEX, PROBE):
        of = np.flatnonzero(role[hot] & kind)
        times = side[of].astype(np.int64)
        row = np.repeat(of, times)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        own = (mine[row] % side[row].astype(np.uint64)).astype(np.int64)
        cell = np.where(kind == INDEX, own * side[row] + turn, turn * side[row] + own)
        mixed = tx.mix64((word[hot[row]].astype(np.uint64) << np.uint64(32)) + cell.astype(np.uint64) + np.uint64(1))
        out.append((at[hot[row]], (mixed >> np.uint64(32)).astype(np.uint32), place[hot[row]], np.full(len(row), kind, np.uint8)))
    rest = np.ones(len(at), bool)
    rest[hot] = False
    return tuple(np.concatenate([x[rest], *more]) for x, *more in zip((at, word, place, role), *out))


def _meet(cols: list[np.ndarray], percent: int, most: int | None, only: np.ndarray | None):
    """Candidates among the rows of a bucket: later and earlier row of pairs (numbers), the bits in which they differ, rows that have more candidates, and the rows' columns.

    Of each later row the first ``most`` earlier ones that pass (None: all).
    Rows are grouped by word and by band of sizes, so that similar sets are in the same
    or in neighbouring bands, and sorted by their lines within a group.
    """
    none = np.zeros(0, np.int64)

    def shared(word):
        same = word[1:] == word[:-1]
        return np.append(same, False) | np.insert(same, 0, False)

    order = np.argsort(cols[0], kind="stable")
    order = order[shared(cols[0][order])] if len(order) else order
    word, sets, k, line = (cols[i][order] for i in (0, 1, 5, 6))
    order = order[np.lexsort((line, k, sets, word))]
    if not len(order):
        return none, none, none, none, (cols[0], cols[1], _places(cols[5], cols[6]))
    word, sets = cols[0][order], cols[1][order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (sets[1:] != sets[:-1])))
    role = np.bitwise_or.reduceat(cols[4][order], first)  # of equal sets the earliest speaks for all
    word, sets, n, place, _, k, line, s0, s1 = (c[order[first]] for c in cols)
    n, place = n.astype(np.int64), place.astype(np.int64)
    by_time = np.lexsort((line, k))
    time = np.zeros(len(k), np.int64)
    time[by_time] = np.cumsum(np.append(False, (k[by_time][1:] != k[by_time][:-1]) | (line[by_time][1:] != line[by_time][:-1])))
    band = np.floor(np.log(n) / (1.0001 * np.log(100 / percent))).astype(np.int64) + 1 if percent < 100 else n + 1
    group = (word.astype(np.int64) << 24) + band
    order = np.lexsort((time, group))
    word, sets, n, place, role, k, line, s0, s1, time, group = (x[order] for x in (word, sets, n, place, role, k, line, s0, s1, time, group))
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    kinds = group[begin]
    dense = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(group))))
    placed = (dense << 32) + time
    found, more = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    mine = np.ones(len(n), bool) if only is None else in_bitmap(only, sets)
    probe, index = (role & PROBE) > 0, (role & INDEX) > 0
    later, earlier, off = [none], [none], [none]
    for step in (0, -1, 1):  # partners in the same band, in the one of smaller sets, in the one of larger sets
        able = mine & ~more & (probe if step < 0 else index if step > 0 else True)
        row = np.flatnonzero(able)
        target = group[row] + step
        at = np.minimum(np.searchsorted(kinds, target), len(kinds) - 1)
        row, at = row[kinds[at] == target], at[kinds[at] == target]
        low, high = begin[at], np.searchsorted(placed, (at << 32) + time[row])
        row, low, high = (x[low < high] for x in (row, low, high))
        if most == 0:
            more[row] = True
            continue
        width = 8
        while len(row):
            count = np.minimum(width, high - low)
            edge = np.append(0, np.cumsum(count))
            c = 0
            while c < len(row):  # the pairs of some rows at a time
                to = max(c + 1, int(np.searchsorted(edge, edge[c] + PAIR_BLOCK, "right")) - 1)
                i = np.repeat(np.arange(c, to), count[c:to])
                j = low[i] + np.arange(edge[c], edge[to]) - edge[i]
                i = row[i]
                good = (index[j] & probe[i] & (n[j] <= n[i])) | (index[i] & probe[j] & (n[i] <= n[j]))
                i, j = i[good], j[good]
                need = _needed(n[i], n[j], percent)
                good = np.minimum(n[i] - place[i], n[j] - place[j]) >= need  # from the first shared word on
                good &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j, need = i[good], j[good], need[good]
                bits = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
                good = ((n[i] + n[j] - bits) // 2 >= need) & (sets[i] != sets[j])
                i, j, bits = i[good], j[good], bits[good]
                if most is not None and len(i):
                    start = np.flatnonzero(np.diff(i, prepend=-1))
                    nth = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) + found[i]
                    found[i[start]] += np.diff(np.append(start, len(i)))
                    i, j, bits = i[nth < most], j[nth < most], bits[nth < most]
                later.append(i)
                earlier.append(j)
                off.append(bits)
                c = to
            low = low + count
            if most is not None:
                more[row[found[row] >= most]] = True
            go = (low < high) & ~more[row]
            row, low, high = row[go], low[go], high[go]
            width = min(2 * width, PAIR_BLOCK)
    return np.concatenate(later), np.concatenate(earlier), np.concatenate(off), np.flatnonzero(more), (word, sets, _places(k, line))


def candidates(entries: DataFrame, percent: int, most: int | None, only: np.ndarray | None = None, words: np.ndarray | None = None) -> DataFrame:
    """(later, earlier, later_at, earlier_at, off): candidate pairs of sets, with hashed places of lines that have them; and rows with a word, for sets with more candidates by it than ``most``.

    For these there are also rows with a bucket, which have all rows of their words
    (packed as ``entries``), so that the texts needn't be read again. ``only`` and
    ``words``: bit maps of the later sets and of the words that are wanted.
    """
    shared = entries.sparkSession.sparkContext.broadcast((only, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, words = shared.value
        for blobs in _grouped(batches):
            cols = unpack(blobs, list(ENTRY.values()))
            if words is not None:
                hit = in_bitmap(words, cols[0].astype(np.uint64))
                cols = [c[hit] for c in cols]
            i, j, off, more, (word, sets, place) = _meet(cols, percent, most, only)
            some = np.unique(sets[i] ^ tx.mix64(sets[j]), return_index=True)[1]
            i, j, off = i[some], j[some], off[some]
            own = np.concatenate([i, more])
            nulls = len(more)
            pad = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(nulls, t)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets[own].view(np.int64)), pad(sets[j].view(np.int64), pa.int64()), pa.array(place[own].view(np.int64)), pad(place[j].view(np.int64), pa.int64()), pad(off.astype(np.int32), pa.int32()), pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(word[more].astype(np.int64))]), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary())],
                names=names,
            )
            if nulls:
                again = np.flatnonzero(np.isin(cols[0], word[more]))
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]
                for a in range(0, len(again), GATHER):
                    own = again[a : a + GATHER]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(word[more[:1]].astype(np.int64)), pa.array([pack([c[own] for c in cols])], pa.binary())], names=names)

    names = ["later", "earlier", "later_at", "earlier_at", "off", "word", "bucket", "rows"]
    dealt = entries.select("bucket", "rows").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "later bigint, earlier bigint, later_at bigint, earlier_at bigint, off int, word bigint, bucket bigint, rows binary")


def sets_among(docs: DataFrame, pairs: DataFrame, sets_of=line_sets) -> DataFrame:
    """(set, set2, words): the words of the sets in ``pairs``, one row each.

    Bit maps of the sets and of the lines that have them, of fixed size, go to
    all tasks, so that few lines are cut into words and shuffled.
    """
    chosen = pairs.select(F.explode(F.array("later", "earlier")).alias("set")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(pairs.select("later", "earlier")), bitmap(pairs.select("later_at", "earlier_at"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, places = shared.value
        for _, _, _, (line, hashes, _, sets, _) in _rows(batches, sets_of, lambda k, number: in_bitmap(places, _places(k, number))):
            size = np.bincount(line, minlength=len(sets))
            some = np.flatnonzero((size > 0) & in_bitmap(table, sets[:, 0]))
            hit = np.zeros(len(sets), bool)
            hit[some[np.unique(sets[some], axis=0, return_index=True)[1]]] = True
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(sets[hit, w]).view(np.int64)) for w in (0, 1)), tx.list_array(pa.array(hashes[hit[line]].view(np.int64)), size[hit])], names=["set", "set2", "words"])

    found = docs.select("k", "t").mapInArrow(run, "set bigint, set2 bigint, words array<bigint>")
    return found.join(chosen, "set", "left_semi").groupBy("set", "set2").agg(F.first("words").alias("words"))


def _verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """The pairs' later sets that have a verified earlier match: (set, set2), distinct."""
    a = words.select(F.col("set").alias("later"), "set2", F.col("words").alias("a"))
    b = words.select(F.col("set").alias("earlier"), F.col("words").alias("b"))
    overlap = F.size(F.array_intersect("a", "b"))
    both = pairs.select("later", "earlier").join(a, "later").join(b, "earlier")
    return both.where(100 * overlap >= percent * (F.size("a") + F.size("b") - overlap)).select(F.col("later").alias("set"), "set2").distinct()


def matched_sets(docs: DataFrame, found: DataFrame, percent: int, least: int, sets_of=line_sets) -> DataFrame:
    """(set, set2): the sets whose first line has an earlier line with another set of the needed similarity.

    In turn, on whole sets: of each set its likeliest candidate; of those
    without a match, their other first candidates; of those still without, all the rest.
    Only what is used several times is written down: each file costs an executor on a local disk some processes (chmod).
    """
    known = known_words(tx.stored(word_counts(found)), HOT_ROWS)
    entries = found.agg(F.sum("entries")).first()[0] or 0
    buckets = max(1, -(-int(entries) // BUCKET_ROWS))

    def matched_of(pairs: DataFrame) -> DataFrame:
        sets = tx.stored(sets_among(docs, pairs, sets_of))
        best = pairs.groupBy("later").agg(F.min_by("earlier", F.struct("off", "earlier")).alias("earlier"))
        matched = tx.stored(_verified(best, sets, percent))
        others = pairs.join(matched.select(F.col("set").alias("later")), "later", "left_anti").select("later", "earlier").distinct()
        return matched.unionByName(tx.stored(_verified(others, sets, percent)))  # no set is in both

    first = tx.stored(candidates(entries_of(docs, known, percent, least, buckets, sets_of), percent, FIRST_CANDIDATES))
    tx.release(docs)  # the words' rows, by far the largest shuffle
    matched = matched_of(first.where("word is null and bucket is null"))
    # those that have more candidates and no match yet meet all of them; only their words' rows are dealt out again, as the first round left them
    rest = tx.stored(first.where("word is not null").select(F.col("later").alias("set"), "word").join(matched, "set", "left_anti").distinct())
    if rest.isEmpty():
        return matched
    again = candidates(first.where("bucket is not null"), percent, None, bitmap(rest.select("set")), bitmap(rest.select("word")))
    more = again.join(rest.select(F.col("set").alias("later")).distinct(), "later", "left_semi")
    return matched.unionByName(matched_of(tx.stored(more)))  # no set is in both


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 5, min_bytes: int = 30, sets_of=line_sets, seldom: int = 1) -> DataFrame:
    """(k, h, gone): for each row of which lines go, its key, the hash of its text, and the numbers of those lines (from 0).

    The order of lines: by key (null first), then by number. Lines of rows with
    the same key and number are at the same place: none is earlier.
    ``sets_of``: what a row's lines and their words are; ``seldom``: the lines
    of a task from which a word counts (above 1 where nearly all words are
    unique, so that counting doesn't ship them all; the order is then less exact, the result isn't).
    """
    body = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("t is not null")
    found = tx.stored(lines_of(body, min_words, min_bytes, percent, sets_of, seldom))
    matched = matched_sets(body, found, percent, min_words, sets_of)
    lines = found.where("set is not null").select("k", "h", "line", "set", "set2")
    firsts = lines.groupBy("set", "set2").agg(F.min(F.struct("k", "line")).alias("first"), F.count("*").alias("n"))
    tx.release(docs)
    later = tx.stored(firsts.join(matched.withColumn("also", F.lit(True)), ["set", "set2"], "left").where("n > 1 or also"))
    # the classes of the most lines are broadcast: what is left has few lines a class
    level = F.floor(F.log2("n") * 16)
    least = _highest(later, HOT_CLASSES)
    hot = F.broadcast(later.where(level >= least).select("set", "set2", F.col("first").alias("hot_first"), F.coalesce("also", F.lit(False)).alias("hot_also")))
    marked = lines.join(hot, ["set", "set2"], "left")
    one = marked.where(F.col("hot_first").isNotNull() & (F.col("hot_also") | (F.struct("k", "line") > F.col("hot_first"))))
    other = marked.where("hot_first is null").join(later.where(level < least), ["set", "set2"]).where(F.coalesce("also", F.lit(False)) | (F.struct("k", "line") > F.col("first")))
    gone = one.select("k", "h", "line").unionByName(other.select("k", "h", "line"))
    return gone.distinct().groupBy("k", "h").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 5, min_bytes: int = 30) -> DataFrame:
    """``docs`` with each text less the lines that an earlier line resembles, and n_lines and n_removed.

    ``percent``: the Jaccard similarity of word sets, in percent, from which
    lines match. A line goes if any earlier line matches it, whether or not
    that one goes as well. A line of fewer than ``min_words`` distinct words only
    matches a line of the same words, both with ``min_bytes`` (1 or more) bytes
    of words; without any word it stays. Null texts stay null (0 lines); an empty text has
    one line, which stays. The kept lines are joined by line feeds as before.
    Lines and texts of any length, and of any number of lines, are read whole. The key is a
    whole number (null counts as the least); rows of one key and text lose the
    same lines. An empty table gives an empty one. Columns of ``docs`` named like a result column are replaced.
    """
    gone = removals(docs, key, text, percent, min_words, min_bytes).select(F.col("k").alias("__gk"), F.col("h").alias("__gh"), F.col("gone").alias("__gone"))
    kept = tx.others(docs, ["n_lines", "n_removed"])
    marked = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("__k", F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))).withColumn("__h", F.xxhash64(text))
    joined = marked.join(gone, (F.col("__k") == F.col("__gk")) & (F.col("__h") == F.col("__gh")), "left")
    # the stretches between the lines that go: one pass over the lines, however many go
    begins, ends = F.concat(F.array(F.lit(-1)), F.col("__gone")), lambda lines: F.concat(F.col("__gone"), F.array(F.size(lines)))
    stretches = lambda lines: F.flatten(F.zip_with(begins, ends(lines), lambda a, b: F.slice(lines, a + 2, b - a - 1)))
    left = F.transform(F.array(F.split(F.col(text), "\n", -1)), lambda lines: F.array_join(stretches(lines), "\n"))[0]
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)
    n = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    counted = joined.withColumn("n_lines", n.cast("bigint")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"))
    return counted.withColumn(text, new).select(*kept, "n_lines", "n_removed")
