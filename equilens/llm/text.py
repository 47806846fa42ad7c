"""Shared helpers: Arrow text columns as byte arrays, word hashing, pass-through columns.

Word hashing works on UTF-8 bytes with numpy. A word's 64-bit hash is a
multilinear sum of its bytes with fixed odd multipliers, mixed at the end, so
that it is the same in every process.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.session import shared_folder, stored  # noqa: F401 (the modules here take them from this one)

#: Bytes of text that one numpy pass holds at once (a longer text is a pass of its own).
SLICE_BYTES = 1 << 20
#: Bytes of a word up to which it is hashed by blocks of eight.
BLOCK_BYTES = 64
#: By number of bytes, the mask of a block's first ones.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder of the session.

    Where ``spark.checkpoint.dir`` is unset (tests, notebooks), a folder under
    the warehouse is set, which is shared by definition.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of stages that nothing refers to any more.

    Its cleaner does so when the driver's JVM collects garbage, which a driver
    with little to do puts off while the executors' disks fill.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def others(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` that a result with the columns ``made`` can carry along.

    A column of ``df`` with the name of a result column (in any case) is left out: the result's wins.
    """
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def byte_table(word: bytes, lower: bool = True) -> np.ndarray:
    """For each byte value, itself (A-Z lower-cased) if it belongs to words, else 0."""
    table = np.zeros(256, np.uint8)
    for b in word:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


#: Bytes of words. ALNUM: all but 00-2F, 3A-40, 5B-60 and 7B-7F (capitals become small). SOLID: all but white space 09-0D and 20.
ALNUM = byte_table(bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80))
SOLID = byte_table(bytes(b for b in range(256) if not (9 <= b <= 13 or b == 32)))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_powers = np.zeros(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    """``n`` fixed odd multipliers, one for each byte position in a word."""
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << int(n - 1).bit_length())
        _powers = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def _runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the rows within ``offsets`` as ``table`` has them, begin and length of the words, and the rows' offsets, all counted from offsets[0]."""
    base = int(offsets[0])
    low = np.frombuffer(data[base : int(offsets[-1])].tobytes().translate(table.tobytes()), np.uint8)
    at = offsets - base
    solid = low != 0
    n = len(low)
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < n)]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    begin = np.flatnonzero(starts)
    return low, begin, np.flatnonzero(ends) + 1 - begin, at


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows within ``offsets``: begin, length, hash (uint64), and the number of words before each row (n + 1 values).

    ``begin`` counts from offsets[0]. A word never crosses the end of a row.
    """
    low, begin, length, at = _runs(data, offsets, table)
    if not len(begin):
        return begin, length, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return begin, length, hash_runs(low[low != 0], length), np.searchsorted(begin, at)


def words_by_blocks(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with other hashes, which take eight bytes at a time: steps for each word instead of each byte."""
    low, begin, length, at = _runs(data, offsets, table)
    if not len(begin):
        return begin, length, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return begin, length, hash_blocks(low, begin, length), np.searchsorted(begin, at)


def hash_blocks(low: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``low`` at ``begin`` (bytes other than 0, all of length 1 at least). Runs of up to eight bytes all differ; those of over BLOCK_BYTES have hashes of ``hash_runs``."""
    padded = np.zeros((len(low) + 23) // 8 * 8, np.uint8)
    padded[: len(low)] = low
    blocks = padded.view("<u8")

    def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        got = blocks[place] >> shift
        got |= (blocks[place + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        got &= _MASKS[np.minimum(left, 8)]
        return got

    out = mix64(block(begin, length))
    todo, done = np.flatnonzero((length > 8) & (length <= BLOCK_BYTES)), 8
    while len(todo):
        out[todo] = mix64((out[todo] + np.uint64(0x9E3779B97F4A7C15)) ^ block(begin[todo] + done, length[todo] - done))
        done += 8
        todo = todo[length[todo] > done]
    rest = np.flatnonzero(length > BLOCK_BYTES)
    if len(rest):
        out[rest] = hash_runs(np.concatenate([low[a : a + n] for a, n in zip(begin[rest], length[rest])]), length[rest])
    return out


def hash_runs(packed: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of ``packed`` bytes of the given lengths (all at least 1)."""
    first = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    place = np.arange(len(packed), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), length)
    product = multipliers(int(length.max()))[place]
    product *= packed.astype(np.uint64) + np.uint64(1)
    return mix64(np.add.reduceat(product, first) + length.astype(np.uint64))


def word_features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word, and of each word's first bytes, for each number in ``prefixes`` that is less than its length."""
    begin, length, whole, before = words(data, offsets, table)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    rows, hashes = [row], [whole]
    low = table[data[int(offsets[0]) : int(offsets[-1])]]
    for n in prefixes:
        at = np.flatnonzero(length > n)
        total = np.zeros(len(at), np.uint64)
        factors = multipliers(n)
        for k in range(n):
            total += factors[k] * (low[begin[at] + k].astype(np.uint64) + np.uint64(1))
        rows.append(row[at])
        hashes.append(mix64(total + np.uint64(n << 32)))
    return np.concatenate(rows), np.concatenate(hashes)


class KnownHashes:
    """Numbers of hashes in a sorted list; most strangers are told apart by one look at a bit map."""

    def __init__(self, sorted_hashes: np.ndarray):
        self.hashes = sorted_hashes
        self.known = np.zeros(1 << 20, bool)
        self.known[(sorted_hashes >> np.uint64(44)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of those in the list, and their numbers."""
        maybe = np.flatnonzero(self.known[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe]
        return maybe[same], at[same]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column whose row i has the next counts[i] of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def crc_mod(key: str, n: int):
    """crc32 of the key as text, modulo ``n``; of a null key, null."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def digest_of(text: str):
    """xxhash64 of a text; null for none."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))
