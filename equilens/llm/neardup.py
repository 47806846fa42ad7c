"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is read as two halves of 32 bits. Fingerprints that differ
in at most 3 bits differ in at most one bit in one of the halves. The anchors
of a half are a covering code: the perfect Hamming code of 31 bits (every word
is within 1 bit of one code word), with the 32nd bit as it is. Each fingerprint
is replicated, for each half, to every anchor within the covering radius plus
the half's threshold (1 + 1 = 2 bits, at most 17 anchors), and the fingerprints
of an anchor are compared with each other. Two fingerprints whose half differs
in at most one bit share the anchor that is nearest to either of them.

Equal fingerprints are one node. Anchors are dealt out by hash; what is at one
anchor is compared in blocks of bounded size, and only links that join parts of
an anchor are passed on, never all pairs. Components come from rounds of
joins with shrinking edges (each node takes its least neighbour as its root,
edges move to roots), checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Fingerprints at an anchor that are compared at once; larger anchors are compared block by block.
ANCHOR_BLOCK = 1024


def fingerprints(column: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    """SimHash of each text (uint64): bit set if set in over half of the shingles' XXH64 values."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, at = tx.text_buffers(column)
    out = np.zeros(len(at) - 1, np.uint64)
    to = bytes.maketrans(bytes(range(9, 14)) + bytes(range(65, 91)), b" " * 5 + bytes(range(97, 123)))
    for i in range(len(out)):
        words = data[at[i] : at[i + 1]].tobytes().translate(to).split()
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= shingle:
            hashes = np.array([digest(joined, seed)], np.uint64)
        else:
            edge = np.zeros(n + 1, np.int64)
            np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=edge[1:])
            begin, end = edge[: n - shingle + 1].tolist(), (edge[shingle:] - 1).tolist()
            hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(begin, end)], np.uint64, n - shingle + 1)
        out[i] = majority(hashes)
    return out


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0]


def simhash(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with fp (the fingerprint as a signed long; 0 for texts without words)."""
    kept = [c for c in tx.others(docs, ["fp"]) if c != text]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(len(kept)), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text")).mapInArrow(run, fields)


def _pairs_by_syndrome() -> np.ndarray:
    """For each syndrome of the Hamming code (bit positions count from 1), the masks of at most two bits that lead to a code word; 0 fills up."""
    out = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        masks = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s <= 31]
        out[s, : len(masks)] = masks
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within 2 bits of each 32-bit half: row number and anchor, distinct."""
    low = half & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros(len(half), np.int64)
    for i in range(31):
        syndrome ^= np.where((low >> np.uint32(i)) & np.uint32(1), i + 1, 0)
    masks = _pairs_by_syndrome()[syndrome]
    first = np.arange(16) == 0
    use = (masks != 0) | (first & (syndrome == 0)[:, None])
    row, k = np.nonzero(use)
    near = half[row] ^ masks[row, k]
    own = half ^ masks[:, 0] ^ np.uint32(1 << 31)  # the nearest code word, with the 32nd bit turned
    return np.concatenate([row, np.arange(len(half))]), np.concatenate([near, own])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for which in (0, 1):
            half = (fp >> np.uint64(32 * which)).astype(np.uint32)
            for a in range(0, len(fp), 1 << 15):
                row, anchor = anchors(half[a : a + (1 << 15)])
                key = anchor.astype(np.int64) | (which << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[a + row].view(np.int64))], names=["anchor", "fp"])


def _close(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= threshold


def _links(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within anchors (rows sorted by anchor): the closest later partners first, as a spanning forest of each anchor."""
    left, right = [], []
    edge = np.flatnonzero(np.diff(anchor)) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([begin, [len(anchor)]]))
    small = np.repeat(size <= 16, size)
    for d in range(1, 16):  # small anchors: all rows against the d-th next
        same = small[:-d] & (anchor[:-d] == anchor[d:]) if len(anchor) > d else np.zeros(0, bool)
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[_close(fp[at], fp[at + d], threshold)]
        left.append(fp[at])
        right.append(fp[at + d])
    for b, n in zip(begin[size > 16], size[size > 16]):
        x, y = _forest(fp[b : b + n], threshold)
        left.append(x)
        right.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one anchor's fingerprints, found breadth first: each found node is compared once with those not yet reached."""
    rest, left, right = fp, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            new = []
            for a in range(0, len(front), ANCHOR_BLOCK):
                some = front[a : a + ANCHOR_BLOCK]
                via = np.full(len(rest), -1, np.int64)
                for b in range(0, len(rest), ANCHOR_BLOCK):
                    near = _close(some[:, None], rest[None, b : b + ANCHOR_BLOCK], threshold)
                    via[b : b + ANCHOR_BLOCK] = np.where(near.any(0), near.argmax(0), -1)
                hit = via >= 0
                left.append(some[via[hit]])
                right.append(rest[hit])
                new.append(rest[hit])
                rest = rest[~hit]
                if not len(rest):
                    break
            front = np.concatenate(new)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last anchor of a batch waits for the next one, in parts that are joined once."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(a, f):
            x, y = _links(a, f, threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x.view(np.int64), y.view(np.int64))), pa.array(np.maximum(x.view(np.int64), y.view(np.int64)))], names=["u", "v"])

        for batch in batches:
            a, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(a):
                continue
            cut = int(np.searchsorted(a, a[-1], "left"))
            if cut or (held and held[0][0][0] != a[-1]):
                held.append((a[:cut], f[:cut]))
                yield emit(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((a[cut:], f[cut:]))
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(nodes: DataFrame, threshold: int = 3) -> DataFrame:
    """Links u < v between the distinct fingerprints ``fp`` of ``nodes`` that differ in at most ``threshold`` (3) bits.

    Not all pairs: of each anchor a spanning forest, so that the components are those of all pairs.
    """
    if threshold > 3:
        raise ValueError("two halves with radius-1 anchors cover at most 3 differing bits")
    replicas = nodes.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint")
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(threshold), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (u, v), for every node with an edge.

    Rounds: each node looks at its least neighbour or itself; roots are
    followed to their own roots; edges move to roots and edges within a root
    go. Work is proportional to the edges left, which fall by a constant
    factor or more a round.
    """
    edges = tx.checkpointed(edges.where("u <> v"))
    mapping = None
    while not edges.isEmpty():  # every round merges each node that has an edge
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root"))
        # roots point to smaller nodes only: follow them until all have arrived
        hop = tx.checkpointed(least)
        while True:
            up = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = tx.checkpointed(hop.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            hop = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        mapping = hop if mapping is None else tx.checkpointed(
            mapping.join(hop.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        )
        a = hop.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hop.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = tx.checkpointed(edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    return mapping if mapping is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 3) -> DataFrame:
    """``docs`` without its text, with fp and component_id: the smallest key reachable over links.

    Fingerprints link at ``threshold`` or fewer differing bits; equal ones
    always link. Texts without words have fingerprint 0 and link like others.
    Fewer words than a shingle make one shingle of the whole sequence. Rows
    with a null key belong to components, but a component's id is its smallest
    non-null key (null if it has none). The key is any type with an order. Texts of any length are
    read whole. Repeated rows stay, with equal results. An empty table gives an empty one; columns
    of ``docs`` named like a result column are replaced.
    """
    marked = tx.checkpointed(simhash(docs.select(*[F.col(f"`{c}`") for c in tx.others(docs, ["fp", "component_id"])]), text, shingle))
    nodes = tx.checkpointed(marked.groupBy("fp").agg(F.min(key).alias("least")))
    found = components(links(nodes, threshold))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(of, "fp")


def losers(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 3) -> DataFrame:
    """(k, h): key and xxhash64 of the text of the rows that aren't the one of the smallest key in their near-duplicate group."""
    keyed = docs.select(key, F.xxhash64(text).alias("__h"), text)
    found = near_duplicates(keyed, key, text, shingle, threshold)
    return found.where(F.col(key).isNotNull() & (F.col(key) > F.col("component_id"))).select(F.col(key).alias("k"), F.col("__h").alias("h")).distinct()


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows of the keys and texts in ``gone`` (k, h). That table is written down first: Spark broadcasts it if it is small, and shuffles both sides otherwise."""
    rows = tx.stored(gone).select(F.col("k").alias("__k"), F.col("h").alias("__lh"))
    return docs.withColumn("__h", F.xxhash64(text)).join(rows, (F.col(key) == F.col("__k")) & (F.col("__h") == F.col("__lh")), "left_anti").drop("__h")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest key (of repeated keys, each text once; of groups without a key, each row)."""
    return without(docs, losers(docs, key, text, shingle, threshold), key, text)

