"""Exact top-k by inner product over clustered entries.

Entries are dealt to the nearest of at most MOST_CLUSTERS pivots and written down
by cluster. Of a cluster, its pivot p, the largest distance R and angle a of an
entry from it, and the largest length are known; a query q can reach at most the lesser of
q.p + |q| R and |q| times that length times the cosine of (angle of q and p, less a).
Each query first visits the clusters whose pivots suit it best, until they have
``k`` entries; then only those whose bound isn't below its k-th similarity so
far. So no entry that could be among the best is left out, whatever the data; how much
is skipped depends on how well they cluster.

A query set of bounded size is broadcast, and entries aren't shuffled. A larger
one meets the entries by cluster, in cells of a block of queries and a block of entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.session import stored

#: Pivots at most, entries of a cluster aimed at, and rows looked at for each pivot.
MOST_CLUSTERS, CLUSTER_ROWS, LOOKED_AT = 1024, 2000, 8
#: Bytes of query vectors (as doubles) up to which they are broadcast.
BROADCAST_BYTES = 1 << 25
#: Candidates that a task holds before it drops those that aren't the best of their query.
HELD = 200_000
#: Bounds below a similarity by less than this are looked at: it covers rounding.
SLACK = 1e-9


class Index(NamedTuple):
    """``entries``: key, __v, extra columns and __cluster, written down; ``pivots`` and the rest: an array row or number for each cluster."""

    entries: DataFrame
    key: str
    extra: list[str]
    pivots: np.ndarray
    counts: np.ndarray
    distances: np.ndarray
    angles: np.ndarray
    lengths: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def _angles(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angles of every row of ``v`` and every row of ``p``; a zero vector has none, and is put at 0."""
    size = _lengths(v)[:, None] * _lengths(p)[None, :]
    return np.where(size > 0, np.arccos(np.clip((v @ p.T) / np.where(size > 0, size, 1), -1, 1)), 0.0)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def index(entries: DataFrame, key: str = "entry", vector: str = "vector", extra: list[str] | tuple = (), clusters: int | None = None) -> Index:
    """Entries with a vector, clustered. All vectors have one length. Pivots are chosen from a bounded sample by the keys' hash; every entry is indexed."""
    rows = entries.where(F.col(vector).isNotNull()).select(key, *extra, F.col(vector).cast("array<double>").alias("__v"))
    wanted = clusters or min(MOST_CLUSTERS, max(1, -(-rows.count() // CLUSTER_ROWS)))
    sample = rows.orderBy(F.xxhash64(key), key).limit(LOOKED_AT * wanted).select("__v").toArrow().column(0).combine_chunks()
    pivots = _pivots(_matrix(sample), wanted) if len(sample) else np.zeros((1, 0))
    own = np.einsum("ij,ij->i", pivots, pivots)
    names = rows.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(len(names) - 1))
                near = (own[None, :] - 2 * (v @ pivots.T)).argmin(1)
                apart = v - pivots[near]
                angle = _angles_of_rows(v, pivots[near])
                more = [pa.array(near.astype(np.int32)), pa.array(_lengths(apart)), pa.array(angle), pa.array(_lengths(v))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "__cluster", "__d", "__a", "__s"])

    fields = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "__cluster int, __d double, __a double, __s double"])
    dealt = rows.mapInArrow(deal, fields)
    # by ranges of cluster and hash: a large cluster is many files, and files tell which clusters they have
    kept = stored(dealt.withColumn("__h", F.xxhash64(key)).repartitionByRange("__cluster", "__h").sortWithinPartitions("__cluster", "__h").drop("__h"))
    about = kept.groupBy("__cluster").agg(F.count("*").alias("n"), F.max("__d").alias("d"), F.max("__a").alias("a"), F.max("__s").alias("s")).collect()  # one row a pivot
    table = np.zeros((4, len(pivots)))
    for r in about:
        table[:, r["__cluster"]] = r["n"], r["d"], r["a"], r["s"]
    return Index(kept.drop("__d", "__a", "__s"), key, list(extra), pivots, table[0].astype(np.int64), *table[1:])


def _angles_of_rows(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    size = _lengths(v) * _lengths(p)
    return np.where(size > 0, np.arccos(np.clip(np.einsum("ij,ij->i", v, p) / np.where(size > 0, size, 1), -1, 1)), np.pi)


def bounds(queries: np.ndarray, ix: Index) -> np.ndarray:
    """The greatest inner product that each query can have with an entry of each cluster (minus infinity for empty ones)."""
    if not ix.pivots.shape[1]:  # no entries
        return np.full((len(queries), len(ix.counts)), -np.inf)
    size = _lengths(queries)[:, None]
    by_distance = queries @ ix.pivots.T + size * ix.distances[None, :]
    between = np.maximum(0.0, _angles(queries, ix.pivots) - ix.angles[None, :])
    cosine = np.cos(np.minimum(between, np.pi))
    by_angle = size * np.where(cosine > 0, ix.lengths[None, :] * cosine, 0.0)  # an entry may be short: below a right angle only
    return np.where(ix.counts[None, :] > 0, np.minimum(by_distance, by_angle), -np.inf)


def first_visits(queries: np.ndarray, ix: Index, k: int) -> np.ndarray:
    """Whether each query visits each cluster at first: those of the greatest products with their pivots, until they have ``k`` entries."""
    counts = ix.counts
    if not ix.pivots.shape[1]:
        return np.zeros((len(queries), len(counts)), bool)
    near = queries @ ix.pivots.T
    order = np.argsort(-near, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out & (counts > 0)[None, :]


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that are among a row's best ``k`` (ties with the last too) and not below ``least``."""
    rough = np.round(scores, 12)
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(rough, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return np.nonzero(rough >= least[:, None])


def _top(found: pd.DataFrame, by: str, key: str, k: int) -> pd.DataFrame:
    ordered = found.assign(__r=-found["similarity"].round(12)).sort_values([by, "__r", key], kind="stable").drop(columns="__r")
    return ordered[ordered.groupby(by).cumcount() < k]


def _scan(ix: Index, queries: np.ndarray, visits: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """Each query's best ``k`` entries of the clusters that it visits, and of a task: __query (its number), key, extra columns, similarity. Broadcast: the queries."""
    spark = ix.entries.sparkSession
    sent = spark.sparkContext.broadcast((queries, visits, least))
    rest = [ix.key, *ix.extra]
    kinds = dict(ix.entries.dtypes)
    fields = ", ".join(["__query int", *(f"`{c}` {kinds[c]}" for c in rest), "similarity double"])
    key = ix.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, seen, floor = sent.value
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(0).to_numpy()
            v, names = _matrix(batch.column(1)), batch.select(rest).to_pandas()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1, [len(cluster)]])
            for a, b in zip(edge[:-1], edge[1:]):
                who = np.flatnonzero(seen[:, cluster[a]])
                for at in range(0, len(who), 256):
                    some = who[at : at + 256]
                    scores = q[some] @ v[a:b].T
                    i, j = _best(scores, floor[some], k)
                    held.append(names.iloc[a + j].assign(__query=some[i].astype(np.int32), similarity=scores[i, j]))
                    if sum(map(len, held)) > HELD:
                        held = [_top(pd.concat(held), "__query", key, k)]
        if held:
            out = _top(pd.concat(held), "__query", key, k)
            yield pa.RecordBatch.from_pandas(out[["__query", *rest, "similarity"]], preserve_index=False)

    wanted = [int(c) for c in np.flatnonzero(visits.any(0))]
    read = ix.entries.where(F.col("__cluster").isin(wanted)) if wanted else ix.entries.limit(0)
    return read.select("__cluster", "__v", *rest).mapInArrow(run, fields)


def _cells(ix: Index, queries: DataFrame, query_key: str, visits: DataFrame, k: int, query_block: int, entry_block: int) -> DataFrame:
    """The same for queries of any number: ``visits`` (query, __v, __cluster, __least) meet the entries of their clusters in cells of two blocks."""
    asked = {r["__cluster"]: r["n"] for r in visits.groupBy("__cluster").agg(F.count("*").alias("n")).collect()}  # at most one row a pivot
    blocks = ix.entries.sparkSession.createDataFrame([(int(c), max(1, -(-int(asked[c]) // query_block)), max(1, -(-int(ix.counts[c]) // entry_block))) for c in sorted(asked)], "__cluster int, __nq int, __ne int")
    deal = lambda df, key, own, many, other, others: df.join(F.broadcast(blocks), "__cluster").withColumn(own, F.pmod(F.xxhash64(key), F.col(many)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("__nq", "__ne")
    q = deal(visits, query_key, "__q", "__nq", "__e", "__ne")
    e = deal(ix.entries, ix.key, "__e", "__ne", "__q", "__nq")
    rest, cell = [ix.key, *ix.extra], ["__cluster", "__q", "__e"]
    kinds = {**dict(ix.entries.dtypes), **dict(queries.dtypes)}
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in (query_key, *rest)), "similarity double"])
    key = ix.key

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in (query_key, *rest, "similarity")})
        v, names, found = np.stack(right["__v"].to_numpy()), right[rest], []
        for at in range(0, len(left), 256):
            some = left.iloc[at : at + 256]
            scores = np.stack(some["__v"].to_numpy()) @ v.T
            i, j = _best(scores, some["__least"].to_numpy(), k)
            found.append(_top(names.iloc[j].assign(**{query_key: some[query_key].to_numpy()[i], "similarity": scores[i, j]}), query_key, key, k))
        return pd.concat(found)[[query_key, *rest, "similarity"]]

    return q.groupBy(*cell).cogroup(e.groupBy(*cell)).applyInPandas(run, fields)


def _visits(ix: Index, queries: DataFrame, query_key: str, k: int, first: bool) -> DataFrame:
    """(query, __v, __cluster, __least) of the first visits, or of those that ``queries``' __least still allows."""
    kind = dict(queries.dtypes)[query_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                least = part.column(2).to_numpy()
                q = _matrix(part.column(1))
                bound, mine = bounds(q, ix_), first_visits(q, ix_, k)
                row, cluster = np.nonzero(mine if first else ~mine & (bound >= least[:, None] - SLACK))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cluster.astype(np.int32)), pa.array(least[row])], names=[query_key, "__v", "__cluster", "__least"])

    ix_ = ix._replace(entries=None)
    return queries.select(query_key, "__v", "__least").mapInArrow(run, f"`{query_key}` {kind}, __v array<double>, __cluster int, __least double")


def top_k(queries: DataFrame, ix: Index, k: int = 5, query_key: str = "query", vector: str = "vector", query_block: int = 1024, entry_block: int = 20_000) -> DataFrame:
    """The ``k`` entries of greatest inner product with each query: query, entry, similarity, rank and the entries' extra columns.

    The queries are a stated set with distinct keys; those with a null vector are left out. Similarities
    equal to twelve places are ordered by the entries' keys.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(query_key, F.col(vector).cast("array<double>").alias("__v"))
    width = max(1, ix.pivots.shape[1])
    some = asked.limit(BROADCAST_BYTES // (8 * width) + 1).toArrow()  # bounded: whether they are few is seen by asking for one more
    rest = [ix.key, *ix.extra]
    if some.num_rows * 8 * width <= BROADCAST_BYTES:
        q = _matrix(some.column(1).combine_chunks()) if some.num_rows else np.zeros((0, width))
        found, _, _ = _few(ix, q, k)
        names = asked.sparkSession.createDataFrame(some.select([query_key]).append_column("__query", pa.array(np.arange(len(q)), pa.int32())))
        out = found.join(F.broadcast(names), "__query").select(query_key, *rest, "similarity")
    else:
        begun = asked.withColumn("__least", F.lit(float("-inf")))
        first = stored(_cells(ix, asked, query_key, _visits(ix, begun, query_key, k, True), k, query_block, entry_block))
        kth = _ranked(first, query_key, ix.key, k).groupBy(query_key).agg(F.when(F.count("*") >= k, F.round(F.min("similarity"), 12)).alias("__l"))
        known = asked.join(kth, query_key, "left").select(query_key, "__v", F.coalesce("__l", F.lit(float("-inf"))).alias("__least"))
        out = first.unionByName(_cells(ix, asked, query_key, stored(_visits(ix, known, query_key, k, False)), k, query_block, entry_block))
    return _ranked(out, query_key, ix.key, k).select(query_key, *rest, "similarity", "rank")


def _ranked(found: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    order = [F.round("similarity", 12).desc(), F.col(key)]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("rank") <= k)


def _few(ix: Index, q: np.ndarray, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Candidates of a broadcast query set in two scans, and which clusters each query visited in the first and in the second."""
    bound, mine = bounds(q, ix), first_visits(q, ix, k)
    first = stored(_scan(ix, q, mine, np.full(len(q), -np.inf), k))
    least = np.full(len(q), -np.inf)
    for r in _ranked(first, "__query", ix.key, k).groupBy("__query").agg(F.count("*").alias("n"), F.round(F.min("similarity"), 12).alias("s")).collect():  # one row a query, which are few
        if r["n"] >= k:
            least[r["__query"]] = r["s"]
    more = ~mine & (bound >= least[:, None] - SLACK)
    return first.unionByName(_scan(ix, q, more, least, k)), mine, more


def pruning(queries: DataFrame, ix: Index, k: int = 5, query_key: str = "query", vector: str = "vector") -> DataFrame:
    """Of each query of a set that is broadcast: clusters visited at first and later, and the share of all entries that it was compared with."""
    some = queries.where(F.col(vector).isNotNull()).select(query_key, F.col(vector).cast("array<double>").alias("__v")).toArrow()
    if some.nbytes > BROADCAST_BYTES:
        raise ValueError("too many queries for a report")
    _, mine, more = _few(ix, _matrix(some.column(1).combine_chunks()), k)
    compared = ((mine | more) * ix.counts[None, :]).sum(1)
    table = some.select([query_key]).append_column("first", pa.array(mine.sum(1))).append_column("later", pa.array(more.sum(1))).append_column("compared", pa.array(compared))
    return queries.sparkSession.createDataFrame(table).withColumn("share", F.col("compared") / float(max(1, ix.counts.sum())))
