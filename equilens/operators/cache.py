"""Response caches as tables: exact and similarity probes, upserts, eviction and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearest


def latest(entries: DataFrame, key: str = "key", at: str = "timestamp") -> DataFrame:
    """The newest row of each key (of equally new ones any, the same on reruns)."""
    rest = [c for c in entries.columns if c != key]
    newest = entries.groupBy(key).agg(F.max(F.struct(F.col(at).alias("__at"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])).alias("z"))
    return newest.select(key, *[F.col(f"z.__{i}").alias(c) for i, c in enumerate(rest)]).select(*entries.columns)


def upsert(entries: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``entries`` with the rows of ``new`` in place of those of the same key."""
    return entries.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def probe(requests: DataFrame, entries: DataFrame, key: str = "key", payload: str = "response") -> DataFrame:
    """``requests`` with the payload of the entry of the same key, and hit."""
    found = entries.select(F.col(key).alias("__k"), F.col(payload).alias(payload))
    return requests.join(found, F.col(key) == F.col("__k"), "left").withColumn("hit", F.col("__k").isNotNull()).drop("__k")


def misses(requests: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(entries.select(key), key, "left_anti")


def shard(key: Column) -> Column:
    """The folder that a key's entry is kept in."""
    return F.substring(key, 1, 2)


def normalised(vector: Column) -> Column:
    """A vector at unit length (as doubles); a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, entries: DataFrame, k: int = 5, query_key: str = "query", entry_key: str = "entry", vector: str = "vector", extra: list[str] | tuple = (), clusters: int | None = None, **blocks: int) -> DataFrame:
    """The ``k`` entries of greatest inner product with each query (see ``nearest``): query, entry, similarity, rank and the entries' ``extra`` columns."""
    return nearest.top_k(queries, nearest.index(entries, entry_key, vector, extra, clusters), k, query_key, vector, **blocks)


def semantic_probe(queries: DataFrame, entries: DataFrame, model: str = "model", threshold: float = 0.85, k: int = 5, **keys: str) -> DataFrame:
    """Of each query's top k, the best entry of the same model with at least the threshold's similarity: query, entry, similarity."""
    qk, ek = keys.get("query_key", "query"), keys.get("entry_key", "entry")
    found = top_k(queries, entries.withColumnRenamed(model, "__model"), k, extra=["__model"], **keys).join(queries.select(qk, model), qk)
    ok = found.where((F.col("__model") == F.col(model)) & (F.col("similarity") >= threshold))
    return ok.groupBy(qk).agg(F.min_by(ek, "rank").alias(ek), F.max("similarity").alias("similarity"))


def layered(requests: DataFrame, layers: dict[str, DataFrame], key: str = "key", payload: str = "response", similar: DataFrame | None = None, request: str = "query") -> DataFrame:
    """Probe layers in order: the payload of the first that has the key, and hit_kind (its name, or miss).

    ``similar``: what a semantic probe found (``request``, payload), for the requests that no layer has: hit_kind is semantic.
    """
    out = requests
    for i, (_, layer) in enumerate(layers.items()):
        out = out.join(layer.select(F.col(key), F.col(payload).alias(f"__p{i}"), F.lit(True).alias(f"__h{i}")), key, "left")
    kind, value = F.lit("miss"), F.lit(None).cast("string")
    if similar is not None:
        out = out.join(similar.select(F.col(request), F.col(payload).alias("__ps"), F.lit(True).alias("__hs")), request, "left")
        kind, value = F.when(F.col("__hs"), "semantic").otherwise(kind), F.when(F.col("__hs"), F.col("__ps")).otherwise(value)
    for i, name in reversed(list(enumerate(layers))):
        kind, value = F.when(F.col(f"__h{i}"), name).otherwise(kind), F.when(F.col(f"__h{i}"), F.col(f"__p{i}")).otherwise(value)
    return out.withColumn("hit_kind", kind).withColumn(payload, value).drop(*[f"__{x}{i}" for i in (*range(len(layers)), "s") for x in "ph"])


def stored_locally(local: DataFrame, remote_hits: DataFrame, key: str = "key") -> DataFrame:
    """The local layer with the entries that a remote one had for keys that were asked for."""
    return upsert(local, remote_hits.select(*local.columns).dropDuplicates([key]), key)


def rebuilt(entries: DataFrame, key: str = "key", payload: str = "response", at: str = "timestamp") -> DataFrame:
    """An index rebuilt from stored entries: the newest row of each key that has a payload, with its size in bytes (file_size)."""
    return latest(entries.where(F.col(payload).isNotNull()), key, at).withColumn("file_size", F.octet_length(F.col(payload).cast("string")).cast("bigint"))


def warm(entries: DataFrame, n: int, at: str = "last_accessed", key: str = "key") -> DataFrame:
    return entries.orderBy(F.col(at).desc(), F.col(key)).limit(n)


def touched(entries: DataFrame, touches: DataFrame, key: str = "key") -> DataFrame:
    """``entries`` with access_count and last_accessed moved on by ``touches`` (key, at)."""
    t = touches.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"), F.max("at").alias("__at"))
    j = entries.join(t, F.col(key) == F.col("__k"), "left")
    return j.withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "__at")).select(*entries.columns)


def evicted(entries: DataFrame, now: Column, days: int = 30, at: str = "timestamp") -> DataFrame:
    """Entries not older than ``days``."""
    return entries.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def size_report(entries: DataFrame, size: str = "file_size") -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def hit_rates(counts: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """From hits, misses, semantic_hits and distributed_hits: ``by`` and three rates over hits and misses (semantic hits aren't in the denominator)."""
    total = F.greatest(F.lit(1), F.col("hits") + F.col("misses"))
    return counts.select(*by, (F.col("hits") / total).alias("hit_rate"), (F.col("semantic_hits") / total).alias("semantic_rate"), (F.col("distributed_hits") / total).alias("distributed_rate"))


def usage_profile(entries: DataFrame) -> DataFrame:
    return entries.groupBy("access_count").agg(F.count("*").alias("entries")).orderBy(F.col("access_count").desc())


def model_profile(entries: DataFrame) -> DataFrame:
    return entries.groupBy("model").agg(F.avg("cost").alias("mean_cost"), F.sum("file_size").alias("bytes"))


def text_vectors(docs: DataFrame, text: str, features: int = 1000):
    """TF-IDF vectors (hashed, ``features`` wide, unit length) and the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer

    stages = [Tokenizer(inputCol=text, outputCol="__w"), HashingTF(numFeatures=features, inputCol="__w", outputCol="__tf"), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="vector")]
    model = Pipeline(stages=stages).fit(docs)
    return model.transform(docs).drop("__w", "__tf", "__idf"), model
