"""A versioned entry table: payloads and vectors in folders that are never changed, and a table of versions that points to one.

A replacement writes a whole new folder and then appends one row to the table
of versions, which is one file that appears at once. A reader looks there
first and reads the newest version's folder: it sees one version, before or
after the replacement, never parts of two. What an interrupted replacement
has written isn't pointed to.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cache as ca
from . import nearest as ne

_VERSION = "version bigint, path string, entries bigint, at timestamp"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """version, path, entries and at of every published version; none where there is no table yet."""
    try:
        return spark.read.schema(_VERSION).json(f"{folder}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _VERSION)


def newest(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and path of the version that readers see (of equal numbers, by two writers at a time, the greater path)."""
    row = versions(spark, folder).agg(F.max(F.struct("version", "path")).alias("v")).first()["v"]
    return (row["version"], row["path"]) if row else None


def publish(entries: DataFrame, folder: str) -> int:
    """Write ``entries`` as a new version and point to it; its number. ``entries`` may read the version before."""
    spark, name = entries.sparkSession, f"v-{uuid.uuid4().hex}"
    entries.write.parquet(f"{folder}/{name}")
    count = spark.read.parquet(f"{folder}/{name}").count()
    before = newest(spark, folder)
    number = before[0] + 1 if before else 1
    row = spark.range(1).select(F.lit(number).cast("bigint").alias("version"), F.lit(name).alias("path"), F.lit(count).cast("bigint").alias("entries"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").json(f"{folder}/versions")
    return number


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the newest version; a frame that goes on reading that version after later ones."""
    found = newest(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/{found[1]}")


def replace(new: DataFrame, folder: str, key: str = "key") -> int:
    """A new version: the entries with the rows of ``new`` in place of those of the same key; its number."""
    spark = new.sparkSession
    if newest(spark, folder) is None:
        return publish(new, folder)
    return publish(ca.upsert(current(spark, folder), new, key), folder)


def rebuilt_index(spark: SparkSession, folder: str, key: str = "key", payload: str = "payload", vector: str = "vector", clusters: int | None = None) -> ne.Index:
    """An index of the newest version's vectors, of entries that have a payload and a vector; the payload comes with it."""
    kept = current(spark, folder).where(F.col(payload).isNotNull() & F.col(vector).isNotNull())
    return ne.index(kept, key, vector, [payload], clusters)
