"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm import toxicity
from equilens.llm.decontaminate import contamination, find_overlaps
from equilens.llm.linededup import dedup_lines, removals, shingle_sets
from equilens.llm.mixing import mix_sources
from equilens.llm.neardup import losers, without
from equilens.llm.queries import read
from equilens.llm.text import crc_mod, digest_of, shared_folder

#: Columns of documents, and of what all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. The classifier learns from the documents that op5 doesn't hold out, with and without a label."""
    labels = read(spark, sf_dir, "labels").where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mine = docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))).select("doc_id", "text", digest_of("text").alias("digest"))
    model = toxicity.train(mine.join(labels, "doc_id", "left"), digest="digest")
    scored = toxicity.score(docs.select(*COLUMNS, F.col("text").alias("scored_text")), model, text="scored_text")
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that resemble an earlier line go, and documents of which nothing but white space is left."""
    left = dedup_lines(docs.select(*COLUMNS))
    gone = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = left.where(~gone)
    # n_chars follows the text; where no line went it stays as it was
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (five-word shingles, at most 3 differing bits) the document of the smallest id stays, unless a document of a smaller id has shingles of Jaccard similarity 0.8 or more (an exact join)."""
    alike = removals(docs.where("doc_id is not null").select("doc_id", "text"), min_words=1, sets_of=shingle_sets, seldom=2).select("k", "h")
    return without(docs.select(*COLUMNS), losers(docs.select("doc_id", "text"), shingle=5).unionByName(alike).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words at least one in twenty lies inside an occurrence of a benchmark window."""
    found = contamination(find_overlaps(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document so that sources come to their targets: doc_id, source, size, source_size, target, copies and taken."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: SQL can't express the classifier or the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None
