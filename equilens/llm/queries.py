"""The dealt operators as queries over the driver tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, toxicity, warc
from .decontaminate import contamination, find_overlaps
from .fim import fill_in_middle, restore
from .imatch import fingerprints_with_edits
from .language import identify, learn
from .licenses import scan_licenses
from .linededup import dedup_lines
from .mixing import mix_sources
from .neardup import near_duplicates
from .spelling import spelling_variants
from .text import crc_mod, digest_of, shared_folder
from .tokens import count_tokens
from .urls import Rule, host_of, judge_urls


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word windows of the benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, read(spark, sf_dir, "benchmark"))
    return contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
    samples = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), samples).drop("phrases")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from the labels of the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    labels = read(spark, sf_dir, "labels").where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.train(docs.where(~F.col("held_out")).withColumn("digest", digest_of("text")).join(labels, "doc_id", "left"), digest="digest")
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by the SentencePiece model."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, str(public_tokenizers.path("piece_bpe_32k.model")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that an earlier line resembles, and the digest of what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document so that the sources come to their targets."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of each document and its edited text, and their likeness."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints_with_edits(docs)


#: The query's rules, as given.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each page's url. Outcomes: a page is bad if the label of its number says toxic or low quality."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    outcomes = pages.join(labels, "page_id").select(host_of(F.col("url")).alias("host"), "bad")
    return judge_urls(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, read back, in the order of their merged index."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)) % 31536000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = warc.archive(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", at=at)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "place", "capture")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, of which one run in 97 loses a letter."""
    return spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"), drop=97)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of each document and their places, and labels of notices that stand in it up to few words."""
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of each document, the digest of its output, and of the text rebuilt from that."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return restore(fill_in_middle(docs)).select(*made, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language": op2_language,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_imatch": op8_imatch,
    "op9_url_filter": op9_url_filter,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_license_scan": op12_license_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {k: v for k, v in oracles.ORACLES.items() if k in QUERIES}
