"""License scans by diagonal voting, in DataFrame operations only.

Templates (phrases and notices) and documents are sequences of words. All
rolling word k-gram hashes of the documents are joined with the templates' gram
positions; a hit that its words confirm is a vote for the diagonal (place in
the document less place in the template). A template that stands in a document
as it is has all its votes on one diagonal; a word more or less shifts the
votes behind it to a neighbour. So votes are gathered by diagonal, as bits by
place in the template, diagonals within ``slack`` are merged, and a span is
verified by the share of the template's words that its confirmed grams cover.

A phrase (``base``) counts only where it stands as it is; each place counts.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx

#: Words of a gram; of templates with fewer words, all of them.
GRAM = 3
#: Words of a piece of a template: its grams' places are bits of one long. Longer templates are cut, and each piece is looked for by itself.
PIECE = 60
#: Grams of all templates up to which their table is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 1 << 18


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


#: Phrases, and words of public license notices.
TEMPLATES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nd", "licensed under cc by nd 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc0", "has waived all copyright and related or neighboring rights to"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("reserved", "all rights reserved"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: A word is a run without these bytes: 00-2F, 3A-60 (after A-Z are lower-cased) and 7B-7F.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), F.lit(_WORD), F.lit(0))


def pieces(templates: list[Template]) -> list[tuple[str, bool, list[str]]]:
    """Label, base and words of each template, notices of more than PIECE words cut into pieces of about equal length."""
    out = []
    for t in templates:
        found = re.findall(_WORD, t.text.translate(str.maketrans(_CAPITALS, _SMALL)))
        if not found or (t.base and len(found) > PIECE):
            raise ValueError(f"a template needs a word, a phrase at most {PIECE}: {t.label}")
        n = -(-len(found) // PIECE)
        out += [(t.label, t.base, found[len(found) * i // n : len(found) * (i + 1) // n]) for i in range(n)]
    return out


def _hash(word_at, k: int) -> Column:
    return F.xxhash64(*[word_at(i) for i in range(k)])


def template_grams(spark: SparkSession, found: list[tuple[str, bool, list[str]]]) -> DataFrame:
    """Each gram of each template: hash, words, k, template (its number), at (place of the gram's first word)."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(min(GRAM, len(w))).alias("k"), F.lit(" ".join(w)).alias("text")) for i, (_, _, w) in enumerate(found)]
    whole = spark.range(1).select(F.inline(F.array(*rows))).withColumn("w", F.split("text", " "))
    at = whole.select("template", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("at"))
    hashed = reduce(lambda rest, k: F.when(F.col("k") == k, _hash(lambda i: F.get("w", F.col("at") + i), k)).otherwise(rest), range(1, GRAM), _hash(lambda i: F.get("w", F.col("at") + i), GRAM))
    return at.select(hashed.alias("gram"), F.slice("w", F.col("at") + 1, F.col("k")).alias("gram_words"), "k", "template", "at")


def votes(docs: DataFrame, templates: list[Template], key: str, text: str) -> DataFrame:
    """Votes by diagonal: __key, __h (xxhash64 of the text), template, diagonal, bits (a bit for each gram of the template that hit), first_at and last_at."""
    found = pieces(templates)
    grams = template_grams(docs.sparkSession, found)
    if sum(map(len, (w for _, _, w in found))) <= MOST_BROADCAST:
        grams = F.broadcast(grams)
    keyed = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__h"), words(F.col(text)).alias("__w"))
    placed = keyed.select("__key", "__h", "__w", F.posexplode("__w").alias("__pos", "__word"))
    word_at = lambda i: F.col("__word") if i == 0 else F.get("__w", F.col("__pos") + i)
    rolled = [F.when(word_at(k - 1).isNotNull(), _hash(word_at, k)) for k in sorted({min(GRAM, len(w)) for _, _, w in found})]
    hashed = placed.select("__key", "__h", "__w", "__pos", F.explode(F.array(*rolled)).alias("__gram"))
    confirmed = (F.col("__gram") == F.col("gram")) & (F.slice("__w", F.col("__pos") + 1, F.col("k")) == F.col("gram_words"))
    hits = hashed.join(grams, confirmed).select("__key", "__h", "template", (F.col("__pos") - F.col("at")).alias("diagonal"), "at")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at"))
    # bits, not counts: a repeated row votes for what is already there
    return hits.groupBy("__key", "__h", "template", "diagonal").agg(F.bit_or(bit).alias("bits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def find_spans(docs: DataFrame, templates: list[Template] = TEMPLATES, key: str = "doc_id", text: str = "text", slack: int = 2, least: float = 0.9) -> DataFrame:
    """Verified spans: __key, __h, label, base, first_word, end_word (behind its last word; words count from 0), share.

    A phrase's span is a place where all its words stand consecutively. A
    notice's span merges the diagonals within ``slack`` of each other that cover
    ``least`` of its words or more. Rows of one key and one text are found once.
    """
    found = pieces(templates)
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(len(w)).alias("n"), F.lit(min(GRAM, len(w))).alias("k"))
        for i, (label, base, w) in enumerate(found)
    ]
    about = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.array(*rows))))
    cell = Window.partitionBy("__key", "__h", "template").orderBy("diagonal")
    near = cell.rangeBetween(-slack, slack)
    band = votes(docs, templates, key, text).withColumn("band", F.bit_or("bits").over(near)).join(about, "template")
    bits = F.when(F.col("base"), F.col("bits")).otherwise(F.col("band"))
    # a gram covers its first word and the k - 1 behind it
    cover = reduce(lambda x, j: x.bitwiseOR(F.when(F.col("k") > j, F.call_function("shiftleft", bits, F.lit(j))).otherwise(F.lit(0).cast("bigint"))), range(1, GRAM), bits)
    shared = band.withColumn("share", F.bit_count(cover) / F.col("n")).where(F.col("share") >= F.when(F.col("base"), 1.0).otherwise(least))
    before = F.lag("diagonal").over(cell)
    apart = F.col("base") | before.isNull() | (F.col("diagonal") - before > slack)
    runs = shared.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(cell.rowsBetween(Window.unboundedPreceding, 0)))
    begin, end = F.col("diagonal") + F.col("first_at"), F.col("diagonal") + F.col("last_at") + F.col("k")
    merged = runs.groupBy("__key", "__h", "template", "run").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.min(begin).cast("bigint").alias("first_word"), F.max(end).cast("bigint").alias("end_word"), F.max("share").alias("share")
    )
    return merged.drop("template", "run")


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, key: str = "doc_id", text: str = "text", slack: int = 2, least: float = 0.9) -> DataFrame:
    """``docs`` without its text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base: places of phrases, all of them (first_word, last_word: their least
    and greatest first words, null without one); base_labels and labels: of
    phrases, and of phrases and notices, distinct, sorted and joined by commas
    (empty without any); score: the greatest share of a verified span, 1 for a
    phrase, 0 without one. Null and empty texts have no words. Texts are scanned
    whole, of any length; a text full of phrases is as many rows of one long
    each. Repeated rows stay and are judged alike, also with a null key; equal
    keys with different texts are documents of their own. Columns of ``docs``
    named like a result column are replaced. An empty table gives an empty one.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in tx.others(docs, made) if c != text]
    spans = find_spans(docs, templates, key, text, slack, least)
    base = F.col("base")
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")  # noqa: E731 (at most the templates' labels)
    by_doc = spans.groupBy("__key", "__h").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("share").alias("score"),
    )
    counted = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(text).alias("__h0"), F.col(key).alias("__key0"), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    out = counted.join(by_doc, F.col("__key0").eqNullSafe(F.col("__key")) & (F.col("__h0") == F.col("__h")), "left")
    filled = [F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")]
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_words", *filled)
