"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is divided by its size: every document of the source is
wanted that many times (at most twice). The whole part is taken; the fractional
parts are rounded by pairing: of two documents with fractional copies x and y
and sizes a and b, mass a*x + b*y is moved at random from one to the other
until one of them is integral, which keeps both expectations and the pair's
mass. The other one, still fractional, meets the next document.

Documents are dealt by hash into cells of about ``fan_in`` documents of one
source; a cell is folded pair by pair and leaves at most one fractional
document. These residuals are dealt into cells again, and so on, until a source
has one: a reduction tree of depth log(documents) / log(fan_in). The last
residual of a source is rounded by its own chance, so that the taken mass of a
source is off its target by less than one document.

Rows of the same key, source and size are interchangeable: of m of them, the whole
part of m times their fraction is taken, and one of them stands for the rest, so
that however often a row repeats, cells stay small.

All chances are hashes of what is paired, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

#: Below this distance from an integer a fractional count is integral.
CLOSE = 1e-9
#: Equal rows that are written out at once.
RUN = 100_000


def word_count(text: str) -> Column:
    """Number of runs of characters other than 09-0D and 20; 0 for null."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return F.size(F.array_remove(parts, "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    ``sizes``: rows of source and size. Sources in code-point order, null last,
    weigh ``weights``, repeating; they share ``share`` of all sizes. A target
    stops at ``most`` times its source's size, and the excess is shared by
    weight among the others until none is above (in closed form: sources by
    cap per weight, the first at which the rest per weight doesn't exceed the cap).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("w", F.element_at(kinds, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("budget", share * F.sum("source_size").over(whole))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("even", F.col("left") / F.col("left_w"))
        .withColumn("level", F.min(F.when(F.col("even") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("even").alias("even")))).over(whole)["even"])
    )
    even = F.coalesce(F.col("level") * F.col("w"), F.col("cap"))
    return level.select("source", "source_size", "n_docs", F.least(even, F.col("cap")).alias("target"))


def _chance(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _fold(cell: Column, item: str, seed: int) -> Column:
    """Pair the documents of a cell one by one: struct(done: decided documents, held: array with the fractional one, if any)."""
    shape = f"struct<done:array<{item}>,held:array<{item}>>"
    start = F.from_json(F.lit('{"done":[],"held":[]}'), shape)

    def integral(x: Column) -> Column:
        return (x <= CLOSE) | (x >= 1 - CLOSE)

    def put(doc: Column, x: Column) -> Column:
        return doc.withField("x", F.when(x <= CLOSE, 0.0).when(x >= 1 - CLOSE, 1.0).otherwise(x))

    def step(state: Column, doc: Column) -> Column:
        first = F.get(state["held"], F.lit(0))
        a, b = first["size"].cast("double"), doc["size"].cast("double")
        # up: mass that may go from doc to first; down: from first to doc
        up = F.least(a * (1 - first["x"]), b * doc["x"])
        down = F.least(a * first["x"], b * (1 - doc["x"]))
        moved = F.when(_chance(first["id"], doc["id"], F.lit(seed)) * (up + down) < down, up).otherwise(-down)
        one, two = put(first, first["x"] + moved / a), put(doc, doc["x"] - moved / b)
        # rounding of doubles can leave both next to an integer, never both far from one
        done = F.filter(F.array(one, two), lambda d: integral(d["x"]))
        held = F.filter(F.array(one, two), lambda d: ~integral(d["x"]))
        return F.when(integral(doc["x"]), F.struct(F.concat(state["done"], F.array(put(doc, doc["x"]))).alias("done"), state["held"].alias("held"))).when(
            F.size(state["held"]) == 0, F.struct(state["done"].alias("done"), F.array(doc).alias("held"))
        ).otherwise(F.struct(F.concat(state["done"], done).alias("done"), held.alias("held")))

    return F.aggregate(cell, start, lambda s, d: step(s, d).cast(shape))


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, fan_in: int = 32, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: the key, source, size, source_size, target, copies and taken (copies times size).

    A document's expected copies are its source's target over its source's
    size; its copies are that number rounded down or up. Texts that are null or
    empty have size 0 and are taken as often as the whole part says. Null is a
    source of its own. Repeated rows come back as often as they are; equal rows
    are interchangeable. A text of any length is one row, whole. An empty table gives an empty result.
    """
    sizes = tx.checkpointed(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), word_count(text).alias("size")))
    goals = tx.checkpointed(targets(sizes.select("source", "size"), weights, share, most))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(want + CLOSE)
    equal = sizes.groupBy("key", "source", "size").agg(F.count("*").alias("many"))
    each = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), want - whole)).otherwise(0.0)
    sure = F.floor(F.col("many") * each + CLOSE)
    wanted = equal.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).select(
        "source", "source_size", "target", "n_docs", F.col("key"), "size", "many", whole.alias("base"), sure.alias("more"), F.greatest(F.lit(0.0), F.col("many") * each - sure).alias("x")
    )
    kind = docs.schema[key].dataType.simpleString()
    item = f"struct<id:bigint,key:{kind},size:bigint,many:bigint,base:bigint,more:bigint,source_size:bigint,target:double,n:bigint,x:double>"
    doc = F.struct(F.xxhash64("key", "size", F.lit(seed)).alias("id"), F.col("key").alias("key"), "size", "many", F.col("base").cast("bigint").alias("base"), F.col("more").cast("bigint").alias("more"), "source_size", "target", F.col("n_docs").alias("n"), "x").cast(item)
    level, n_left, parts = wanted.select("source", doc.alias("doc")), None, []
    depth = 0
    while True:
        # at level d a source has about n_docs / fan_in^d documents left
        cells = F.greatest(F.lit(1.0), F.ceil(F.col("doc.n") / float(fan_in) ** (depth + 1))).cast("bigint")
        dealt = level.withColumn("cell", F.pmod(F.xxhash64("doc.id", F.lit(depth)), cells))
        folded = tx.checkpointed(dealt.groupBy("source", "cell").agg(F.array_sort(F.collect_list("doc")).alias("docs")).select("source", _fold(F.col("docs"), item, seed + depth).alias("f")))
        parts.append(folded.select("source", F.explode("f.done").alias("doc")))
        level = folded.select("source", F.explode("f.held").alias("doc"))
        counted = level.groupBy("source").count().agg(F.max("count")).first()[0]
        depth += 1
        if not counted or counted <= 1:
            break
    last = level.withColumn("doc", F.col("doc").withField("x", F.when(_chance(F.col("doc.id"), F.lit(seed + 1000)) < F.col("doc.x"), 1.0).otherwise(0.0)))
    out = last
    for part in parts:
        out = out.unionByName(part)
    # equal rows again: so many with one copy more, the others without
    up = F.col("doc.more") + F.col("doc.x").cast("bigint")
    both = F.array(F.struct(up.alias("n"), F.lit(1).cast("bigint").alias("more")), F.struct((F.col("doc.many") - up).alias("n"), F.lit(0).cast("bigint").alias("more")))
    kinds = out.select("source", "doc", F.explode(F.filter(both, lambda b: b["n"] > 0)).alias("of"))
    runs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("of.n") - 1) / RUN)), lambda k: F.least(F.lit(RUN), F.col("of.n") - k * RUN).cast("int"))
    rows = kinds.withColumn("run", F.explode(runs)).withColumn("one", F.explode(F.array_repeat(F.lit(True), F.col("run"))))
    copies = F.col("doc.base") + F.col("of.more")
    return rows.select(F.col("doc.key").alias(key), "source", F.col("doc.size").alias("size"), F.col("doc.source_size").alias("source_size"), F.col("doc.target").alias("target"), copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
