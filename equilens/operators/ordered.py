"""Order within long series: positions, running sums, ranks and quantiles without a task that holds a whole series.

Rows are dealt into blocks by quantiles of what orders them, or by position. A
block's own running sums come from a window over the block; what it needs of the
blocks before it are a few numbers each, summed over a table of one row a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.session import stored

#: Rows of a block, about, and blocks at most (their bounds are part of the plan).
BLOCK_ROWS, MOST_BLOCKS = 250_000, 1024


def over(by: list[str], *more: str):
    """A window of each group; of all rows, where there are no groups."""
    return Window.partitionBy(*by, *more) if by or more else Window.partitionBy(F.lit(0))


def blocks(rows: int, size: int) -> int:
    """Blocks of about ``size`` rows, one at least."""
    return max(1, -(-rows // size))


def as_number(df: DataFrame, column: str) -> Column:
    """A column's order as a double (times in microseconds); not always strict, never reversed."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def in_blocks(df: DataFrame, column: str, name: str = "__b") -> DataFrame:
    """Adds the number of a row's block by the order of ``column`` (a number or a time): blocks follow each other, and equal values share one. Nulls are in block -1."""
    from pyspark.ml.feature import Bucketizer

    value = as_number(df, column)
    wanted = max(1, min(MOST_BLOCKS, -(-df.count() // BLOCK_ROWS)))
    cuts = df.agg(F.percentile_approx(value, [k / wanted for k in range(1, wanted)], 20 * MOST_BLOCKS)).first()[0] if wanted > 1 else []
    inner = sorted({c for c in cuts or [] if math.isfinite(c)})
    if not inner:
        return df.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=f"{name}v", outputCol=f"{name}d", handleInvalid="keep")
    dealt = cut.transform(df.withColumn(f"{name}v", value))
    return dealt.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(F.col(f"{name}d").cast("int"))).drop(f"{name}v", f"{name}d")


def joined(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of a table that has one row for each value of ``keys``; null keys are equal."""
    if not keys:
        return df.crossJoin(F.broadcast(small))  # one row
    side = small.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return df.join(side, same, how).drop(*[f"__key{i}" for i in range(len(keys))])


def indexed(df: DataFrame, by: list[str], order: list[str], name: str = "__i") -> DataFrame:
    """Adds a row's position within its series, from 0. The first column of ``order`` is a number or a time."""
    dealt = in_blocks(df, order[0])
    before = over(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "__b").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = dealt.withColumn("__own", F.row_number().over(over(by, "__b").orderBy(*order)))
    return joined(own, counts, [*by, "__b"]).withColumn(name, (F.col("__own") + F.col("__before") - 1).cast("bigint")).drop("__b", "__own", "__before")


def with_neighbours(df: DataFrame, before: int, after: int, index: str = "__i") -> DataFrame:
    """Rows dealt into chunks by position (``__c``), with copies (``__guest``) of the ``before`` rows ahead of each chunk and the ``after`` rows behind it.

    Windows of that reach over a series' chunk, in the order of the positions, are those over the series.
    """
    size = max(BLOCK_ROWS, before, after, 1)
    own, place = F.floor(F.col(index) / size), F.col(index) % size
    to = F.array(F.struct(own.alias("c"), F.lit(False).alias("g")), F.when(place >= size - before, F.struct((own + 1).alias("c"), F.lit(True).alias("g"))), F.when((place < after) & (own > 0), F.struct((own - 1).alias("c"), F.lit(True).alias("g"))))
    return df.withColumn("__to", F.explode(F.array_compact(to))).withColumn("__c", F.col("__to.c")).withColumn("__guest", F.col("__to.g")).drop("__to")


def cumulated(cells: DataFrame, by: list[str], value: str, amounts: list[str]) -> DataFrame:
    """``cells`` (one row for each value of a series) with ``<amount>_before``: the sum over the series' smaller values."""
    dealt = in_blocks(cells, value)
    before = over(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy(*by, "__b").agg(*[F.sum(a).alias(f"__sum_{a}") for a in amounts])
    total = total.select(*by, "__b", *[F.coalesce(F.sum(f"__sum_{a}").over(before), F.lit(0)).alias(f"__sum_{a}") for a in amounts])
    own = over(by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.select(*cells.columns, "__b", *[F.coalesce(F.sum(a).over(own), F.lit(0)).alias(f"{a}_before") for a in amounts])
    return joined(here, total, [*by, "__b"]).select(*cells.columns, *[(F.col(f"{a}_before") + F.col(f"__sum_{a}")).alias(f"{a}_before") for a in amounts])


def quantiles(df: DataFrame, value: str, probabilities: list[float | Column], by: list[str] | tuple = (), name: str = "q", weight: str | None = None) -> DataFrame:
    """by, n and an array of exact quantiles (between two values, in proportion), from counts of distinct values.

    A probability may be an expression of a group's n; where that is null, the quantile is left out. ``weight``: a column of counts.
    """
    by = list(by)
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("__t"))
    ranked = cumulated(cells, by, value, ["__t"])
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p).cast("double") * (F.col("n") - 1)).alias("p")) for i, p in enumerate(probabilities)])
    groups = ranked.groupBy(*by).agg(F.sum("__t").alias("n")).withColumn("__spots", spots)
    inside = lambda place: (place >= F.col("__t_before")) & (place < F.col("__t_before") + F.col("__t"))
    hit = F.filter("__spots", lambda s: inside(F.floor(s["p"])) | inside(F.ceil(s["p"])))
    met = joined(ranked, groups, by).select(*by, "n", "__t", "__t_before", F.col(value).cast("double").alias("__x"), F.explode(hit).alias("__s"))
    low, high = (F.max(F.when(inside(f("__s.p")), F.col("__x"))) for f in (F.floor, F.ceil))
    found = met.groupBy(*by, "n", "__s").agg(low.alias("__l"), high.alias("__h"))
    between = F.col("__l") + (F.col("__s.p") - F.floor("__s.p")) * (F.col("__h") - F.col("__l"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__s.i").alias("i"), between.alias("q"))))
    return found.groupBy(*by, "n").agg(F.transform(listed, lambda r: r["q"]).alias(name))


def numbered(values: DataFrame, column: str | list[str], name: str) -> DataFrame:
    """``values`` (one row for each value of any orderable column or columns) with their number in order, from 0: ranges of values are numbered apart, after the sizes of those before.

    The ranges are written down, as another run of the same plan may cut them elsewhere.
    """
    columns = [column] if isinstance(column, str) else column
    ranges = stored(values.repartitionByRange(*columns).withColumn("__p", F.spark_partition_id()))
    before = ranges.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*columns)) - 1
    return ranges.withColumn("__own", own).join(before.drop("__n"), "__p").withColumn(name, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")


def running_sum(df: DataFrame, by: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` up to and with the row, in ``order`` (the first column is a number or a time; rows equal in it have the same sum)."""
    dealt = in_blocks(df, order[0])
    before = over(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy(*by, "__b").agg(F.sum(amount).alias("__sum"))
    total = total.select(*by, "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead"))
    own = dealt.withColumn("__own", F.sum(amount).over(over(by, "__b").orderBy(*order)))
    return joined(own, total, [*by, "__b"]).withColumn(name, F.col("__own") + F.col("__ahead")).drop("__b", "__own", "__ahead")
