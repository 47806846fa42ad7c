"""Small projections over result rows: costs, model classes, derived features and keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered as od

#: Price of a thousand tokens (input, output) of models that have none of their own.
DEFAULT_PRICE = (0.005, 0.015)


def token_estimate(text: Column) -> Column:
    """A quarter of the text's characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: Mapping[str, tuple[float, float]]) -> Column:
    """Cost of a call by the model's prices for a thousand tokens of input and output."""
    def price(side: int) -> Column:
        if not prices:
            return F.lit(DEFAULT_PRICE[side])
        known = F.create_map(*[x for name, both in prices.items() for x in (F.lit(name), F.lit(both[side]))])
        return F.coalesce(known[model], F.lit(DEFAULT_PRICE[side]))

    return tokens_in / 1000.0 * price(0) + tokens_out / 1000.0 * price(1)


def budget_guard(df: DataFrame, cost: str, order: str, by: Sequence[str] = (), most_call: float = 0.05, most_total: float = 100.0) -> DataFrame:
    """Adds running (the cost up to and with the row, in ``order``), over_call and over_total."""
    summed = od.running_sum(df, list(by), [order], cost, "running")
    return summed.withColumn("over_call", F.col(cost) > most_call).withColumn("over_total", F.col("running") > most_total)


def model_family(model: Column) -> Column:
    """gpt, claude or gemini, by what the lower-cased id contains; else other."""
    m = F.lower(model)
    return F.when(m.contains("gpt"), "gpt").when(m.contains("claude"), "claude").when(m.contains("gemini"), "gemini").otherwise("other")


def vendor(model: Column) -> Column:
    """openai, anthropic or google by family; else unknown."""
    family = model_family(model)
    return F.when(family == "gpt", "openai").when(family == "claude", "anthropic").when(family == "gemini", "google").otherwise("unknown")


def model_size(model: Column) -> Column:
    """mini or full (gpt), haiku (claude), flash or pro (gemini); else unknown."""
    m = F.lower(model)
    gpt = F.when(m.contains("mini"), "mini").otherwise("full")
    return F.when(m.contains("gpt"), gpt).when(m.contains("haiku"), "haiku").when(m.contains("flash"), "flash").when(m.contains("gemini"), "pro").otherwise("unknown")


def tier(model: Column, tiers: Mapping[str, Sequence[str]]) -> Column:
    """Name of the tier that lists the model; else unknown."""
    out = F.lit("unknown")
    for name, models in reversed(list(tiers.items())):
        out = F.when(model.isin(*models), name).otherwise(out)
    return out


def pair_indicators(df: DataFrame, a: str, values_a: Sequence[str], b: str, values_b: Sequence[str]) -> DataFrame:
    """Adds a 0/1 column ``x_y`` for every pair of a value of ``a`` and one of ``b``; a null is in no pair."""
    both = {f"{x}_{y}": (F.col(a) == x) & (F.col(b) == y) for x in values_a for y in values_b}
    return df.withColumns({name: F.coalesce(is_, F.lit(False)).cast("int") for name, is_ in both.items()})


def band(value: Column, edges: Sequence[float]) -> Column:
    """The right-closed band of a value, as ``(low,high]``; null outside the edges."""
    out = F.lit(None).cast("string")
    for low, high in zip(edges, edges[1:]):
        out = F.when((value > low) & (value <= high), f"({low},{high}]").otherwise(out)
    return out


def category_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Adds the place of a value among the sorted distinct values, from 0; null is -1. A category has few values: these alone are sorted together."""
    from pyspark.sql import Window

    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")).drop("__n")
    codes = values.select(F.col(column).alias("__v"), (F.dense_rank().over(Window.orderBy(column)) - 1).cast("bigint").alias(name))
    return df.join(codes, F.col(column) == F.col("__v"), "left").drop("__v").withColumn(name, F.coalesce(name, F.lit(-1)))


def call_key(provider: Column, model: Column, system: Column, user: Column, temperature: Column) -> Column:
    """SHA-256 of the call's parts with bars between; ``temperature`` is text, as 0.0."""
    return F.sha2(F.concat_ws("|", provider, model, system, user, temperature), 256)


def prompt_key(prompt: Column, model: Column, temperature: Column) -> Column:
    """MD5 of prompt, model and temperature with bars between."""
    return F.md5(F.concat_ws("|", prompt, model, temperature))


def request_key(model: Column, prompt_digest: Column, temperature: Column) -> Column:
    """SHA-256 of the request as JSON with sorted keys."""
    return F.sha2(F.format_string('{"model": "%s", "prompt": "%s", "temperature": %s}', model, prompt_digest, temperature), 256)


def mentions(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A row for each name that one of the text columns contains: the columns of df and name."""
    text = F.concat_ws("\n", *columns)
    found = F.filter(F.array(*map(F.lit, names)), lambda name: F.contains(F.lower(text), F.lower(name)))
    return df.withColumn("name", F.explode(found))


def zipped(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Rows of two tables side by side, by their places in order (columns of the right one with the suffix _2). Tables of different lengths raise."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows can't be zipped")
    a = od.indexed(left, [], [order_left], "__place")
    b = od.indexed(right, [], [order_right], "__place").select(F.col("__place"), *[F.col(c).alias(f"{c}_2") for c in right.columns])
    return a.join(b, "__place").drop("__place")
