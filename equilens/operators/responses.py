"""Refusals, consistency and ablation summaries over response texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Refusal categories in order, with their regular expressions (matched without case).
REFUSALS = (
    ("policy", ("I cannot provide", "I'm not able to", "I can't provide", "I'm unable to", "I shouldn't", "I won't", "I cannot recommend")),
    ("safety", ("this could be harmful", "potential risks", "safety concerns", "inappropriate", "not appropriate", "concerning")),
    ("demographic", ("based on.*(?:gender|age|race|ethnicity)", "demographic.*bias", "discriminat", "stereotype", "unfair.*assumptions")),
    ("unclear", ("I don't have enough information", "unclear", "ambiguous", "need more context", "insufficient.*information")),
)


def refusal(df: DataFrame, text: str) -> DataFrame:
    """Adds refusal_patterns (all that match, as category:pattern), is_refusal and refusal_type (the first category that matches). Null and empty texts: none."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.array_compact(F.array(*[F.when(t.rlike(p.lower()), f"{kind}:{p}") for kind, some in REFUSALS for p in some]))
    out = df.withColumn("refusal_patterns", hits).withColumn("is_refusal", F.size("refusal_patterns") > 0)
    return out.withColumn("refusal_type", F.split(F.get("refusal_patterns", F.lit(0)), ":")[0]).withColumn("demographic_sensitivity", F.exists("refusal_patterns", lambda p: p.startswith("demographic:")))


def consistency(df: DataFrame, case: str, response: str) -> DataFrame:
    """case, n, distinct responses, modal share, distinct lengths and stable (one response)."""
    cells = df.where(F.col(response).isNotNull()).groupBy(case, response).agg(F.count("*").alias("o"))
    return cells.groupBy(case).agg(
        F.sum("o").alias("n"), F.count("*").alias("distinct"), (F.max("o") / F.sum("o")).alias("modal_share"), F.countDistinct(F.length(response)).alias("lengths")
    ).withColumn("stable", F.col("distinct") == 1)


#: Classes of a response's difference from its case's modal one, by the first that holds.
DIFFERENCES = ("error", "spelling", "order", "numbers", "shortened", "extended", "wording")


def differences(df: DataFrame, case: str, response: str) -> DataFrame:
    """Each distinct response of a case against the case's modal one (most frequent; ties to the least by text): case, response, n, modal (whether it is that one), added, dropped and difference.

    Tokens are runs without white space. added and dropped: numbers of distinct tokens that
    only the response, or only the modal one, has. difference, null for the
    modal one: error (the text has the word error, in any case), spelling (equal but for case, punctuation and white
    space), order (the same tokens), numbers (only tokens with digits
    differ), shortened or extended (nothing is added, or nothing dropped), else wording. Null responses are left out.
    """
    cells = df.where(F.col(case).isNotNull() & F.col(response).isNotNull()).groupBy(case, response).agg(F.count("*").alias("n"))
    modal = cells.groupBy(case).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(response).alias("__modal"))).alias("z")).select(case, "z.__modal")
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.col(c), r"\s+"), ""))
    both = cells.join(modal, case).withColumn("__a", tokens(response)).withColumn("__b", tokens("__modal"))
    added, dropped = F.array_except("__a", "__b"), F.array_except("__b", "__a")
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[\p{Punct}\s]+", "")
    told = both.withColumn("__x", added).withColumn("__y", dropped).withColumn("modal", F.col(response) == F.col("__modal"))
    none = lambda c: F.size(c) == 0
    kind = (
        F.when(F.col("modal"), None).when(F.lower(response).contains("error"), "error").when(plain(response) == plain("__modal"), "spelling").when(none("__x") & none("__y"), "order")
        .when(F.forall(F.concat("__x", "__y"), lambda t: t.rlike("[0-9]")), "numbers").when(none("__x"), "shortened").when(none("__y"), "extended").otherwise("wording")
    )
    return told.select(case, response, "n", "modal", F.size("__x").cast("bigint").alias("added"), F.size("__y").cast("bigint").alias("dropped"), kind.alias("difference"))


def instability(df: DataFrame, case: str, response: str) -> DataFrame:
    """case, n, distinct, modal_share, sources and counts of responses by difference (see ``differences``).

    sources, of a case with several distinct responses: non_deterministic_sampling, api_errors if
    one has the word error, variable_response_length if their lengths differ; of others empty.
    """
    told = differences(df, case, response)
    text = F.col(response)
    several = F.count("*") > 1
    sources = F.array_compact(F.array(F.when(several, "non_deterministic_sampling"), F.when(several & F.bool_or(F.lower(text).contains("error")), "api_errors"), F.when(several & (F.min(F.length(text)) != F.max(F.length(text))), "variable_response_length")))
    by_kind = [F.coalesce(F.sum(F.when(F.col("difference") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in DIFFERENCES]
    return told.groupBy(case).agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("modal_share"), sources.alias("sources"), *by_kind)


def mode_summary(df: DataFrame, by: list[str], ok: Column, seconds: Column, correct: Column, error: Column, refused: Column) -> DataFrame:
    """by, attempts, success_rate, and means over successes: seconds, accuracy, calibration_error and refusal_rate."""
    of = lambda x: F.avg(F.when(ok, x.cast("double")))
    return df.groupBy(*by).agg(F.count("*").alias("attempts"), F.avg(ok.cast("double")).alias("success_rate"), of(seconds).alias("seconds"), of(correct).alias("accuracy"), of(error).alias("calibration_error"), of(refused).alias("refusal_rate"))


def ablation(prompts: DataFrame, responses: DataFrame, key: str, label: str = "risk_label", growth: str = "growth_pct", income: str = "income_pct", text: str = "text", error: str = "error") -> DataFrame:
    """Runs of an ablation, a row for each prompt: the prompt's columns (with toi and th), the response's, ok, the checks against the rubric, and refusals. Prompts without a response failed."""
    from equilens.functions import rubric as ru

    answered = responses.withColumn("__found", F.lit(True))
    both = prompts.join(answered, key, "left").withColumn("ok", F.coalesce(F.col("__found"), F.lit(False)) & F.col(error).isNull()).drop("__found")
    return refusal(ru.validate_truth(ru.ground_truth(both), label, growth, income), text)
