"""The scoring rubric as column expressions and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels in order, and the growth share of each label's asset mix in percent (the rest is income).
LABELS = ("Cash", "Capital Stable", "Balanced", "Balanced Growth", "Growth", "High Growth")
GROWTH_PCT = (0, 35, 52, 70, 82, 93)
#: Names of the cuts between labels.
CUTS = ("cash_max", "capstable_max", "balanced_max", "balgrowth_max", "growth_max")
#: The cuts by time horizon. A label holds up to its cut; beyond the last cut is the last label.
CUT_TABLE = {
    2: (18, 22, 26, 30, 34),
    3: (17, 21, 25, 29, 33),
    4: (16, 20, 24, 28, 32),
    5: (15, 19, 23, 27, 31),
    6: (14, 18, 22, 26, 30),
    7: (13, 17, 21, 25, 29),
    8: (12, 16, 20, 24, 28),
    9: (11, 15, 19, 23, 27),
    10: (10, 14, 18, 22, 26),
}
#: Ranges of time horizons and investor totals.
TH_RANGE, TOI_RANGE = (2, 10), (8, 40)


def cut(th: int, k: int) -> int:
    return CUT_TABLE[th][k]


def cuts_at(th: Column, table: dict[int, tuple[int, ...]] | None = None) -> Column:
    """The cuts of a horizon, as an array; null for horizons outside the rubric."""
    rows = table or CUT_TABLE
    return F.create_map(*[x for h, cuts in rows.items() for x in (F.lit(h), F.array(*map(F.lit, cuts)))])[th.cast("int")]


def label_ord(toi: Column, th: Column, table: dict[int, tuple[int, ...]] | None = None) -> Column:
    """Place of the label (0 to 5) for an investor total and a time horizon: the cuts that the total exceeds; null for horizons outside the rubric.

    ``table``: other cuts than the rubric's. A join-free expression, evaluated
    by one look into a literal array of all horizons' places by total (totals
    beyond the cuts count as the least and the greatest).
    """
    rows = table or CUT_TABLE
    low, high = min(min(c) for c in rows.values()), max(max(c) for c in rows.values()) + 1
    places = [sum(t > c for c in cuts) for cuts in rows.values() for t in range(low, high + 1)]
    horizon = F.array_position(F.array(*[F.lit(float(h)) for h in rows]), th.cast("double")) - 1
    total = F.ceil(F.least(F.greatest(toi, F.lit(low)), F.lit(high))) - low
    # least and greatest skip nulls
    return F.when(toi.isNotNull() & (horizon >= 0), F.get(F.array(*map(F.lit, places)), (horizon * (high - low + 1) + total).cast("int")))


def label_of(ordinal: Column) -> Column:
    """Label of a place; null outside 0 to 5."""
    return F.get(F.array(*[F.lit(x) for x in LABELS]), ordinal.cast("int"))


def growth_of(ordinal: Column) -> Column:
    """Growth percent of a place's asset mix."""
    return F.get(F.array(*[F.lit(x) for x in GROWTH_PCT]), ordinal.cast("int"))


def ord_of(label: Column) -> Column:
    """Place of a label; null for unknown labels."""
    at = F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def label_dim(spark: SparkSession) -> DataFrame:
    """Six rows: label_ord, label, growth_pct, income_pct."""
    return spark.createDataFrame([(i, x, g, 100 - g) for i, (x, g) in enumerate(zip(LABELS, GROWTH_PCT))], "label_ord int, label string, growth_pct int, income_pct int")


def band_dim(spark: SparkSession) -> DataFrame:
    """A row for each horizon and label: th, label_ord, label, toi_from, toi_to, growth_pct, income_pct."""
    th = spark.range(TH_RANGE[0], TH_RANGE[1] + 1).select(F.col("id").cast("int").alias("th"))
    top = len(LABELS) - 1
    return th.crossJoin(label_dim(spark)).select(
        "th", "label_ord", "label",
        F.when(F.col("label_ord") == 0, F.lit(TOI_RANGE[0])).otherwise(F.get(cuts_at(F.col("th")), F.col("label_ord") - 1) + 1).alias("toi_from"),
        F.when(F.col("label_ord") == top, F.lit(TOI_RANGE[1])).otherwise(F.get(cuts_at(F.col("th")), F.col("label_ord"))).alias("toi_to"),
        "growth_pct", "income_pct",
    )


def accuracy(pred: Column, true: Column) -> Column:
    """1 or 0; null where either is null."""
    return (pred == true).cast("int")


def ordinal_error(pred: Column, true: Column) -> Column:
    """Places between two labels; null for unknown labels."""
    return ord_of(pred) - ord_of(true)


def ground_truth(df: DataFrame, toi: str = "toi", th: str = "th") -> DataFrame:
    """Adds expected_label, expected_growth, expected_income and mapping_error; outside the rubric UNMAPPED, 0, 0 and a text."""
    place = label_ord(F.col(toi), F.col(th))
    return (
        df.withColumn("expected_label", F.coalesce(label_of(place), F.lit("UNMAPPED")))
        .withColumn("expected_growth", F.coalesce(growth_of(place), F.lit(0)))
        .withColumn("expected_income", F.coalesce(100 - growth_of(place), F.lit(0)))
        .withColumn("mapping_error", F.when(place.isNull(), F.format_string("no row for horizon %s", F.col(th).cast("string"))))
    )


def validate_truth(df: DataFrame, label: str, growth: str, income: str) -> DataFrame:
    """After ``ground_truth``: label_correct, deviation (absolute differences added) and calibration_error (their Euclidean length); missing percents are 0."""
    g, i = F.coalesce(F.col(growth), F.lit(0)), F.coalesce(F.col(income), F.lit(0))
    dg, di = g - F.col("expected_growth"), i - F.col("expected_income")
    return df.withColumn("label_correct", F.coalesce(F.col(label) == F.col("expected_label"), F.lit(False))).withColumn("deviation", F.abs(dg) + F.abs(di)).withColumn("calibration_error", F.sqrt(dg * dg + di * di))


def schema_violations(label: Column, growth: Column, income: Column, justification: Column, longest: int = 500) -> Column:
    """Names of the response schema's rules that a response breaks."""
    rules = {
        "risk_label": ord_of(label).isNotNull(), "growth_pct": growth.between(0, 100), "income_pct": income.between(0, 100), "sum": growth + income == 100,
        "justification": F.length(justification).between(1, longest),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def lenient_valid(label: Column, growth: Column, income: Column, justification: Column, tolerance: int = 5, shortest: int = 10, enabled: bool = True) -> Column:
    """Whether a response passes the tolerant checks; always true if they are off."""
    if not enabled:
        return F.lit(True)
    ok = ord_of(label).isNotNull() & growth.between(0, 100) & income.between(0, 100) & (F.abs(growth + income - 100) <= tolerance) & (F.length(justification) >= shortest)
    return F.coalesce(ok, F.lit(False))


def rubric_lines(spark: SparkSession) -> DataFrame:
    """The rubric as text, a line for each horizon: th, line."""
    bands = band_dim(spark).withColumn("piece", F.when(F.col("label_ord") < len(LABELS) - 1, F.format_string("TOI<=%d: %s", "toi_to", "label")).otherwise(F.concat(F.lit("else "), F.col("label"))))
    return bands.groupBy("th").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("label_ord", "piece"))), lambda x: x["piece"])).alias("line"))
