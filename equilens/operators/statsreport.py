"""The full statistics report of an audit, from one scan of its rows.

The rows' few columns are written down once. A table of cells by GROUPING SETS
(labels by name group, and by city) then stands for them in all tests that
only need counts; pairs and sequences, which need rows, read the narrow table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions import rubric as ru
from equilens.session import stored

from . import fairness as fa
from . import inference as inf

#: The dimension that groups are compared in, by condition.
DIMENSIONS = {"N": "name_group", "NL": "name_group", "L": "city"}


def narrow(df: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """The columns that the report needs, written down."""
    return stored(df.select(*by, *keys, "condition", "name_group", "city", "pred_label", "true_label", "proposed_growth", "true_growth", "ordinal_error", "acc"))


def cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts ``n`` of rows by condition, labels, growth, error and acc, within the groups of each dimension (``dimension``, ``grp``)."""
    common = [*by, "condition", "pred_label", "true_label", "proposed_growth", "true_growth", "ordinal_error", "acc"]
    sets = [[*common, "name_group"], [*common, "city"]]
    counted = rows.groupingSets(sets, *common, "name_group", "city").agg(F.grouping("city").alias("__g"), F.count("*").alias("n"))
    return stored(counted.select(*common, F.when(F.col("__g") == 1, "name_group").otherwise("city").alias("dimension"), F.coalesce("name_group", "city").alias("grp"), "n"))


def statistics(df: DataFrame, positive: str = "High Growth", by: tuple[str, ...] = ("provider", "model"), keys: tuple[str, ...] = ("subject_id", "run_idx")) -> DataFrame:
    """All statistics in long form: by, condition, dimension, grp, label, test, statistic, dof.

    Of a condition: accuracy and repeatability (mean kappa of a subject's
    labels in run order, within the condition's groups); against ND:
    two_proportion and mcnemar. Of groups within a condition (name groups in N and
    NL, cities in L): parity, kruskal and direction; by label odds_true and
    odds_false (among rows with that true label, and the others) and
    opportunity_gap (range of true positive rates). Of each group: selection_rate,
    and by label tpr and fpr; calibration_bias, _slope, _intercept and _ece; ordinal_mean, _std, _median,
    _over, _under and _exact. What can't be computed is null.
    """
    by, subject = list(by), keys[0]
    rows = narrow(df, by, list(keys))
    table = cells(rows, by)
    every = table.where("dimension = 'name_group'")  # all rows once, null groups too
    own = F.coalesce(*[F.when(F.col("condition") == c, F.lit(d)) for c, d in DIMENSIONS.items()])
    grouped = table.where((F.col("dimension") == own) & F.col("grp").isNotNull())
    within = [*by, "condition", "dimension"]
    parts = []

    def add(frame: DataFrame, values: dict[str, str], dof: str | None = None) -> None:
        have = set(frame.columns)
        fixed = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("dimension", "grp", "label")]
        tests = F.array(*[F.struct(F.lit(t).alias("test"), F.col(v).cast("double").alias("statistic")) for t, v in values.items()])
        degrees = (F.lit(1) if dof == "1" else F.col(dof) if dof else F.lit(None)).cast("bigint").alias("dof")
        parts.append(frame.select(*by, "condition", *fixed, F.explode(tests).alias("t"), degrees).select(*by, "condition", "dimension", "grp", "label", "t.test", "t.statistic", "dof"))

    add(fa.accuracy_by(every, [*by, "condition"], weight="n"), {"accuracy": "accuracy"})
    add(fa.condition_z(every, by, weight="n"), {"two_proportion": "z"})
    add(fa.paired_mcnemar(rows, by, list(keys)), {"mcnemar": "chi2"}, "1")
    cell = F.coalesce(*[F.when(F.col("condition") == c, F.col(d)) for c, d in DIMENSIONS.items()], F.lit(""))
    add(fa.repeatability(rows.withColumn("__g", cell), [subject, "__g"], [*by, "condition"], order=keys[1]), {"repeatability": "kappa"})
    add(fa.selection_rates(grouped, "grp", within, positive=positive, weight="n"), {"selection_rate": "rate"})
    add(fa.demographic_parity(grouped, "grp", within, positive=positive, weight="n"), {"parity": "chi2"}, "dof")
    labels = list(ru.LABELS)
    rates = stored(fa.one_vs_rest(grouped, "grp", labels, within, weight="n"))
    add(rates, {"tpr": "tpr", "fpr": "fpr"})
    add(rates.groupBy(*within, "label").agg((F.max("tpr") - F.min("tpr")).alias("gap")), {"opportunity_gap": "gap"})
    odds = fa.odds_tests(grouped, "grp", labels, within, weight="n")
    for positive_, test in ((1, "odds_true"), (0, "odds_false")):
        add(odds.where(F.col("positive") == positive_), {test: "chi2"}, "dof")
    add(fa.calibration(grouped, [*within, "grp"], weight="n"), {f"calibration_{c}": c for c in ("bias", "slope", "intercept", "ece")})
    add(fa.ordinal_bias(grouped, "grp", within, weight="n"), {"ordinal_mean": "mean_error", "ordinal_std": "std_error", "ordinal_median": "median_error", "ordinal_over": "over_rate", "ordinal_under": "under_rate", "ordinal_exact": "exact_rate"})
    add(inf.kruskal(grouped, "grp", "ordinal_error", within, weight="n"), {"kruskal": "h"}, "dof")
    add(fa.direction_test(grouped, "grp", within, weight="n"), {"direction": "chi2"}, "dof")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


#: Tests with a p-value, and the distribution that gives it.
TESTED = {"two_proportion": "z", "mcnemar": "chi2", "parity": "chi2", "odds_true": "chi2", "odds_false": "chi2", "kruskal": "chi2", "direction": "chi2"}


def stats_report(df: DataFrame, positive: str = "High Growth", by: tuple[str, ...] = ("provider", "model"), keys: tuple[str, ...] = ("subject_id", "run_idx"), alpha: float = 0.05) -> DataFrame:
    """``statistics`` with p, and the corrected p_* and reject_*.

    All p-values but those among cities are one family, as in the surveyed
    report; statistics without a test have null p and are never rejected.
    """
    by = list(by)
    found = stored(statistics(df, positive, tuple(by), keys))
    chi2 = F.col("test").isin([t for t, k in TESTED.items() if k == "chi2"])
    tested = inf.with_p(found.where(chi2), "chi2", "statistic", "dof", name="p").unionByName(inf.with_p(found.where("test = 'two_proportion'"), "z", "statistic", name="p"))
    tested = tested.withColumn("p", F.nanvl("p", F.lit(None).cast("double"))).withColumn("__key", F.concat_ws("/", *by, "condition", "dimension", "grp", "label", "test"))
    city = F.coalesce(F.col("dimension") == "city", F.lit(False))
    out = inf.adjust(tested.where(~city), "p", "__key", alpha=alpha).drop("__key")
    return out.unionByName(tested.where(city).drop("__key"), allowMissingColumns=True).unionByName(found.where(~F.col("test").isin(*TESTED)), allowMissingColumns=True).fillna(False)
