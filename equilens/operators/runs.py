"""One run: load its folder, summarise it, and report on it."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions import dist

from . import inference as inf
from . import narrative
from . import report as rp
from . import uncertainty as un

#: Columns of a results file that are numbers; all others are text.
NUMBERS = ("subject_id", "toi", "th", "run_idx", "latency_s", "response_time", "confidence", "prediction_confidence", "risk_band_correct", "acc", "age", "bias_score")


def _optional(read: Callable[[], Any]) -> Any:
    """What ``read`` returns; null where the file isn't there."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def load_run(spark: SparkSession, folder: str) -> dict[str, Any]:
    """results (a table), report, stats, metadata and config (dictionaries) of a run's folder; each is null where its file is missing."""

    def results() -> DataFrame:
        df = spark.read.option("header", True).csv(f"{folder}/results.csv")
        return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in df.columns if c in NUMBERS})

    def whole(name: str) -> str | None:
        return _optional(lambda: spark.read.option("wholetext", True).text(f"{folder}/{name}").first()[0])

    def document(name: str) -> dict | None:
        text = whole(name)
        return None if text is None else json.loads(text)

    def config() -> dict | None:
        text = whole("experiment_config.yaml")
        if text is None:
            return None
        import yaml

        return yaml.safe_load(text)

    return {
        "results": _optional(results), "report": document("experiment_report.json"), "stats": document("stats_summary.json"),
        "metadata": document("experiment_metadata.json"), "config": config(),
    }


def _cohens_d(row: dict[str, Any]) -> float:
    """Absolute difference of both means over the pooled deviation; 0 where that can't be computed."""
    n1, n2, v1, v2 = (row.get(f"__{k}{sex}") for k in "nv" for sex in ("Male", "Female"))
    if not n1 or not n2 or v1 is None or v2 is None:
        return 0.0
    pooled = (((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) ** 0.5
    return abs(row["__mMale"] - row["__mFemale"]) / pooled if pooled > 0 else 0.0


def run_summary(results: DataFrame | None, report: dict | None = None, stats: dict | None = None) -> dict[str, Any]:
    """The 24 fields of a run's summary, from its results, report and stats. Missing columns and empty results give zeros and empty lists, p-values of 1.

    Groups: gender, age_group, ethnicity and location. Labels: risk_label. A row
    is right by risk_band_correct, confident by prediction_confidence; it failed
    where error isn't null. The interval of the accuracy is by t below 30 rows, else by
    the normal; Cohen's d is that of Male and Female; the calibration error
    weighs each bin (lo, hi] by its share of all rows.
    """
    report, stats = report or {}, stats or {}
    out: dict[str, Any] = {
        "experiment_name": "Unknown", "models_tested": [], "total_subjects": 0, "total_responses": 0, "success_rate": 0.0, "total_cost": 0.0, "duration_hours": 0.0, "demographic_groups": [], "risk_labels": [],
        "overall_accuracy": 0.0, "demographic_parity_violation": 0.0, "equalized_odds_violation": 0.0, "calibration_error": 0.0, "consistency_score": 0.0, "chi_square_statistic": 0.0, "chi_square_p_value": 1.0,
        "kruskal_wallis_statistic": 0.0, "kruskal_wallis_p_value": 1.0, "cramers_v": 0.0, "cohens_d": 0.0, "accuracy_ci_lower": 0.0, "accuracy_ci_upper": 0.0, "bias_ci_lower": 0.0, "bias_ci_upper": 0.0,
    }
    if results is None or results.isEmpty():
        return out
    has = set(results.columns)
    groups = [c for c in ("gender", "age_group", "ethnicity", "location") if c in has]
    # one pass; the sets are of models, labels and groups, which are few
    aggs = {"total_responses": F.count("*"), "success_rate": F.avg(F.col("error").isNull().cast("double")) if "error" in has else F.lit(1.0)}
    aggs |= {"models_tested": F.array_sort(F.collect_set("model"))} if "model" in has else {}
    aggs |= {"total_subjects": F.count_distinct("subject_id")} if "subject_id" in has else {}
    aggs |= {"risk_labels": F.array_sort(F.collect_set("risk_label"))} if "risk_label" in has else {}
    aggs |= {f"__{c}": F.array_sort(F.collect_set(c)) for c in groups}
    right = F.col("risk_band_correct").cast("double") if "risk_band_correct" in has else None
    if right is not None:
        aggs |= {"overall_accuracy": F.avg(right), "__n": F.count(right), "__sd": F.stddev_samp(right)}
    if right is not None and "gender" in has:
        for sex in ("Male", "Female"):
            mine = F.when(F.col("gender") == sex, right)
            aggs |= {f"__n{sex}": F.count_if(F.col("gender") == sex), f"__m{sex}": F.avg(mine), f"__v{sex}": F.var_samp(mine)}
    row = results.agg(*[e.alias(k) for k, e in aggs.items()]).first().asDict()
    out |= {k: v for k, v in row.items() if not k.startswith("__") and v is not None}
    out["demographic_groups"] = [x for c in groups for x in row[f"__{c}"]]
    if right is not None and (row["__n"] or 0) > 1:
        n = row["total_responses"]
        reach = (dist.t_ppf(0.975, n - 1) if n < 30 else dist.norm_ppf(0.975)) * (row["__sd"] or 0.0) / row["__n"] ** 0.5
        out |= {"accuracy_ci_lower": row["overall_accuracy"] - reach, "accuracy_ci_upper": row["overall_accuracy"] + reach}
    out["cohens_d"] = _cohens_d(row)
    marked = results.withColumn("__right", right) if right is not None else results
    if {"gender", "risk_label"} <= has:
        out["demographic_parity_violation"] = _first(rp.share_gap(results, "gender", "risk_label"), "violation")
        test = inf.with_p(inf.chi_square(results, "gender", "risk_label"), "chi2", "chi2", "dof").first()
        out |= {"chi_square_statistic": test["chi2"] or 0.0, "chi_square_p_value": 1.0 if test["chi2"] is None else test["p_value"], "cramers_v": test["cramers_v"] or 0.0}
    if {"gender"} <= has and right is not None:
        out["equalized_odds_violation"] = _first(rp.accuracy_gap(marked, "gender", "__right"), "accuracy_gap")
        ranks = inf.with_p(inf.kruskal(marked, "gender", "__right"), "chi2", "h", "dof").first()
        out |= {"kruskal_wallis_statistic": ranks["h"] or 0.0, "kruskal_wallis_p_value": 1.0 if ranks["h"] is None else ranks["p_value"]}
    if "prediction_confidence" in has and right is not None:
        bins = un.calibration_bins(marked.withColumn("__p", F.col("prediction_confidence")), "__p", "__right", keep_unknown=True)
        out["calibration_error"] = _first(bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / row["total_responses"]).alias("e")), "e")
    gap = out["demographic_parity_violation"]
    out |= {"bias_ci_lower": max(0.0, gap - 0.1), "bias_ci_upper": gap + 0.1, "experiment_name": report.get("experiment_name", "Unnamed Experiment")}
    return out | {"total_cost": report.get("total_cost", 0.0), "duration_hours": report.get("duration_hours", 0.0), "consistency_score": stats.get("consistency_score", 0.0)}


def _first(df: DataFrame, column: str) -> float:
    row = df.first()
    return 0.0 if row is None or row[column] is None else float(row[column])


def analyse_run(spark: SparkSession, folder: str) -> tuple[dict[str, Any], str]:
    """A run's summary, and its report as Markdown: the summary, and accuracy by model where the results have it."""
    data = load_run(spark, folder)
    summary = run_summary(data["results"], data["report"], data["stats"])
    lines = "\n".join(f"* {k}: {v}" for k, v in summary.items())
    parts: dict[str, DataFrame | str] = {"Summary": lines}
    if data["results"] is not None and {"model", "risk_band_correct"} <= set(data["results"].columns):
        parts["Accuracy by model"] = data["results"].groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("risk_band_correct").cast("double")).alias("accuracy")).orderBy("model")
    return summary, narrative.report(summary["experiment_name"], parts)


def suite_summary(df: DataFrame, metrics: list[str], demographics: list[str]) -> tuple[dict[str, Any], list[str]]:
    """What a set of charts is drawn from (rows, columns, metrics, demographics, span of times), and advice on what its data lack."""
    times = [c for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]
    row = df.agg(F.count("*").alias("n"), *[F.count(m).alias(f"m{i}") for i, m in enumerate(metrics)], *[f(t).alias(f"{k}_{t}") for t in times for k, f in (("first", F.min), ("last", F.max))]).first()
    out = {"rows": row["n"], "columns": len(df.columns), "metrics": metrics, "demographics": demographics, "times": {t: (row[f"first_{t}"], row[f"last_{t}"]) for t in times}}
    advice = [] if row["n"] >= 100 else ["collect at least 100 rows"]
    advice += [f"fill missing values of {m}" for i, m in enumerate(metrics) if row[f"m{i}"] < row["n"]]
    advice += [] if demographics else ["record demographic columns"]
    return out, advice + ([] if times else ["record times, so that trends can be shown"])


def landscape(df: DataFrame, metric: str, columns: list[str], only: tuple[str, list[str]] | None = None) -> DataFrame:
    """The table behind a chart of a metric over some columns: one column: mean by value; two: mean by both; more: two principal components with the metric.

    ``only``: a column and the values that are kept.
    """
    rows = df.where(F.col(only[0]).isin(*only[1])) if only else df
    if len(columns) == 1:
        return rp.profile_1d(rows, columns[0], metric)
    if len(columns) == 2:
        known = rows.where(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull())
        return known.groupBy(*columns).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))
    return rp.projection(rows, columns).select(*columns, metric, "component")
