"""Rules and texts at the end of an analysis: small metric frames in, advice and Markdown out (driver side)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import chance, pick


def interventions(spans: DataFrame, kind: str = "kind", value: str = "range", limits: Mapping[str, float] | None = None) -> DataFrame:
    """kind, range, limit and action for every span (demographic, location, accuracy): what to do where a range is over its limit (accuracy: under it)."""
    limits = limits or {"demographic": 0.1, "location": 0.08, "accuracy": 0.6}
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)]
    over = F.when(F.col(kind) == "accuracy", F.col(value) < limit).otherwise(F.col(value) > limit)
    action = F.when(~over, "none").when(F.col(kind) == "demographic", "rebalance demographic cues in prompts and training data").when(F.col(kind) == "location", "remove location cues or test them separately").otherwise("revise the rubric in the prompt")
    return spans.select(kind, value, limit.alias("limit"), action.alias("action"))


#: Sample sizes from which advice and factors change.
SIZES = (100,)


def factors(importances: Mapping[str, float], n: int, family: str, least: float = 0.1) -> list[str]:
    """The three most important features over ``least``, and what the family and a small sample add."""
    top = sorted(importances.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    out = [f"{k} ({v:.2f})" for k, v in top if v > least]
    return out + ([f"model family {family}"] if family != "other" else []) + (["small sample"] if n < SIZES[0] else [])


def mitigations(level: str, n: int) -> list[str]:
    """Advice by risk level and sample size."""
    by_level = {
        "critical": ["do not deploy", "audit every demographic", "retrain or replace the model"], "high": ["review by people", "larger sample before use"],
        "moderate": ["monitor group accuracy"], "low": ["keep the regular audit"],
    }
    return by_level[level] + ([f"collect at least {SIZES[0]} rows"] if n < SIZES[0] else [])


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """A small frame as a Markdown table; a report shows at most ``most`` rows and says so."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most])]
    return "\n".join(lines + (["", f"(first {most} rows)"] if len(rows) > most else []))


def report(title: str, parts: Mapping[str, DataFrame | str]) -> str:
    """Sections of tables and text as one Markdown document."""
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{v if isinstance(v, str) else markdown_table(v)}" for k, v in parts.items())]) + "\n"


def meta_report(studies: DataFrame, effect: str = "effect", se: str = "se") -> str:
    """Pooled effects, heterogeneity and bias checks of studies as Markdown."""
    from . import meta

    return report("Meta-analysis", {
        "Random effects": meta.random_effects(studies, (), effect, se), "Fixed effects": meta.fixed_effects(studies, (), effect, se), "Heterogeneity": meta.heterogeneity(studies, (), effect, se),
        "Publication bias": meta.egger(studies, effect, se), "Fail-safe number": meta.fail_safe(studies, effect, se),
    })


def forecast_report(scores: Mapping[str, Mapping[str, float]], importances: Mapping[str, Mapping[str, float]]) -> str:
    """Trained models as Markdown: each one's scores and its five most important features."""
    if not scores:
        return report("Bias forecast", {"Models": "No trained models."})
    top = lambda kind: sorted(importances.get(kind, {}).items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    return report("Bias forecast", {kind: "\n".join([*(f"* {m}: {v:.3f}" for m, v in own.items()), *(f"* feature {k}: {v:.3f}" for k, v in top(kind))]) for kind, own in scores.items()})


def latex_table(df: DataFrame, most: int = 50) -> str:
    """A small frame as a LaTeX tabular; a report shows at most ``most`` rows and says so."""
    esc = lambda v: ("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    rows = df.limit(most + 1).collect()
    body = "\n".join([*(" & ".join(esc(v) for v in r) + r" \\" for r in rows[:most]), *([f"% first {most} rows"] if len(rows) > most else [])])
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", " & ".join(esc(c) for c in df.columns) + r" \\ \hline", body, r"\end{tabular}"])


def demo_rows(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """A demonstration table in the reporting schema: model, gender, age_group, location, bias_score, accuracy and timestamp."""
    i = F.col("id")
    return spark.range(n).select(
        pick(["model_a", "model_b", "model_c"], i, F.lit(seed)).alias("model"), pick(["Male", "Female", "Other"], i, F.lit(seed + 1)).alias("gender"), pick(["18-30", "31-50", "51+"], i, F.lit(seed + 2)).alias("age_group"),
        pick(["Urban", "Rural"], i, F.lit(seed + 3)).alias("location"), (chance(i, F.lit(seed + 4)) * 0.3).alias("bias_score"), (0.6 + 0.4 * chance(i, F.lit(seed + 5))).alias("accuracy"),
        F.timestamp_seconds(F.lit(1704067200) + i * 3600).alias("timestamp"),
    )
