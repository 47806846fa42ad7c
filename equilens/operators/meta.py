"""Study-level meta-analysis: effects in, pooled estimates, heterogeneity and bias checks out.

Studies are rows of (study, effect, se, ...). Pooling is a few sums by group;
a study's influence comes from the totals less its own terms, so leave-one-out
needs no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inference as inf
from . import ordered as od

Z95, Z99 = 1.96, 2.58


def study_effects(df: DataFrame, study: str, group: str, label: str) -> DataFrame:
    """study, n, effect (greatest range over labels of a label's share between groups), and se from the modal shares of the first two groups by name (at least 0.01)."""
    cells = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(study, group, label).agg(F.count("*").alias("o"))
    sizes = cells.groupBy(study, group).agg(F.sum("o").alias("ng"), F.max("o").alias("modal"))
    labels = cells.select(study, label).distinct()
    full = sizes.join(labels, study).join(cells, [study, group, label], "left").withColumn("share", F.coalesce("o", F.lit(0)) / F.col("ng"))
    ranges = full.groupBy(study, label).agg((F.max("share") - F.min("share")).alias("r")).groupBy(study).agg(F.max("r").alias("effect"))
    p = F.col("modal") / F.col("ng")
    two = sizes.withColumn("i", F.row_number().over(Window.partitionBy(study).orderBy(group))).where("i <= 2")
    se = two.groupBy(study).agg(F.greatest(F.lit(0.01), F.sqrt(F.sum(p * (1 - p) / F.col("ng")))).alias("se"))
    n = sizes.groupBy(study).agg(F.sum("ng").alias("n"))
    return n.join(ranges, study).join(se, study).select(study, "n", "effect", "se")


def study_rows(df: DataFrame, study: str, group: str, label: str, model: str) -> DataFrame:
    """``study_effects`` with ci_low, ci_high, z, and the sorted models and groups."""
    lists = df.groupBy(study).agg(F.array_sort(F.collect_set(model)).alias("models"), F.array_sort(F.collect_set(group)).alias("groups"))
    e = study_effects(df, study, group, label).join(lists, study)
    return e.withColumn("ci_low", F.col("effect") - Z95 * F.col("se")).withColumn("ci_high", F.col("effect") + Z95 * F.col("se")).withColumn("z", F.col("effect") / F.col("se"))


def quality(df: DataFrame, study: str, models: str, label: str, facets: list[str], extra: Column | None = None) -> DataFrame:
    """study and quality: points for size (20), models (15), facets with more than one value (15), measures (10 + 5) and label variety (5), and ``extra``, of 100."""
    g = df.groupBy(study).agg(F.count("*").alias("n"), F.countDistinct(models).alias("m"), F.countDistinct(label).alias("l"), *[F.countDistinct(f).alias(f"f{i}") for i, f in enumerate(facets)])
    size = F.when(F.col("n") >= 100, 20).when(F.col("n") >= 50, 15).when(F.col("n") >= 20, 10).otherwise(0)
    variety = F.when(F.col("m") >= 3, 15).when(F.col("m") >= 2, 10).when(F.col("m") >= 1, 5).otherwise(0)
    diverse = sum(((F.col(f"f{i}") > 1).cast("int") for i in range(len(facets))), F.lit(0)) * (15 / max(1, len(facets)))
    points = size + variety + diverse + 15 + F.when(F.col("l") >= 5, 5).otherwise(0) + (extra if extra is not None else F.lit(0))
    return g.select(study, (points / 100.0).alias("quality"))


def _sums(df: DataFrame, by: list[str], effect: str, se: str) -> DataFrame:
    w, y = 1 / (F.col(se) * F.col(se)), F.col(effect)
    return df.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"))


def fixed_effects(df: DataFrame, by: list[str] | tuple = (), effect: str = "effect", se: str = "se") -> DataFrame:
    """by, k, estimate, se, ci_low, ci_high and z by inverse variance."""
    s = _sums(df, list(by), effect, se)
    est, err = F.col("swy") / F.col("sw"), F.sqrt(1 / F.col("sw"))
    return s.select(*by, "k", est.alias("estimate"), err.alias("se"), (est - Z95 * err).alias("ci_low"), (est + Z95 * err).alias("ci_high"), (est / err).alias("z"))


def _tau2(k: Column, sw: Column, sww: Column, swy: Column, swyy: Column) -> tuple[Column, Column]:
    q = F.greatest(F.lit(0.0), swyy - swy * swy / sw)
    c = sw - sww / sw
    return q, F.when((k > 1) & (c > 0), F.greatest(F.lit(0.0), (q - (k - 1)) / c)).otherwise(0.0)


def random_effects(df: DataFrame, by: list[str] | tuple = (), effect: str = "effect", se: str = "se") -> DataFrame:
    """DerSimonian-Laird: by, k, q, tau2, estimate, se, ci_low, ci_high and z."""
    by = list(by)
    s = _sums(df, by, effect, se)
    q, t = _tau2(*[F.col(c) for c in ("k", "sw", "sww", "swy", "swyy")])
    s = s.select(*by, q.alias("q"), t.alias("tau2"))
    joined = df.join(s, by) if by else df.crossJoin(s)  # one row
    w = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    out = joined.groupBy(*by).agg(F.count("*").alias("k"), F.first("q").alias("q"), F.first("tau2").alias("tau2"), (F.sum(w * F.col(effect)) / F.sum(w)).alias("estimate"), F.sqrt(1 / F.sum(w)).alias("se_"))
    e, d = F.col("estimate"), F.col("se_")
    return out.select(*by, "k", "q", "tau2", "estimate", d.alias("se"), (e - Z95 * d).alias("ci_low"), (e + Z95 * d).alias("ci_high"), (e / d).alias("z"))


def heterogeneity(df: DataFrame, by: list[str] | tuple = (), effect: str = "effect", se: str = "se") -> DataFrame:
    """by, k, q, dof, i2 (percent), h, tau and level (low below 25, moderate below 50, substantial below 75, considerable)."""
    r = random_effects(df, by, effect, se)
    dof = F.col("k") - 1
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - dof) / F.col("q") * 100)).otherwise(0.0)
    out = r.select(*by, "k", "q", dof.alias("dof"), i2.alias("i2"), F.when(dof > 0, F.sqrt(F.col("q") / dof)).alias("h"), F.sqrt("tau2").alias("tau"))
    return out.withColumn("level", F.when(F.col("i2") < 25, "low").when(F.col("i2") < 50, "moderate").when(F.col("i2") < 75, "substantial").otherwise("considerable"))


def egger(df: DataFrame, effect: str = "effect", se: str = "se", textbook: bool = False) -> DataFrame:
    """Regression of effect / se on 1 / se: k, intercept, slope, se, t and dof.

    se: of the slope, as the report that this reproduces has it; with ``textbook`` that of the intercept.
    Null below three studies. Where all studies have one se there is no line: intercept and t are null, slope and se NaN.
    An exact line has se 0 and t infinite, or NaN for an intercept of 0.
    """
    d = df.select((1 / F.col(se)).alias("x"), (F.col(effect) / F.col(se)).alias("y"))
    a = d.agg(F.count("*").alias("k"), F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"))
    enough, line, nan = F.col("k") >= 3, F.col("sxx") > 0, F.lit(float("nan"))
    s2 = F.try_divide(F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy")), F.col("k") - 2)
    mean = F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))
    err = F.sqrt(s2 * (F.try_divide(F.lit(1.0), F.col("k")) + mean)) if textbook else F.sqrt(F.try_divide(s2, F.col("sxx")))
    t = F.when(err > 0, F.try_divide(F.col("a"), err)).otherwise(F.when(F.col("a") == 0, nan).otherwise(F.signum("a") * F.lit(float("inf"))))
    return a.select(
        "k", F.when(enough & line, F.col("a")).alias("intercept"), F.when(enough, F.when(line, F.col("b")).otherwise(nan)).alias("slope"), F.when(enough, F.when(line, err).otherwise(nan)).alias("se"),
        F.when(enough & line, t).alias("t"), F.when(enough, F.col("k") - 2).alias("dof"),
    )


def begg(df: DataFrame, effect: str = "effect", se: str = "se") -> DataFrame:
    """Spearman's correlation of effect and variance: n, rho (NaN where all effects or all variances are equal)."""
    return inf.spearman(df.select(F.col(effect).alias("e"), (F.col(se) * F.col(se)).alias("v")), "e", "v")


def fail_safe(df: DataFrame, effect: str = "effect", se: str = "se") -> DataFrame:
    """k, z (of the random-effects estimate), fail_safe_n (null unless |z| > 1.96) and robust (over 5 k + 10)."""
    r = random_effects(df, (), effect, se)
    excess = F.abs("z") - Z95
    n = F.when(F.abs("z") > Z95, excess * excess * F.col("k") / (Z95 * Z95))
    return r.select("k", "z", n.alias("fail_safe_n"), (n > 5 * F.col("k") + 10).alias("robust"))


def subgroups(df: DataFrame, group: str, effect: str = "effect", se: str = "se", least: int = 2) -> DataFrame:
    """Random effects of each subgroup of at least ``least`` studies, with q_between (weighted by numbers of studies) and its dof."""
    r = random_effects(df.where(F.col(group).isNotNull()), [group], effect, se).where(F.col("k") >= least)
    w = Window.partitionBy(F.lit(0))  # one row for each subgroup
    mean = F.sum(F.col("k") * F.col("estimate")).over(w) / F.sum("k").over(w)
    return r.withColumn("__m", mean).withColumn("q_between", F.sum(F.col("k") * F.pow(F.col("estimate") - F.col("__m"), 2)).over(w)).withColumn("dof", F.count("*").over(w) - 1).drop("__m")


def leave_one_out(df: DataFrame, study: str, effect: str = "effect", se: str = "se") -> DataFrame:
    """study, estimate without it, influence (absolute change of the estimate) and influential (over twice the influences' population deviation).

    The totals less a study's own terms give the rest's tau2; only the weighted
    sums under that tau2 need the other studies: each block of studies meets
    each other one in a cell, and two sums a study leave it.
    """
    w, y = 1 / (F.col(se) * F.col(se)), F.col(effect)
    all_ = Window.partitionBy(F.lit(0))
    terms = {"sw": w, "sww": w * w, "swy": w * y, "swyy": w * y * y}
    rest = df.select(F.col(study).alias("study"), *[(F.sum(t).over(all_) - t).alias(k) for k, t in terms.items()], (F.count("*").over(all_) - 1).alias("k"))
    _, t = _tau2(*[F.col(c) for c in ("k", "sw", "sww", "swy", "swyy")])
    taus = rest.select("study", t.alias("tau2"))
    others = df.select(F.col(study).alias("other"), F.col(effect).alias("y"), F.col(se).alias("s"))
    wr = 1 / (F.col("s") * F.col("s") + F.col("tau2"))
    n = od.blocks(df.count(), 4096)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = taus.withColumn("__x", F.pmod(F.xxhash64("study"), F.lit(n)).cast("int")).withColumn("__y", every)
    right = others.withColumn("__y", F.pmod(F.xxhash64("other"), F.lit(n)).cast("int")).withColumn("__x", every)
    est = left.join(right, ["__x", "__y"]).where(F.col("study") != F.col("other")).groupBy("study").agg((F.sum(wr * F.col("y")) / F.sum(wr)).alias("estimate"))
    full = random_effects(df, (), effect, se).select(F.col("estimate").alias("__all"))
    out = est.crossJoin(full).withColumn("influence", F.abs(F.col("estimate") - F.col("__all")))  # one row
    return out.withColumn("influential", F.col("influence") > 2 * F.stddev_pop("influence").over(all_)).select(F.col("study").alias(study), "estimate", "influence", "influential")


def outliers(df: DataFrame, study: str, effect: str = "effect", se: str = "se", limit: float = Z99) -> DataFrame:
    """study and z of studies more than ``limit`` (2.58) standard errors off the random-effects estimate."""
    full = random_effects(df, (), effect, se).select(F.col("estimate").alias("__all"))
    z = (F.col(effect) - F.col("__all")) / F.col(se)
    return df.crossJoin(full).select(study, z.alias("z")).where(F.abs("z") > limit)  # one row


def forest(df: DataFrame, study: str, effect: str = "effect", se: str = "se") -> DataFrame:
    """study, effect, ci_low, ci_high, weight (inverse variance) and marker size 50 + 200 weight / greatest."""
    w = 1 / (F.col(se) * F.col(se))
    size = 50 + 200 * w / F.max(w).over(Window.partitionBy(F.lit(0)))
    return df.select(study, effect, (F.col(effect) - Z95 * F.col(se)).alias("ci_low"), (F.col(effect) + Z95 * F.col(se)).alias("ci_high"), w.alias("weight"), size.alias("size"))


def funnel(df: DataFrame, effect: str = "effect", se: str = "se", steps: int = 100) -> DataFrame:
    """The funnel's lines: se from 0 to the greatest in ``steps`` points, with the estimate's limits at 1.96 and 2.58."""
    full = random_effects(df, (), effect, se).select("estimate").crossJoin(df.agg(F.max(se).alias("top")))  # one row
    out = full.select("estimate", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i * F.col("top") / (steps - 1))).alias("se"))
    lim = lambda z: ((F.col("estimate") - z * F.col("se")), (F.col("estimate") + z * F.col("se")))
    return out.select("se", lim(Z95)[0].alias("low95"), lim(Z95)[1].alias("high95"), lim(Z99)[0].alias("low99"), lim(Z99)[1].alias("high99"))


def hierarchical(df: DataFrame, effect: str = "effect", se: str = "se", steps: int = 200, most: float = 3.0) -> DataFrame:
    """Normal-normal model with a flat prior on the mean and on tau, on a grid of tau: mean_mu, sd_mu, mean_tau, p_positive.

    For each tau the mean's posterior is normal in closed form; grid points are
    weighted by their marginal likelihood. tau runs to ``most`` times the effects' deviation.
    """
    top = df.agg((F.greatest(F.stddev_samp(effect), F.lit(1e-6)) * most).alias("top"))
    grid = top.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (i + 0.5) * F.col("top") / steps)).alias("tau"))
    v = F.col("s") * F.col("s") + F.col("tau") * F.col("tau")
    s = df.select(F.col(effect).alias("y"), F.col(se).alias("s")).crossJoin(F.broadcast(grid))  # a fixed number of grid points
    g = s.groupBy("tau").agg(F.sum(1 / v).alias("p"), F.sum(F.col("y") / v).alias("py"), F.sum(F.col("y") * F.col("y") / v).alias("pyy"), F.sum(F.log(v)).alias("lv"))
    mu = F.col("py") / F.col("p")
    g = g.withColumn("mu", mu).withColumn("ll", -0.5 * (F.col("lv") + F.log("p") + F.col("pyy") - F.col("py") * mu))
    all_ = Window.partitionBy(F.lit(0))
    g = g.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(all_)))
    from equilens.functions.dist import arrow, norm_cdf

    g = g.withColumn("pos", arrow(norm_cdf, 1)(F.col("mu") * F.sqrt("p")))
    avg = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    return g.agg(avg(F.col("mu")).alias("mean_mu"), F.sqrt(avg(1 / F.col("p") + F.col("mu") * F.col("mu")) - F.pow(avg(F.col("mu")), 2)).alias("sd_mu"), avg(F.col("tau")).alias("mean_tau"), avg(F.col("pos")).alias("p_positive"))
