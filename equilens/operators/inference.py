"""Hypothesis tests as aggregations. Each returns one row per ``by`` (all rows are one group where it is empty).

All tests read their input once, with map-side partial aggregation to a table
of cells; everything after that runs on cells (rank tests write them down first). Null groups, categories and
values are left out. Statistics come with what their p-values need; p-values
are added by ``with_p`` on the final, small frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.functions import dist
from equilens.session import stored

from . import ordered as od


def _present(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def _over(by: list[str], *more: str):
    return Window.partitionBy(*by, *more) if by or more else Window.partitionBy(F.lit(0))


def chi_square(df: DataFrame, row: str, col: str, by: list[str] | tuple = (), yates: bool = True, weight: str | None = None) -> DataFrame:
    """Pearson's chi-squared of a contingency table: by, n, n_rows, n_cols, n_cells (not empty), dof, chi2, cramers_v.

    With one degree of freedom the continuity correction applies (unless
    ``yates`` is off). Empty cells need no rows: the sum of squares over
    expectations is n (sum of o^2 / (r c) - 1). Tables with fewer than two rows
    or columns have chi2 null. ``weight``: a column of counts, where df has cells already.
    """
    by = list(by)
    o, r, c, n = "__o", "__r", "__c", "__n"  # not names that df may have
    cells = _present(df, [*by, row, col]).groupBy(*by, row, col).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias(o))
    cells = cells.withColumn(r, F.sum(o).over(_over(by, row))).withColumn(c, F.sum(o).over(_over(by, col))).withColumn(n, F.sum(o).over(_over(by)))
    o, r, c, n = (F.col(x) for x in (o, r, c, n))
    out = cells.groupBy(*by).agg(
        F.first(n).cast("bigint").alias("n"), F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"), F.count("*").alias("n_cells"),
        (F.first(n) * F.sum(o * o / (r * c)) - F.first(n)).alias("__plain"), F.max(F.abs(o - r * c / n)).alias("__d"), F.sum(o / (r * r)).alias("__sr"), F.sum(o / (c * c)).alias("__sc"),
    )
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    corrected = F.pow(F.col("__d") - F.least(F.lit(0.5), F.col("__d")), 2) * F.col("n") * F.col("__sr") * F.col("__sc")
    chi2 = F.when(dof < 1, None).when((dof == 1) & F.lit(yates), corrected).otherwise(F.greatest(F.lit(0.0), F.col("__plain")))
    out = out.withColumn("dof", dof).withColumn("chi2", chi2)
    least = F.least("n_rows", "n_cols") - 1
    return out.withColumn("cramers_v", F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("n") * least)))).drop("__plain", "__d", "__sr", "__sc")


def _ranked(df: DataFrame, group: str, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Cells by group and value: o rows each, t rows of the value, and the value's average rank."""
    cells = stored(_present(df, [*by, group, value]).groupBy(*by, group, value).agg((F.sum(weight) if weight else F.count("*")).alias("__o")))
    ties = od.cumulated(cells.groupBy(*by, value).agg(F.sum("__o").alias("__t")), by, value, ["__t"])
    ranks = ties.withColumn("__rank", F.col("__t_before") + (F.col("__t") + 1) / 2.0).drop("__t_before")
    return cells.join(ranks, [*by, value])


def kruskal(df: DataFrame, group: str, value: str, by: list[str] | tuple = (), weight: str | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction: by, n, n_groups, dof, h. All values equal: h is 0; fewer than two groups: null. ``weight``: a column of counts."""
    by = list(by)
    ranked = _ranked(df, group, value, by, weight)
    groups = ranked.groupBy(*by, group).agg(F.sum("__o").alias("__ng"), F.sum(F.col("__o") * F.col("__rank")).alias("__rg"))
    ties = ranked.select(*by, value, "__t").distinct().groupBy(*by).agg(F.sum(F.pow("__t", 3) - F.col("__t")).alias("__ties"))
    out = groups.groupBy(*by).agg(F.sum("__ng").alias("n"), F.count("*").alias("n_groups"), F.sum(F.col("__rg") * F.col("__rg") / F.col("__ng")).alias("__s"))
    out = out.join(ties, by) if by else out.crossJoin(ties)  # one row each
    n = F.col("n").cast("double")
    factor = 1 - F.col("__ties") / (n * n * n - n)
    h = 12 / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)
    value_ = F.when(F.col("n_groups") < 2, None).when(factor <= 1e-12, 0.0).otherwise(h / factor)
    return out.withColumn("dof", F.col("n_groups") - 1).withColumn("h", value_).drop("__s", "__ties")


def anova(df: DataFrame, group: str, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """One-way analysis of variance: by, n, n_groups, dof1, dof2, f (null with fewer than two groups or no variance within)."""
    by = list(by)
    x = F.col(value).cast("double")
    groups = _present(df, [*by, group, value]).groupBy(*by, group).agg(F.count("*").alias("ng"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    out = groups.groupBy(*by).agg(F.sum("ng").alias("n"), F.count("*").alias("n_groups"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.sum(F.col("sx") * F.col("sx") / F.col("ng")).alias("sb"))
    between, within = F.col("sb") - F.col("sx") * F.col("sx") / F.col("n"), F.col("sxx") - F.col("sb")
    d1, d2 = F.col("n_groups") - 1, F.col("n") - F.col("n_groups")
    f = F.when((d1 > 0) & (d2 > 0) & (within > 1e-12), (between / d1) / (within / d2))
    return out.select(*by, "n", "n_groups", d1.alias("dof1"), d2.alias("dof2"), f.alias("f"))


def z_two_proportions(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """Pooled z of two proportions; null for empty samples or no variance."""
    p = (s1 + s2) / (n1 + n2)
    var = p * (1 - p) * (1 / n1 + 1 / n2)
    return F.when((n1 > 0) & (n2 > 0) & (var > 0), (s1 / n1 - s2 / n2) / F.sqrt(var))


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * (F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))


def t_pooled(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Student's t with pooled variance (v: sample variances)."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return F.when((n1 > 1) & (n2 > 1) & (pooled > 0), (m1 - m2) / F.sqrt(pooled * (1 / n1 + 1 / n2)))


def t_welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom."""
    a, b = v1 / n1, v2 / n2
    usable = (n1 > 1) & (n2 > 1) & (a + b > 0)
    return F.when(usable, (m1 - m2) / F.sqrt(a + b)), F.when(usable, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-squared (one degree of freedom) of discordant counts with continuity correction; null without discordant pairs."""
    d = F.abs(b - c) - 1
    return F.when(b + c > 0, d * d / (b + c))


def two_sample(df: DataFrame, value: str, side: Column, by: list[str] | tuple = ()) -> DataFrame:
    """Moments of a value on both sides (``side`` true: 1, false: 2; null: left out): by, n1, m1, v1, p1 (population variance), and the same of 2."""
    marked = df.where(F.col(value).isNotNull()).withColumn("__side", side)
    aggs = []
    for k, is_ in ((1, F.col("__side")), (2, ~F.col("__side"))):
        x = F.when(is_, F.col(value).cast("double"))
        aggs += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}"), F.var_pop(x).alias(f"p{k}")]
    return marked.groupBy(*by).agg(*aggs)


def kappa_of_cells(cells: DataFrame, a: str, b: str, by: list[str] | tuple = ()) -> DataFrame:
    """Cohen's kappa from counts ``o`` of label pairs: by, n, agreement, expected, kappa (null where the expected agreement is 1)."""
    by = list(by)
    n = F.sum("o").over(_over(by))
    marked = cells.withColumn("n", n).withColumn("ra", F.sum("o").over(_over(by, a))).withColumn("__same", (F.col(a) == F.col(b)).cast("int") * F.col("o"))
    total = marked.groupBy(*by).agg(F.sum("o").alias("n"), (F.sum("__same") / F.sum("o")).alias("agreement"))
    pa = cells.groupBy(*by, F.col(a).alias("label")).agg(F.sum("o").alias("na"))
    pb = cells.groupBy(*by, F.col(b).alias("label")).agg(F.sum("o").alias("nb"))
    # squares of counts of pairs are beyond 64 bits
    chance = pa.join(pb, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("e"))
    out = total.join(chance, by, "left") if by else total.crossJoin(chance)  # one row each
    e = F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return out.withColumn("expected", e).withColumn("kappa", F.when(e < 1 - 1e-12, (F.col("agreement") - e) / (1 - e))).drop("e")


def spearman(df: DataFrame, x: str, y: str, by: list[str] | tuple = ()) -> DataFrame:
    """Spearman's correlation (average ranks): by, n, rho (NaN where all values of a side are equal)."""
    by = list(by)
    rows = stored(_present(df, [*by, x, y]).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y")))
    for c in ("__x", "__y"):
        ties = od.cumulated(rows.groupBy(*by, c).agg(F.count("*").alias("__t")), by, c, ["__t"])
        rank = ties.select(*by, c, (F.col("__t_before") + (F.col("__t") + 1) / 2.0).alias(f"{c}r"))
        rows = rows.join(rank, [*by, c])
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_sxy("__yr", "__xr").alias("xy"), F.regr_sxx("__yr", "__xr").alias("xx"), F.regr_syy("__yr", "__xr").alias("yy"))
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(*by, "n", F.when(scale > 0, F.try_divide("xy", scale)).when(F.col("n") > 0, float("nan")).alias("rho"))


def adjust(df: DataFrame, p: str, key: str, family: list[str] | tuple = (), alpha: float = 0.05) -> DataFrame:
    """Adds p_bonferroni, p_holm, p_bh, p_by and reject_* by family. Null p-values stay, are never rejected and don't count."""
    family = list(family)
    tested = df.where(F.col(p).isNotNull())
    up = _over(family).orderBy(F.col(p), F.col(key))
    m = F.count("*").over(_over(family))
    ranked = tested.withColumn("__i", F.row_number().over(up)).withColumn("__m", m)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("__m").cast("int")), F.lit(0.0), lambda s, j: s + 1 / j)
    step_down = up.rowsBetween(Window.unboundedPreceding, 0)
    step_up = up.rowsBetween(0, Window.unboundedFollowing)
    one = F.lit(1.0)
    out = (
        ranked.withColumn("p_bonferroni", F.least(one, F.col(p) * F.col("__m")))
        .withColumn("p_holm", F.max(F.least(one, F.col(p) * (F.col("__m") - F.col("__i") + 1))).over(step_down))
        .withColumn("p_bh", F.min(F.least(one, F.col(p) * F.col("__m") / F.col("__i"))).over(step_up))
        .withColumn("p_by", F.min(F.least(one, F.col(p) * F.col("__m") / F.col("__i") * harmonic)).over(step_up))
    )
    methods = ("bonferroni", "holm", "bh", "by")
    for k in methods:
        out = out.withColumn(f"reject_{k}", F.col(f"p_{k}") <= alpha)
    rest = df.where(F.col(p).isNull())
    for k in methods:
        rest = rest.withColumn(f"p_{k}", F.lit(None).cast("double")).withColumn(f"reject_{k}", F.lit(False))
    return out.drop("__i", "__m").unionByName(rest)


def with_p(df: DataFrame, kind: str, *columns: str, name: str = "p_value") -> DataFrame:
    """Adds the p-value of a statistic. kind and columns: z (z), chi2 (statistic, dof), t (t, dof), f (f, dof1, dof2)."""
    of = {"z": dist.norm_p2_col, "chi2": dist.chi2_sf_col, "t": dist.t_p2_col, "f": dist.f_sf_col}[kind]
    return df.withColumn(name, of(*[F.col(c).cast("double") for c in columns]))
