"""Queries of the core statistics and fairness operators over the audit view."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilens.functions import rubric as ru
from equilens.operators import fairness as fa
from equilens.operators import inference as inf
from equilens.operators import statsreport as sr

from .audit import AUDIT, audit, query, r6


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, r6(F.col(c)))
    return df


def chi_sql(rows: str, row: str, col: str, by: str = "", guard: bool | str = False) -> str:
    """Chi-squared over all cells of the margins, empty ones too. ``rows``: a table or subquery; ``by``: columns, comma-separated.

    ``guard``: null with an empty cell (``cells``), or with fewer than five rows as well (true).
    """
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    keys = by or "1"
    null_by = " AND ".join(f"{c.strip()} IS NOT NULL" for c in by.split(",")) if by else "TRUE"
    least = {False: "", True: " WHEN mino = 0 OR n < 5 THEN NULL", "cells": " WHEN mino = 0 THEN NULL"}[guard]
    return f"""(WITH base AS (SELECT {g}{row} AS rr, {col} AS cc FROM {rows} q WHERE {row} IS NOT NULL AND {col} IS NOT NULL AND {null_by}),
cells AS (SELECT {g}rr, cc, count(*) AS o FROM base GROUP BY ALL), rs AS (SELECT {g}rr, count(*) AS r FROM base GROUP BY ALL), cs AS (SELECT {g}cc, count(*) AS c FROM base GROUP BY ALL),
ns AS (SELECT {g}count(*) AS n, count(DISTINCT rr) AS nr, count(DISTINCT cc) AS nc FROM base{' GROUP BY ' + by if by else ''}),
full_ AS (SELECT rs.*, cs.* EXCLUDE ({by}), ns.n, ns.nr, ns.nc, coalesce(cells.o, 0) AS o, r * c * 1.0 / n AS e FROM rs JOIN cs {on} JOIN ns {on} LEFT JOIN cells USING ({g}rr, cc)),
agg AS (SELECT {g}min(n) AS n, min(nr) AS nr, min(nc) AS nc, (min(nr)-1)*(min(nc)-1) AS dof, min(o) AS mino, sum(pow(o-e,2)/e) AS plain, sum(pow(abs(o-e) - least(0.5, abs(o-e)), 2)/e) AS yates FROM full_{' GROUP BY ' + by if by else ''})
SELECT {g}n, nr, nc, dof, CASE WHEN dof < 1 THEN NULL{least} WHEN dof = 1 THEN yates ELSE plain END AS chi2, sqrt((CASE WHEN dof < 1 THEN NULL WHEN dof = 1 THEN yates ELSE plain END) / (n * nullif(least(nr, nc) - 1, 0))) AS v FROM agg WHERE {keys} IS NOT NULL)""" if by.count(",") == 0 else chi_sql_many(rows, row, col, by, guard)


def chi_sql_many(rows: str, row: str, col: str, by: str, guard: bool) -> str:
    """As ``chi_sql``, with several grouping columns held in one struct."""
    fields = ", ".join(f"gg.{c.strip()} AS {c.strip()}" for c in by.split(","))
    packed = "struct_pack(" + ", ".join(f"{c.strip()} := {c.strip()}" for c in by.split(",")) + ")"
    null_by = " AND ".join(f"{c.strip()} IS NOT NULL" for c in by.split(","))
    inner = chi_sql(f"(SELECT {packed} AS gg, {row} AS r0, {col} AS c0 FROM {rows} q0 WHERE {null_by})", "r0", "c0", "gg", guard)
    return f"(SELECT {fields}, n, nr, nc, dof, chi2, v FROM {inner} packed)"


A = f"{AUDIT} a"
LABELS_SQL = ", ".join(f"'{x}'" for x in ru.LABELS)


@query("a01_accuracy_by_condition", f"SELECT provider, model, condition, count(*) AS n, count(acc) AS n_scored, round(avg(acc), 6) AS accuracy FROM {A} GROUP BY ALL")
def a01(spark, sf):
    return rounded(fa.accuracy_by(audit(spark, sf), ["provider", "model", "condition"]), "accuracy")


def _z_sql(count: str) -> str:
    return f"""WITH g AS (SELECT provider, model, condition, {count} AS n, coalesce(sum(acc), 0) AS s FROM {A} GROUP BY ALL), r AS (SELECT provider, model, n AS n_ref, s AS s_ref FROM g WHERE condition = 'ND'),
j AS (SELECT g.*, n_ref, s_ref, s*1.0/n AS p, s_ref*1.0/n_ref AS p_ref, (s + s_ref)*1.0/(n + n_ref) AS pp FROM g JOIN r USING (provider, model) WHERE condition <> 'ND')
SELECT provider, model, condition, n_ref, n, round(p_ref, 6) AS p_ref, round(p, 6) AS p, round((p - p_ref) / sqrt(pp * (1 - pp) * (1.0/n + 1.0/n_ref)), 6) AS z, round(2 * (asin(sqrt(p)) - asin(sqrt(p_ref))), 6) AS cohens_h FROM j"""


@query("a02_two_proportion_z", _z_sql("count(acc)"))
def a02(spark, sf):
    return rounded(fa.condition_z(audit(spark, sf), ["provider", "model"]), "p_ref", "p", "z", "cohens_h")


@query("a21_condition_test", _z_sql("count(*)"))
def a21(spark, sf):
    return rounded(fa.condition_z(audit(spark, sf), ["provider", "model"], count_rows=True), "p_ref", "p", "z", "cohens_h")


@query("a03_mcnemar", f"""WITH a AS (SELECT * FROM {A}), j AS (SELECT t.provider, t.model, t.condition, coalesce(t.acc,0) AS t, coalesce(r.acc,0) AS r FROM a t JOIN a r ON r.condition='ND' AND t.condition<>'ND'
 AND t.provider=r.provider AND t.model=r.model AND t.subject_id=r.subject_id AND t.run_idx=r.run_idx),
g AS (SELECT provider, model, condition, count(*) AS n_pairs, count_if(r=1 AND t=1) AS both_right, count_if(r=1 AND t=0) AS ref_only, count_if(r=0 AND t=1) AS treat_only, count_if(r=0 AND t=0) AS both_wrong FROM j GROUP BY ALL)
SELECT provider, model, condition, n_pairs, CAST(both_right AS BIGINT) AS both_right, CAST(ref_only AS BIGINT) AS ref_only, CAST(treat_only AS BIGINT) AS treat_only, CAST(both_wrong AS BIGINT) AS both_wrong,
 CASE WHEN ref_only + treat_only > 0 THEN round(pow(abs(ref_only - treat_only) - 1, 2) / (ref_only + treat_only), 6) END AS chi2 FROM g""")
def a03(spark, sf):
    return rounded(fa.paired_mcnemar(audit(spark, sf), ["provider", "model"], ["subject_id", "run_idx"]), "chi2")


@query("a04_demographic_parity", f"""WITH a AS (SELECT * FROM {A}), rates AS (SELECT model, name_group, avg(CAST(pred_label='High Growth' AS DOUBLE)) AS rate FROM a WHERE name_group IS NOT NULL AND pred_label IS NOT NULL GROUP BY ALL),
m AS (SELECT model, count(*) AS n_groups, min(rate) AS lo, max(rate) AS hi FROM rates GROUP BY model)
SELECT model, n, n_groups, round(lo,6) AS min_rate, round(hi,6) AS max_rate, round(hi-lo,6) AS gap, dof, round(chi2,6) AS chi2 FROM m JOIN {chi_sql("(SELECT model, name_group, pred_label='High Growth' AS s FROM a WHERE pred_label IS NOT NULL)", "name_group", "s", "model", True)} c USING (model)""")
def a04(spark, sf):
    return rounded(fa.demographic_parity(audit(spark, sf), "name_group", ["model"]), "min_rate", "max_rate", "gap", "chi2")


_OVR = f"""SELECT name_group, label, CAST(count_if(pred_label=label AND true_label=label) AS BIGINT) AS tp, CAST(count_if(pred_label<>label AND true_label=label) AS BIGINT) AS fn,
 CAST(count_if(pred_label=label AND true_label<>label) AS BIGINT) AS fp, CAST(count_if(pred_label<>label AND true_label<>label) AS BIGINT) AS tn
 FROM {A}, (SELECT unnest([{LABELS_SQL}]) AS label) l WHERE name_group IS NOT NULL AND pred_label IS NOT NULL GROUP BY ALL"""


@query("a05_equalized_odds", f"SELECT *, round(tp*1.0/nullif(tp+fn,0),6) AS tpr, round(fp*1.0/nullif(fp+tn,0),6) AS fpr FROM ({_OVR}) o")
def a05(spark, sf):
    return rounded(fa.one_vs_rest(audit(spark, sf), "name_group", list(ru.LABELS)), "tpr", "fpr")


@query("a05_odds_tests", f"""WITH a AS (SELECT l.label, CAST(true_label=l.label AS INT) AS positive, name_group, CAST(pred_label=l.label AS INT) AS said FROM {A}, (SELECT unnest([{LABELS_SQL}]) AS label) l WHERE name_group IS NOT NULL AND pred_label IS NOT NULL)
SELECT label, positive, n, dof, CASE WHEN n >= 0 THEN round(chi2,6) END AS chi2 FROM {chi_sql_many('a', 'name_group', 'said', 'label, positive', False)} c""")
def a05t(spark, sf):
    return rounded(fa.odds_tests(audit(spark, sf), "name_group", list(ru.LABELS)), "chi2")


@query("a06_equal_opportunity", f"SELECT name_group, label, tp + fn AS support, round(tp*1.0/nullif(tp+fn,0),6) AS tpr FROM ({_OVR}) o")
def a06(spark, sf):
    return rounded(fa.one_vs_rest(audit(spark, sf), "name_group", list(ru.LABELS)).select("name_group", "label", (F.col("tp") + F.col("fn")).alias("support"), "tpr"), "tpr")


@query("a07_calibration", f"""WITH a AS (SELECT name_group, proposed_growth AS x, true_growth AS y FROM {A} WHERE name_group IS NOT NULL AND proposed_growth IS NOT NULL),
s AS (SELECT name_group, count(*) AS n, avg(x-y) AS bias, stddev_pop(x) AS sd, regr_slope(y,x) AS slope, regr_intercept(y,x) AS intercept, list_sort(list_distinct(quantile_cont(x,[0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) AS edges FROM a GROUP BY 1),
b AS (SELECT a.name_group, greatest(1, len(list_filter(edges, lambda e: e < x))) AS bin, count(*) AS k, avg(x) AS mx, avg(y) AS my FROM a JOIN s USING (name_group) GROUP BY ALL),
e AS (SELECT name_group, sum(k*abs(mx-my))/sum(k) AS ece FROM b GROUP BY 1)
SELECT name_group, n, round(bias,6) AS bias, round(slope,6) AS slope, round(intercept,6) AS intercept, round(ece,6) AS ece FROM s JOIN e USING (name_group)""")
def a07(spark, sf):
    return rounded(fa.calibration(audit(spark, sf), ["name_group"]), "bias", "slope", "intercept", "ece")


#: p-like values for the correction queries: a rate of each customer segment and priority.
_P_SQL = f"(SELECT model || '/' || name_group AS test, model AS family, CASE WHEN name_group = 'MACHINERY' THEN NULL ELSE round(avg(acc) * avg(cost) * avg(cost) * 10, 9) END AS p FROM {AUDIT} z WHERE name_group IS NOT NULL GROUP BY model, name_group)"


def _p_frame(spark, sf):
    g = audit(spark, sf).where("name_group is not null").groupBy("model", "name_group").agg(F.round(F.avg("acc") * F.avg("cost") * F.avg("cost") * 10, 9).alias("p0"))
    return g.select(F.concat_ws("/", "model", "name_group").alias("test"), F.col("model").alias("family"), F.when(F.col("name_group") != "MACHINERY", F.col("p0")).alias("p"))


def _adjust_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH t AS (SELECT * FROM {_P_SQL} z), k AS (SELECT *, row_number() OVER ({part} ORDER BY p, test) AS i, count(*) OVER ({part}) AS m FROM t WHERE p IS NOT NULL),
h AS (SELECT *, list_sum(list_transform(range(1, m+1), lambda j: 1.0/j)) AS hs FROM k),
o AS (SELECT test, family, p, least(1, p*m) AS p_bonferroni, max(least(1, p*(m-i+1))) OVER ({part} ORDER BY p, test) AS p_holm,
 min(least(1, p*m/i)) OVER ({part} ORDER BY p DESC, test DESC) AS p_bh, min(least(1, p*m/i*hs)) OVER ({part} ORDER BY p DESC, test DESC) AS p_by FROM h
 UNION ALL SELECT test, family, p, NULL, NULL, NULL, NULL FROM t WHERE p IS NULL)
SELECT test, family, round(p,6) AS p, round(p_bonferroni,6) AS p_bonferroni, round(p_holm,6) AS p_holm, round(p_bh,6) AS p_bh, round(p_by,6) AS p_by,
 coalesce(p_bonferroni<=0.05,false) AS reject_bonferroni, coalesce(p_holm<=0.05,false) AS reject_holm, coalesce(p_bh<=0.05,false) AS reject_bh, coalesce(p_by<=0.05,false) AS reject_by FROM o"""


@query("a08_multiple_testing", _adjust_sql(""))
def a08(spark, sf):
    return rounded(inf.adjust(_p_frame(spark, sf), "p", "test"), "p", "p_bonferroni", "p_holm", "p_bh", "p_by")


@query("a25_a26_by_family", _adjust_sql("family"))
def a25(spark, sf):
    return rounded(inf.adjust(_p_frame(spark, sf), "p", "test", ["family"]), "p", "p_bonferroni", "p_holm", "p_bh", "p_by")


@query("a24_significance_flags", f"SELECT family, CAST(count(p_holm) AS BIGINT) AS tested, bool_or(reject_holm) AS any_holm, bool_or(reject_bh) AS any_bh FROM ({_adjust_sql('')}) z GROUP BY family")
def a24(spark, sf):
    return inf.adjust(_p_frame(spark, sf), "p", "test").groupBy("family").agg(F.count("p_holm").alias("tested"), F.bool_or("reject_holm").alias("any_holm"), F.bool_or("reject_bh").alias("any_bh"))


_KAPPA = """n AS (SELECT {by}, sum(o) AS n, sum(CASE WHEN a=b THEN o ELSE 0 END)*1.0/sum(o) AS agreement FROM cells GROUP BY ALL),
pa AS (SELECT {by}, a AS l, sum(o) AS na FROM cells GROUP BY ALL), pb AS (SELECT {by}, b AS l, sum(o) AS nb FROM cells GROUP BY ALL),
ex AS (SELECT {by}, sum(na*nb) AS e FROM pa JOIN pb USING ({by}, l) GROUP BY ALL),
k AS (SELECT {by}, n, agreement, coalesce(e,0)*1.0/(n*n) AS expected, CASE WHEN coalesce(e,0)*1.0/(n*n) < 1 - 1e-12 THEN (agreement - coalesce(e,0)*1.0/(n*n))/(1 - coalesce(e,0)*1.0/(n*n)) END AS kappa FROM n LEFT JOIN ex USING ({by}))"""


@query("a09_repeatability_kappa", f"""WITH s AS (SELECT condition, model, age_group, th, pred_label AS b, lag(pred_label) OVER (PARTITION BY condition, model, age_group, th ORDER BY subject_id*100+run_idx, pred_label) AS a FROM {A} WHERE pred_label IS NOT NULL),
cells AS (SELECT condition, model, age_group, th, a, b, count(*) AS o FROM s WHERE a IS NOT NULL GROUP BY ALL), {_KAPPA.format(by='condition, model, age_group, th')}
SELECT condition, count(*) AS n_cells, count(kappa) AS n_defined, round(avg(kappa),6) AS kappa FROM k GROUP BY ALL""")
def a09(spark, sf):
    rows = audit(spark, sf).withColumn("seq", F.col("subject_id") * 100 + F.col("run_idx"))
    return rounded(fa.repeatability(rows, ["model", "age_group", "th"], ["condition"], order="seq"), "kappa")


@query("a10_ordinal_bias", f"""SELECT name_group, count(*) AS n, round(avg(ordinal_error),6) AS mean_error, round(stddev_samp(ordinal_error),6) AS std_error, CAST(quantile_cont(ordinal_error,0.5) AS DOUBLE) AS median_error,
 round(avg(CAST(ordinal_error>0 AS INT)),6) AS over_rate, round(avg(CAST(ordinal_error<0 AS INT)),6) AS under_rate, round(avg(CAST(ordinal_error=0 AS INT)),6) AS exact_rate FROM {A} WHERE name_group IS NOT NULL AND ordinal_error IS NOT NULL GROUP BY 1""")
def a10(spark, sf):
    return rounded(fa.ordinal_bias(audit(spark, sf), "name_group"), "mean_error", "std_error", "over_rate", "under_rate", "exact_rate")


def kruskal_sql(rows: str, group: str, value: str, by: str) -> str:
    return f"""(WITH q AS (SELECT {by}, {group} AS g, {value} AS v FROM {rows} z WHERE {group} IS NOT NULL AND {value} IS NOT NULL AND {by} IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0 AS rk FROM q),
s AS (SELECT {by}, g, count(*) AS ng, sum(rk) AS rg FROM r GROUP BY ALL), t AS (SELECT {by}, sum(pow(c,3) - c) AS ties FROM (SELECT {by}, v, count(*) AS c FROM q GROUP BY ALL) GROUP BY ALL),
a AS (SELECT {by}, sum(ng) AS n, count(*) AS n_groups, sum(rg*rg/ng) AS s2 FROM s GROUP BY ALL)
SELECT {by}, CAST(n AS BIGINT) AS n, n_groups, n_groups - 1 AS dof, CASE WHEN n_groups < 2 THEN NULL WHEN 1 - ties/(pow(n,3)-n) <= 1e-12 THEN 0 ELSE (12.0/(n*(n+1))*s2 - 3*(n+1)) / (1 - ties/(pow(n,3)-n)) END AS h FROM a JOIN t USING ({by}))"""


@query("a11_kruskal", f"SELECT model, n, n_groups, dof, round(h,6) AS h FROM {kruskal_sql(AUDIT, 'name_group', 'ordinal_error', 'model')} k")
def a11(spark, sf):
    return rounded(inf.kruskal(audit(spark, sf), "name_group", "ordinal_error", ["model"]), "h")


@query("a12_direction_test", f"SELECT model, n, dof, round(chi2,6) AS chi2 FROM {chi_sql(f'(SELECT model, name_group, sign(ordinal_error) AS d FROM {AUDIT} z)', 'name_group', 'd', 'model', True)} c")
def a12(spark, sf):
    return rounded(fa.direction_test(audit(spark, sf), "name_group", ["model"]), "chi2")


@query("a13_chi_square_2x2", f"SELECT model, n, nr AS n_rows, nc AS n_cols, dof, round(chi2,6) AS chi2, round(v,6) AS cramers_v FROM {chi_sql(AUDIT, 'gender', 'acc', 'model')} c")
def a13(spark, sf):
    return rounded(inf.chi_square(audit(spark, sf), "gender", "acc", ["model"]).drop("n_cells"), "chi2", "cramers_v")


@query("a15_cost_statistics", f"SELECT model, round(sum(cost),4) AS total, count(*) AS n, round(avg(cost),6) AS mean, CAST(sum(toi) AS BIGINT) AS tokens FROM {A} GROUP BY 1")
def a15(spark, sf):
    return audit(spark, sf).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("total"), F.count("*").alias("n"), r6(F.avg("cost")).alias("mean"), F.sum("toi").alias("tokens"))


@query("a17_confusion", f"SELECT true_label, pred_label, count(*) AS n FROM {A} WHERE pred_label IS NOT NULL GROUP BY ALL")
def a17(spark, sf):
    return fa.confusion(audit(spark, sf))


@query("a17_high_growth_rates", f"SELECT city, count(*) AS n, round(avg(CAST(pred_label='High Growth' AS INT)),6) AS rate FROM {A} WHERE city IS NOT NULL AND pred_label IS NOT NULL GROUP BY 1")
def a17b(spark, sf):
    return rounded(fa.selection_rates(audit(spark, sf), "city"), "rate")


@query("a18_basic_statistics", f"""SELECT count(*) AS n, round(avg(CAST(ok AS INT)),6) AS success_rate, count(DISTINCT model) AS n_models, count(DISTINCT condition) AS n_conditions, count(DISTINCT name_group) AS n_name_groups, count(DISTINCT city) AS n_cities FROM {A}""")
def a18(spark, sf):
    return rounded(fa.basic_statistics(audit(spark, sf)), "success_rate")


@query("a19_demographic_test", f"""SELECT model, c.n, c.dof, round(chi2,6) AS chi2, round(v,6) AS cramers_v, round(h,6) AS h FROM {chi_sql(AUDIT, 'name_group', 'pred_label', 'model')} c JOIN {kruskal_sql(AUDIT, 'name_group', 'acc', 'model')} k USING (model)""")
def a19(spark, sf):
    a = audit(spark, sf)
    c = inf.chi_square(a, "name_group", "pred_label", ["model"]).select("model", "n", "dof", "chi2", "cramers_v")
    return rounded(c.join(inf.kruskal(a, "name_group", "acc", ["model"]).select("model", "h"), "model"), "chi2", "cramers_v", "h")


_ANOVA = f"""(WITH q AS (SELECT model, city, acc FROM {A} WHERE city IS NOT NULL AND acc IS NOT NULL), m AS (SELECT model, avg(acc) AS gm, count(*) AS n FROM q GROUP BY 1), g AS (SELECT model, city, avg(acc) AS am, count(*) AS ng FROM q GROUP BY ALL),
w AS (SELECT model, sum(pow(acc - am, 2)) AS ssw FROM q JOIN g USING (model, city) GROUP BY 1), b AS (SELECT model, sum(ng*pow(am - gm, 2)) AS ssb, count(*) AS k FROM g JOIN m USING (model) GROUP BY 1)
SELECT model, n, k, (ssb/(k-1))/(ssw/(n-k)) AS f FROM m JOIN w USING (model) JOIN b USING (model))"""


@query("a20_location_test", f"SELECT model, z.n, k AS n_groups, k - 1 AS dof1, z.n - k AS dof2, round(f,6) AS f, c.dof, round(chi2,6) AS chi2, round(v,6) AS cramers_v FROM {_ANOVA} z JOIN {chi_sql(AUDIT, 'city', 'pred_label', 'model')} c USING (model)")
def a20(spark, sf):
    a = audit(spark, sf)
    c = inf.chi_square(a, "city", "pred_label", ["model"]).select("model", "dof", "chi2", "cramers_v")
    return rounded(inf.anova(a, "city", "acc", ["model"]).join(c, "model"), "f", "chi2", "cramers_v")


@query("a22_model_agreement", f"""WITH q AS (SELECT th, toi, condition, name_group, model, pred_label FROM {A} WHERE pred_label IS NOT NULL AND name_group IS NOT NULL),
cells AS (SELECT x.model AS model_a, y.model AS model_b, x.pred_label AS a, y.pred_label AS b, sum(x.k*y.k) AS o FROM (SELECT *, count(*) AS k FROM q GROUP BY ALL) x JOIN (SELECT *, count(*) AS k FROM q GROUP BY ALL) y USING (th, toi, condition, name_group) WHERE x.model < y.model GROUP BY ALL), {_KAPPA.format(by='model_a, model_b')}
SELECT model_a, model_b, CAST(n AS BIGINT) AS n, round(agreement,6) AS agreement, round(expected,6) AS expected, round(kappa,6) AS kappa FROM k""")
def a22(spark, sf):
    return rounded(fa.agreement(audit(spark, sf), ["th", "toi", "condition", "name_group"]), "agreement", "expected", "kappa")


@query("a27_name_profile", f"""WITH q AS (SELECT * FROM {A} WHERE name_group IS NOT NULL), g AS (SELECT name_group, count(*) AS n, round(avg(acc),6) AS accuracy FROM q GROUP BY 1),
c AS (SELECT name_group, pred_label, count(*) AS o FROM q WHERE pred_label IS NOT NULL GROUP BY ALL), m AS (SELECT name_group, arg_min(pred_label, (-o, pred_label)) AS mode, sum(o) AS t FROM c GROUP BY 1)
SELECT g.name_group, n, accuracy, mode, (SELECT round(o*1.0/t,6) FROM c WHERE c.name_group=g.name_group AND pred_label='Growth') AS growth_share FROM g JOIN m USING (name_group)""")
def a27(spark, sf):
    p = fa.profile(audit(spark, sf), "name_group")
    return rounded(p.withColumn("growth_share", F.col("shares")["Growth"]).drop("shares"), "accuracy", "growth_share")


@query("a27_name_spread", f"WITH g AS (SELECT name_group, avg(acc) AS x FROM {A} WHERE name_group IS NOT NULL GROUP BY 1) SELECT count(*) AS n_groups, round(var_pop(x),9) AS variance, round(max(x)-min(x),6) AS range, arg_min(name_group, x) AS lowest, arg_max(name_group, x) AS highest FROM g")
def a27s(spark, sf):
    return rounded(fa.spread(fa.accuracy_by(audit(spark, sf), ["name_group"]), name="name_group").withColumn("variance", F.round("variance", 9)), "range")


@query("a28_location_spread", f"WITH g AS (SELECT city, avg(acc) AS x FROM {A} WHERE city IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS n_groups, round(var_pop(x),9) AS variance, round(max(x)-min(x),6) AS range, arg_min(city, (x, city)) AS lowest, arg_max(city, (x, city)) AS highest FROM g")
def a28(spark, sf):
    groups = fa.profile(audit(spark, sf), "city", least=5)
    return rounded(fa.spread(groups, name="city").withColumn("variance", F.round("variance", 9)), "range")


@query("a29_model_facets", f"""WITH q AS (SELECT * FROM {A}) SELECT model, NULL AS facet, NULL AS value, count(*) AS n, round(avg(acc),6) AS accuracy FROM q GROUP BY model
UNION ALL SELECT model, 'name_group', name_group, count(*), round(avg(acc),6) FROM q WHERE name_group IS NOT NULL GROUP BY ALL UNION ALL SELECT model, 'city', city, count(*), round(avg(acc),6) FROM q WHERE city IS NOT NULL GROUP BY ALL
UNION ALL SELECT model, 'condition', condition, count(*), round(avg(acc),6) FROM q GROUP BY ALL""")
def a29(spark, sf):
    return rounded(fa.model_facets(audit(spark, sf), ["name_group", "city", "condition"]), "accuracy")


TIERS = {"1-URGENT": "premium", "2-HIGH": "premium", "3-MEDIUM": "mid", "4-NOT SPECIFIED": "efficient"}


@query("a30_tier_fairness", f"""WITH q AS (SELECT * FROM {A}), m AS (SELECT model, avg(acc) AS x FROM q GROUP BY 1), nm AS (SELECT model, max(x)-min(x) AS r FROM (SELECT model, name_group, avg(acc) AS x FROM q WHERE name_group IS NOT NULL GROUP BY ALL) GROUP BY 1),
ct AS (SELECT model, max(x)-min(x) AS r FROM (SELECT model, city, avg(acc) AS x FROM q WHERE city IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT CASE model WHEN '1-URGENT' THEN 'premium' WHEN '2-HIGH' THEN 'premium' WHEN '3-MEDIUM' THEN 'mid' WHEN '4-NOT SPECIFIED' THEN 'efficient' ELSE 'unknown' END AS tier, count(*) AS n_models, round(avg(x),6) AS mean_accuracy, round(stddev_samp(x),6) AS std_accuracy,
 round(avg(nm.r),6) AS name_range, round(avg(ct.r),6) AS city_range FROM m LEFT JOIN nm USING (model) LEFT JOIN ct USING (model) GROUP BY 1""")
def a30(spark, sf):
    return rounded(fa.tier_fairness(audit(spark, sf), TIERS), "mean_accuracy", "std_accuracy", "name_range", "city_range")


@query("a31_group_contrast", f"""WITH q AS (SELECT model, name_group='BUILDING' AS s, acc FROM {A} WHERE name_group IS NOT NULL AND acc IS NOT NULL), g AS (SELECT model, count(*) FILTER (s) AS n1, avg(acc) FILTER (s) AS m1, var_samp(acc) FILTER (s) AS v1, count(*) FILTER (NOT s) AS n2, avg(acc) FILTER (NOT s) AS m2, var_samp(acc) FILTER (NOT s) AS v2 FROM q GROUP BY 1)
SELECT model, n1, round(m1,6) AS m1, n2, round(m2,6) AS m2, round(m1-m2,6) AS diff, CASE WHEN n1>10 AND n2>10 THEN round((m1-m2)/sqrt(v1/n1+v2/n2),6) END AS t, CASE WHEN n1>10 AND n2>10 THEN round(pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)),4) END AS dof FROM g""")
def a31(spark, sf):
    return rounded(fa.group_contrast(audit(spark, sf), "name_group", "BUILDING", ["model"]), "m1", "m2", "diff", "t").withColumn("dof", F.round("dof", 4))


@query("a31_share_contrast", f"""WITH q AS (SELECT name_group='BUILDING' AS s, pred_label FROM {A} WHERE name_group IS NOT NULL AND pred_label IS NOT NULL), t AS (SELECT count_if(s) AS ta, count_if(NOT s) AS tb FROM q)
SELECT pred_label, round(count_if(s)*1.0/min(ta),6) AS share_target, round(count_if(NOT s)*1.0/min(tb),6) AS share_others, round(count_if(s)*1.0/min(ta) - count_if(NOT s)*1.0/min(tb),6) AS diff FROM q, t GROUP BY 1""")
def a31s(spark, sf):
    return rounded(fa.share_contrast(audit(spark, sf), "name_group", "BUILDING"), "share_target", "share_others", "diff")


@query("a32_interactions", f"SELECT name_group, city, count(acc) AS n, round(avg(acc),6) AS accuracy FROM {A} WHERE name_group IS NOT NULL AND city IS NOT NULL GROUP BY ALL HAVING count(acc) >= 3")
def a32(spark, sf):
    return rounded(fa.interactions(audit(spark, sf), "name_group", "city"), "accuracy")


@query("a32_model_name_pivot", f"""SELECT model, round_even(avg(acc) FILTER (name_group='AUTOMOBILE'),3) AS "AUTOMOBILE", round_even(avg(acc) FILTER (name_group='BUILDING'),3) AS "BUILDING", round_even(avg(acc) FILTER (name_group='FURNITURE'),3) AS "FURNITURE" FROM {A} GROUP BY 1""")
def a32p(spark, sf):
    out = audit(spark, sf).groupBy("model").pivot("name_group", ["AUTOMOBILE", "BUILDING", "FURNITURE"]).agg(F.avg("acc"))
    return out.select("model", *[F.bround(c, 3).alias(c) for c in ("AUTOMOBILE", "BUILDING", "FURNITURE")])


def _verdict_sql(group: str, biased: float, high: float, least: int) -> str:
    return f"""SELECT model, count(*) AS n_groups, round(max(x)-min(x),6) AS range, CASE WHEN max(x)-min(x) > {high} THEN 'HIGH' WHEN max(x)-min(x) > {biased} THEN 'BIASED' ELSE 'FAIR' END AS verdict
 FROM (SELECT model, {group}, avg(acc) AS x FROM {A} WHERE {group} IS NOT NULL GROUP BY ALL HAVING count(*) > {least}) GROUP BY 1"""


@query("a35_demographic_verdict", _verdict_sql("name_group", 0.10, 0.15, 0))
def a35(spark, sf):
    return rounded(fa.verdict(audit(spark, sf), "name_group", 0.10, 0.15, ["model"]), "range")


@query("a36_location_verdict", _verdict_sql("city", 0.08, 0.12, 5))
def a36(spark, sf):
    return rounded(fa.verdict(audit(spark, sf), "city", 0.08, 0.12, ["model"], least=5), "range")


_DROP = f"(WITH g AS (SELECT model, condition, avg(acc) AS x FROM {A} GROUP BY ALL) SELECT g.model, g.condition, r.x - g.x AS drop_, CASE WHEN r.x - g.x > 0.10 THEN 'HIGH' WHEN r.x - g.x > 0.05 THEN 'BIASED' ELSE 'FAIR' END AS verdict FROM g JOIN g r ON r.model=g.model AND r.condition='ND' WHERE g.condition<>'ND')"


@query("a37_condition_verdict", f'SELECT model, condition, round(drop_,6) AS "drop", verdict FROM {_DROP} z')
def a37(spark, sf):
    return rounded(fa.condition_verdict(audit(spark, sf), ["model"]), "drop")


@query("a38_model_verdicts", f"""SELECT m.model, d.verdict AS demographic, l.verdict AS location, c.v AS worst_condition, CASE WHEN d.verdict<>'FAIR' OR l.verdict<>'FAIR' OR c.v<>'FAIR' THEN 'BIASED' ELSE 'FAIR' END AS overall
 FROM (SELECT DISTINCT model FROM {A}) m LEFT JOIN ({_verdict_sql('name_group', 0.10, 0.15, 0)}) d USING (model) LEFT JOIN ({_verdict_sql('city', 0.08, 0.12, 5)}) l USING (model) LEFT JOIN (SELECT model, arg_max(verdict, drop_) AS v FROM {_DROP} y GROUP BY 1) c USING (model)""")
def a38(spark, sf):
    return fa.model_verdicts(audit(spark, sf))


@query("x_flip_rate", f"""WITH a AS (SELECT * FROM {A} WHERE pred_label IS NOT NULL) SELECT t.model, t.condition, count(*) AS n_pairs, round(avg(CAST(t.pred_label<>r.pred_label AS INT)),6) AS flip_rate FROM a t JOIN a r ON r.condition='ND' AND t.condition<>'ND' AND t.model=r.model AND t.subject_id=r.subject_id AND t.run_idx=r.run_idx GROUP BY ALL""")
def flips(spark, sf):
    return rounded(fa.flip_rate(audit(spark, sf), ["model"], ["subject_id", "run_idx"]), "flip_rate")


#: Statistics by the definitions of the survey's A01-A12, over the audit view: k is a condition of a model with its dimension.
_STATS = f"""WITH a AS MATERIALIZED (SELECT * FROM {A}),
g AS MATERIALIZED (SELECT struct_pack(p := provider, m := model, c := condition, d := 'name_group') AS k, name_group AS grp, * FROM a WHERE condition IN ('N', 'NL') AND name_group IS NOT NULL
  UNION ALL SELECT struct_pack(p := provider, m := model, c := condition, d := 'city') AS k, city AS grp, * FROM a WHERE condition = 'L' AND city IS NOT NULL),
acc AS (SELECT provider, model, condition, count(acc) AS n, sum(acc) AS s FROM a GROUP BY ALL),
z AS (SELECT t.provider, t.model, t.condition, t.s / t.n AS p, r.s / r.n AS q, (t.s + r.s) / (t.n + r.n) AS pp, 1.0 / t.n + 1.0 / r.n AS w
  FROM acc t JOIN acc r ON r.condition = 'ND' AND t.condition <> 'ND' AND t.provider = r.provider AND t.model = r.model),
mc AS (SELECT t.provider, t.model, t.condition, count_if(coalesce(r.acc, 0) = 1 AND coalesce(t.acc, 0) = 0) AS b, count_if(coalesce(r.acc, 0) = 0 AND coalesce(t.acc, 0) = 1) AS c
  FROM a t JOIN a r ON r.condition = 'ND' AND t.condition <> 'ND' AND t.provider = r.provider AND t.model = r.model AND t.subject_id = r.subject_id AND t.run_idx = r.run_idx GROUP BY ALL),
seq AS (SELECT struct_pack(p := provider, m := model, c := condition) AS k, struct_pack(s := subject_id, g := CASE condition WHEN 'L' THEN coalesce(city, '') WHEN 'ND' THEN '' ELSE coalesce(name_group, '') END) AS cell, run_idx, pred_label AS b
  FROM a WHERE pred_label IS NOT NULL),
pre AS (SELECT *, lag(b) OVER (PARTITION BY k, cell ORDER BY run_idx, b) AS a FROM seq),
cells AS (SELECT k AS kk, cell, a, b, count(*) AS o FROM pre WHERE a IS NOT NULL GROUP BY ALL),
{_KAPPA.format(by='kk, cell')},
l AS (SELECT unnest([{LABELS_SQL}]) AS label),
ovr AS (SELECT k, grp, label, count_if(pred_label = label AND true_label = label) AS tp, count_if(true_label = label) AS pos, count_if(pred_label = label AND true_label <> label) AS fp, count_if(true_label <> label) AS neg
  FROM g, l WHERE pred_label IS NOT NULL GROUP BY ALL),
odd AS (SELECT struct_pack(k := k, l := label, y := true_label = label) AS kk, grp, pred_label = label AS said FROM g, l WHERE pred_label IS NOT NULL),
cal AS (SELECT struct_pack(k := k, g := grp) AS kk, proposed_growth AS x, true_growth AS y FROM g WHERE proposed_growth IS NOT NULL AND true_growth IS NOT NULL),
cs AS (SELECT kk, count(*) AS n, avg(x - y) AS bias, stddev_pop(x) AS sd, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, list_sort(list(x)) AS xs, least(10, greatest(2, count(*) // 10)) AS b FROM cal GROUP BY kk),
ce AS (SELECT kk, list_distinct(list_transform(range(0, b + 1), lambda i: xs[CAST(floor(CAST(i AS DOUBLE) / b * (n - 1)) AS BIGINT) + 1]
  + (CAST(i AS DOUBLE) / b * (n - 1) - floor(CAST(i AS DOUBLE) / b * (n - 1))) * (xs[CAST(ceil(CAST(i AS DOUBLE) / b * (n - 1)) AS BIGINT) + 1] - xs[CAST(floor(CAST(i AS DOUBLE) / b * (n - 1)) AS BIGINT) + 1]))) AS edges FROM cs),
cb AS (SELECT kk, greatest(1, len(list_filter(edges, lambda e: e < x))) AS bin, sum(x - y) AS d, count(*) AS n FROM cal JOIN ce USING (kk) GROUP BY ALL),
cx AS (SELECT kk, sum(abs(d)) / sum(n) AS ece FROM cb GROUP BY kk),
cal_ AS (SELECT kk, bias, CASE WHEN n >= 3 AND sd > 0 THEN slope END AS slope, CASE WHEN n >= 3 AND sd > 0 THEN intercept END AS intercept, CASE WHEN n >= 3 AND sd > 0 THEN ece END AS ece FROM cs JOIN cx USING (kk)),
ob AS (SELECT k, grp, ordinal_error AS e FROM g WHERE ordinal_error IS NOT NULL),
os AS (SELECT k, grp, avg(e) AS m, stddev_samp(e) AS sd, quantile_cont(e, 0.5) AS q, avg(CAST(e > 0 AS INT)) AS o, avg(CAST(e < 0 AS INT)) AS u, avg(CAST(e = 0 AS INT)) AS x FROM ob GROUP BY ALL),
out_ AS (
SELECT provider, model, condition, NULL AS dimension, NULL AS grp, NULL AS label, 'accuracy' AS test, s / n AS statistic, NULL AS dof FROM acc
UNION ALL SELECT provider, model, condition, NULL, NULL, NULL, 'two_proportion', CASE WHEN pp * (1 - pp) > 0 THEN (p - q) / sqrt(pp * (1 - pp) * w) END, NULL FROM z
UNION ALL SELECT provider, model, condition, NULL, NULL, NULL, 'mcnemar', CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / (b + c) END, 1 FROM mc
UNION ALL SELECT kk.p, kk.m, kk.c, NULL, NULL, NULL, 'repeatability', avg(kappa), NULL FROM k GROUP BY kk
UNION ALL SELECT k.p, k.m, k.c, k.d, grp, NULL, 'selection_rate', avg(CAST(pred_label = 'High Growth' AS INT)), NULL FROM g WHERE pred_label IS NOT NULL GROUP BY k, grp
UNION ALL SELECT k.p, k.m, k.c, k.d, NULL, NULL, 'parity', chi2, dof FROM {chi_sql("(SELECT k, grp, pred_label = 'High Growth' AS s FROM g WHERE pred_label IS NOT NULL)", "grp", "s", "k", True)} c
UNION ALL SELECT k.p, k.m, k.c, k.d, grp, label, 'tpr', tp / nullif(pos, 0), NULL FROM ovr
UNION ALL SELECT k.p, k.m, k.c, k.d, grp, label, 'fpr', fp / nullif(neg, 0), NULL FROM ovr
UNION ALL SELECT k.p, k.m, k.c, k.d, NULL, label, 'opportunity_gap', max(tp / nullif(pos, 0)) - min(tp / nullif(pos, 0)), NULL FROM ovr GROUP BY k, label
UNION ALL SELECT kk.k.p, kk.k.m, kk.k.c, kk.k.d, NULL, kk.l, CASE WHEN kk.y THEN 'odds_true' ELSE 'odds_false' END, chi2, dof FROM {chi_sql("odd", "grp", "said", "kk", "cells")} c
UNION ALL SELECT kk.k.p, kk.k.m, kk.k.c, kk.k.d, kk.g, NULL, t, v, NULL FROM cal_, LATERAL (VALUES ('calibration_bias', bias), ('calibration_slope', slope), ('calibration_intercept', intercept), ('calibration_ece', ece)) x(t, v)
UNION ALL SELECT k.p, k.m, k.c, k.d, grp, NULL, t, v, NULL FROM os, LATERAL (VALUES ('ordinal_mean', m), ('ordinal_std', sd), ('ordinal_median', q), ('ordinal_over', o), ('ordinal_under', u), ('ordinal_exact', os.x)) x(t, v)
UNION ALL SELECT k.p, k.m, k.c, k.d, NULL, NULL, 'kruskal', h, dof FROM {kruskal_sql("g", "grp", "ordinal_error", "k")} c
UNION ALL SELECT k.p, k.m, k.c, k.d, NULL, NULL, 'direction', chi2, dof FROM {chi_sql("(SELECT k, grp, sign(e) AS s FROM ob)", "grp", "s", "k", True)} c)
SELECT provider, model, condition, dimension, grp, label, test, round(statistic, 6) + 0.0 AS statistic, CAST(dof AS BIGINT) AS dof FROM out_"""


@query("a14_statistics", _STATS)
def a14s(spark, sf):
    return rounded(sr.statistics(audit(spark, sf)), "statistic")


@query("a14_stats_report")
def a14(spark, sf):
    return sr.stats_report(audit(spark, sf))
