"""Queries of the meta-analysis operators: studies are nations, groups order states, labels priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilens.operators import meta as me

from .audit import query, table
from .fairness import rounded

O = "(SELECT n_name AS study, n_regionkey AS region, o_orderstatus AS grp, o_orderpriority AS label, c_mktsegment AS model FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)"
ST = f"""(WITH q AS (SELECT * FROM {O} o), c AS (SELECT study, grp, label, count(*) AS o FROM q GROUP BY ALL), s AS (SELECT study, grp, sum(o) AS ng, max(o) AS modal FROM c GROUP BY ALL),
f AS (SELECT s.study, s.grp, l.label, coalesce(c.o,0)*1.0/s.ng AS share FROM s JOIN (SELECT DISTINCT study, label FROM c) l USING (study) LEFT JOIN c ON c.study=s.study AND c.grp=s.grp AND c.label=l.label),
r AS (SELECT study, max(r) AS effect FROM (SELECT study, label, max(share)-min(share) AS r FROM f GROUP BY ALL) GROUP BY 1),
e AS (SELECT study, greatest(0.01, sqrt(sum((modal*1.0/ng)*(1-modal*1.0/ng)/ng))) AS se FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY grp) AS i FROM s) WHERE i<=2 GROUP BY 1)
SELECT study, CAST(n AS BIGINT) AS n, CAST(effect AS DOUBLE) AS effect, CAST(se AS DOUBLE) AS se, 1/(se*se) AS w, region FROM (SELECT study, sum(ng) AS n FROM s GROUP BY 1) JOIN r USING (study) JOIN e USING (study) JOIN (SELECT DISTINCT study, region FROM q) USING (study))"""


def orders(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.select(F.col("n_name").alias("study"), F.col("n_regionkey").alias("region"), F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("label"), F.col("c_mktsegment").alias("model"))


def studies(spark, sf):
    return me.study_effects(orders(spark, sf), "study", "grp", "label")


def _re(by: str) -> str:
    g, on, grp = (f"{by}, ", f"USING ({by})", f"GROUP BY {by}") if by else ("", "ON TRUE", "")
    return f"""(WITH st AS (SELECT * FROM {ST} s), a AS (SELECT {g}count(*) AS k, sum(w) AS sw, sum(w*w) AS sww, sum(w*effect) AS swy, sum(w*effect*effect) AS swyy FROM st {grp}),
t AS (SELECT {g}k, greatest(0, swyy-swy*swy/sw) AS q, CASE WHEN k>1 THEN greatest(0, (greatest(0,swyy-swy*swy/sw)-(k-1))/(sw-sww/sw)) ELSE 0 END AS tau2 FROM a)
SELECT {g}min(k) AS k, min(q) AS q, min(tau2) AS tau2, sum(effect/(se*se+tau2))/sum(1/(se*se+tau2)) AS est, sqrt(1/sum(1/(se*se+tau2))) AS err FROM st JOIN t {on} {grp})"""


def _out(x: str = "") -> str:
    return f"{x}k, round(q,6) AS q, round(tau2,9) AS tau2, round(est,6) AS estimate, round(err,6) AS se, round(est-1.96*err,6) AS ci_low, round(est+1.96*err,6) AS ci_high, round(est/err,5) AS z"


def _round(df):
    return rounded(df, "q", "estimate", "se", "ci_low", "ci_high").withColumn("tau2", F.round("tau2", 9)).withColumn("z", F.round("z", 5))


@query("m01_m02_studies", f"SELECT s.study, n, round(effect,6) AS effect, round(se,6) AS se, round(effect-1.96*se,6) AS ci_low, round(effect+1.96*se,6) AS ci_high, round(effect/se,5) AS z, m.models, m.groups FROM {ST} s JOIN (SELECT study, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM {O} o GROUP BY 1) m USING (study)")
def m01(spark, sf):
    r = me.study_rows(orders(spark, sf), "study", "grp", "label", "model")
    return rounded(r, "effect", "se", "ci_low", "ci_high").withColumn("z", F.round("z", 5)).withColumn("models", F.array_join("models", ",")).withColumn("groups", F.array_join("groups", ","))


@query("m03_quality", f"SELECT study, round((CASE WHEN count(*)>=100 THEN 20 WHEN count(*)>=50 THEN 15 WHEN count(*)>=20 THEN 10 ELSE 0 END + CASE WHEN count(DISTINCT model)>=3 THEN 15 WHEN count(DISTINCT model)>=2 THEN 10 ELSE 5 END + 7.5*(CAST(count(DISTINCT grp)>1 AS INT)+CAST(count(DISTINCT region)>1 AS INT)) + 15 + CASE WHEN count(DISTINCT label)>=5 THEN 5 ELSE 0 END)/100.0,6) AS quality FROM {O} o GROUP BY 1")
def m03(spark, sf):
    return rounded(me.quality(orders(spark, sf), "study", "model", "label", ["grp", "region"]), "quality")


@query("m05_fixed_effects", f"SELECT count(*) AS k, round(sum(w*effect)/sum(w),6) AS estimate, round(sqrt(1/sum(w)),6) AS se, round(sum(w*effect)/sum(w)-1.96*sqrt(1/sum(w)),6) AS ci_low, round(sum(w*effect)/sum(w)+1.96*sqrt(1/sum(w)),6) AS ci_high, round(sum(w*effect)/sum(w)/sqrt(1/sum(w)),5) AS z FROM {ST} s")
def m05(spark, sf):
    return rounded(me.fixed_effects(studies(spark, sf)), "estimate", "se", "ci_low", "ci_high").withColumn("z", F.round("z", 5))


@query("m06_random_effects", f"SELECT {_out()} FROM {_re('')} r")
def m06(spark, sf):
    return _round(me.random_effects(studies(spark, sf)))


@query("m07_heterogeneity", f"SELECT k, round(q,6) AS q, k-1 AS dof, round(CASE WHEN q>0 THEN greatest(0,(q-(k-1))/q*100) ELSE 0 END,5) AS i2, round(sqrt(q/(k-1)),6) AS h, round(sqrt(tau2),6) AS tau, CASE WHEN (q-(k-1))/q*100 < 25 THEN 'low' WHEN (q-(k-1))/q*100 < 50 THEN 'moderate' WHEN (q-(k-1))/q*100 < 75 THEN 'substantial' ELSE 'considerable' END AS level FROM {_re('')} r")
def m07(spark, sf):
    return rounded(me.heterogeneity(studies(spark, sf)), "q", "h", "tau").withColumn("i2", F.round("i2", 5))


@query("m08_egger", f"""WITH d AS (SELECT 1/se AS x, effect/se AS y FROM {ST} s), a AS (SELECT count(*) AS k, regr_intercept(y,x) AS a, regr_slope(y,x) AS b, regr_sxx(y,x) AS sxx, regr_syy(y,x) AS syy, regr_sxy(y,x) AS sxy FROM d)
SELECT k, round(a,5) AS intercept, round(b,5) AS slope, round(sqrt((syy-b*sxy)/(k-2)/sxx),5) AS se, round(a/sqrt((syy-b*sxy)/(k-2)/sxx),4) AS t, k-2 AS dof FROM a""")
def m08(spark, sf):
    e = me.egger(studies(spark, sf))
    return e.select("k", *[F.round(c, 5).alias(c) for c in ("intercept", "slope", "se")], F.round("t", 4).alias("t"), "dof")


@query("m09_begg", f"WITH r AS (SELECT rank() OVER (ORDER BY effect) + (count(*) OVER (PARTITION BY effect)-1)/2.0 AS a, rank() OVER (ORDER BY se*se) + (count(*) OVER (PARTITION BY se*se)-1)/2.0 AS b FROM {ST} s) SELECT count(*) AS n, round(corr(a,b),6) AS rho FROM r")
def m09(spark, sf):
    return rounded(me.begg(studies(spark, sf)), "rho")


@query("m10_fail_safe", f"SELECT k, round(est/err,5) AS z, CASE WHEN abs(est/err)>1.96 THEN round(pow(abs(est/err)-1.96,2)*k/(1.96*1.96),4) END AS fail_safe_n, CASE WHEN abs(est/err)>1.96 THEN pow(abs(est/err)-1.96,2)*k/(1.96*1.96) > 5*k+10 END AS robust FROM {_re('')} r")
def m10(spark, sf):
    return me.fail_safe(studies(spark, sf)).select("k", F.round("z", 5).alias("z"), F.round("fail_safe_n", 4).alias("fail_safe_n"), "robust")


@query("m11_hierarchical")
def m11(spark, sf):
    return me.hierarchical(studies(spark, sf))


@query("m12_subgroups", f"WITH r AS (SELECT * FROM {_re('region')} r WHERE k>=2), m AS (SELECT sum(k*est)/sum(k) AS m, count(*)-1 AS dof FROM r), b AS (SELECT sum(k*pow(est-m,2)) AS qb FROM r, m) SELECT region, {_out()}, round(qb,6) AS q_between, dof FROM r, m, b")
def m12(spark, sf):
    regions = orders(spark, sf).select("study", "region").distinct()
    return _round(me.subgroups(studies(spark, sf).join(regions, "study"), "region")).withColumn("q_between", F.round("q_between", 6))


@query("m13_leave_one_out", f"""WITH st AS (SELECT * FROM {ST} s), p AS (SELECT a.study, count(*) AS k, sum(b.w) AS sw, sum(b.w*b.w) AS sww, sum(b.w*b.effect) AS swy, sum(b.w*b.effect*b.effect) AS swyy FROM st a JOIN st b ON a.study<>b.study GROUP BY 1),
t AS (SELECT study, greatest(0, (greatest(0,swyy-swy*swy/sw)-(k-1))/(sw-sww/sw)) AS tau2 FROM p), e AS (SELECT t.study, sum(b.effect/(b.se*b.se+tau2))/sum(1/(b.se*b.se+tau2)) AS est FROM t JOIN st b ON t.study<>b.study GROUP BY 1),
i AS (SELECT e.study, e.est, abs(e.est-r.est) AS infl FROM e, {_re('')} r)
SELECT study, round(est,6) AS estimate, round(infl,6) AS influence, infl > 2*stddev_pop(infl) OVER () AS influential FROM i""")
def m13(spark, sf):
    return rounded(me.leave_one_out(studies(spark, sf), "study"), "estimate", "influence")


@query("m14_outliers", f"SELECT study, round((effect-est)/s.se,5) AS z FROM {ST} s, {_re('')} r WHERE abs((effect-est)/s.se) > 0.5")
def m14(spark, sf):
    return me.outliers(studies(spark, sf), "study", limit=0.5).withColumn("z", F.round("z", 5))


@query("m15_forest", f"SELECT study, round(effect,6) AS effect, round(effect-1.96*se,6) AS ci_low, round(effect+1.96*se,6) AS ci_high, round(w,4) AS weight, round(50+200*w/max(w) OVER (),5) AS size FROM {ST} s")
def m15(spark, sf):
    return rounded(me.forest(studies(spark, sf), "study"), "effect", "ci_low", "ci_high").withColumn("weight", F.round("weight", 4)).withColumn("size", F.round("size", 5))


@query("m16_funnel", f"WITH g AS (SELECT est, i*(SELECT max(se) FROM {ST} s)/99.0 AS se FROM {_re('')} r, range(100) t(i)) SELECT round(se,6) AS se, round(est-1.96*se,6) AS low95, round(est+1.96*se,6) AS high95, round(est-2.58*se,6) AS low99, round(est+2.58*se,6) AS high99 FROM g")
def m16(spark, sf):
    return rounded(me.funnel(studies(spark, sf)), "se", "low95", "high95", "low99", "high99")
