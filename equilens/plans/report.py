"""Queries of report, chart and prediction operators over the audit view."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equilens.functions import rubric as ru
from equilens.operators import fairness as fa
from equilens.operators import inference as inf
from equilens.operators import predict as pr
from equilens.operators import report as rp
from equilens.operators import runs
from equilens.session import stored

from .audit import AUDIT, audit, query, r6
from .fairness import chi_sql, kruskal_sql, rounded

A = f"{AUDIT} a"


@query("v01_summary", f"SELECT count(*) AS n, count(DISTINCT subject_id) AS subjects, count(DISTINCT model) AS models, round(avg(CAST(ok AS INT)),6) AS success_rate, round(avg(acc),6) AS accuracy, round(avg(latency_s),4) AS mean_seconds, round(quantile_cont(latency_s,0.5),4) AS median_seconds, round(sum(cost),4) AS total_cost FROM {A}")
def v01(spark, sf):
    s = rp.summary(audit(spark, sf), "subject_id", "model", "ok", "acc", "latency_s", "cost")
    return rounded(s, "success_rate", "accuracy").withColumns({c: F.round(c, 4) for c in ("mean_seconds", "median_seconds", "total_cost")})


#: By the rules of the survey's V01; the normal's quantile at 0.975 is written out.
_RUN = f"""WITH a AS MATERIALIZED (SELECT *, pred_label AS label, CAST(acc AS DOUBLE) AS y, confidence AS c FROM {A}),
o AS (SELECT count(*) AS n, count(DISTINCT subject_id) AS subjects, avg(CAST(ok AS INT)) AS success, avg(y) AS acc, stddev_samp(y) / sqrt(count(y)) AS sem, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM a),
cl AS (SELECT gender, label, count(*) AS k FROM a WHERE label IS NOT NULL GROUP BY ALL), gl AS (SELECT gender, label FROM (SELECT DISTINCT gender FROM cl), (SELECT DISTINCT label FROM cl)),
sh AS (SELECT gender, label, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY gender) AS s FROM gl LEFT JOIN cl USING (gender, label)),
dp AS (SELECT max(r) AS gap FROM (SELECT max(s) - min(s) AS r FROM sh GROUP BY label)),
eo AS (SELECT max(t) - min(t) AS gap FROM (SELECT count_if(y = 1) / count(*) AS t FROM a GROUP BY gender)),
cb AS (SELECT ceil(c * 10) AS bin, count(*) AS k, avg(c) AS p, avg(y) AS q FROM a WHERE c > 0 AND c <= 1 GROUP BY 1), ce AS (SELECT sum(k * abs(p - q)) AS e FROM cb),
g AS (SELECT gender, count(*) AS k, avg(y) AS m, var_samp(y) AS v FROM a GROUP BY 1),
d AS (SELECT abs(x.m - z.m) / sqrt(((x.k - 1) * x.v + (z.k - 1) * z.v) / (x.k + z.k - 2)) AS d FROM g x, g z WHERE x.gender = 'Male' AND z.gender = 'Female')
SELECT models AS models_tested, labels AS risk_labels, subjects AS total_subjects, n AS total_responses, round(success, 6) AS success_rate, round(acc, 6) AS overall_accuracy, round(dp.gap, 6) AS demographic_parity_violation,
  round(eo.gap, 6) AS equalized_odds_violation, round(e / n, 6) AS calibration_error, round(chi2, 6) AS chi_square_statistic, round(h, 6) AS kruskal_wallis_statistic, round(v, 6) AS cramers_v, round(d, 6) AS cohens_d,
  round(acc - 1.959963984540054 * sem, 6) AS accuracy_ci_lower, round(acc + 1.959963984540054 * sem, 6) AS accuracy_ci_upper, round(greatest(0, dp.gap - 0.1), 6) AS bias_ci_lower, round(dp.gap + 0.1, 6) AS bias_ci_upper
FROM o, dp, eo, ce, d, (SELECT chi2, v FROM {chi_sql("(SELECT 1 AS one, gender, label FROM a)", "gender", "label", "one")} x), (SELECT h FROM {kruskal_sql("(SELECT 1 AS one, gender, y FROM a)", "gender", "y", "one")} x)"""


@query("v01_run_summary", _RUN)
def v01r(spark, sf):
    """The summary of a run over the audit view, as one row."""
    rows = audit(spark, sf).select(
        "subject_id", "model", "gender", "age_group", "ethnicity", "location", F.col("pred_label").alias("risk_label"), F.col("acc").alias("risk_band_correct"), F.col("confidence").alias("prediction_confidence"),
        F.when(~F.col("ok"), "failed").alias("error"),
    )
    s = runs.run_summary(rows)
    whole = ("total_subjects", "total_responses")
    parts = [
        "success_rate", "overall_accuracy", "demographic_parity_violation", "equalized_odds_violation", "calibration_error", "chi_square_statistic", "kruskal_wallis_statistic", "cramers_v", "cohens_d",
        "accuracy_ci_lower", "accuracy_ci_upper", "bias_ci_lower", "bias_ci_upper",
    ]
    lists = [F.lit(",".join(s[c])).alias(c) for c in ("models_tested", "risk_labels")]
    return spark.range(1).select(*lists, *[F.lit(s[c]).cast("bigint").alias(c) for c in whole], *[r6(F.lit(float(s[c]))).alias(c) for c in parts])


_GAP = f"(WITH c AS (SELECT model, gender, pred_label, count(*) AS o FROM {A} WHERE pred_label IS NOT NULL GROUP BY ALL), g AS (SELECT model, gender, sum(o) AS t FROM c GROUP BY ALL), f AS (SELECT g.model, g.gender, l.pred_label, coalesce(c.o,0)*1.0/t AS s FROM g JOIN (SELECT DISTINCT model, pred_label FROM c) l USING (model) LEFT JOIN c ON c.model=g.model AND c.gender=g.gender AND c.pred_label=l.pred_label) SELECT model, max(r) AS violation FROM (SELECT model, pred_label, max(s)-min(s) AS r FROM f GROUP BY ALL) GROUP BY 1)"


@query("v02_v39_parity_bands", f"SELECT model, round(violation,6) AS violation, CASE WHEN violation<0.05 THEN 'Excellent' WHEN violation<0.1 THEN 'Good' WHEN violation<0.2 THEN 'Moderate' ELSE 'Poor' END AS band FROM {_GAP} z")
def v02(spark, sf):
    return rounded(rp.banded(rp.share_gap(audit(spark, sf), "gender", "pred_label", ["model"]), "violation"), "violation")


@query("v03_accuracy_gap", f"SELECT round(max(a)-min(a),6) AS accuracy_gap FROM (SELECT gender, sum(coalesce(acc,0))*1.0/count(*) AS a FROM {A} GROUP BY 1)")
def v03(spark, sf):
    return rounded(rp.accuracy_gap(audit(spark, sf), "gender", "acc"), "accuracy_gap")


@query("v05_v07_tests", f"SELECT n, dof, round(chi2,6) AS statistic, round(v,6) AS cramers_v FROM {chi_sql(f'(SELECT 1 AS one_, gender, pred_label FROM {A})', 'gender', 'pred_label', 'one_')} c")
def v05(spark, sf):
    c = inf.chi_square(audit(spark, sf), "gender", "pred_label")
    return rounded(c.select("n", "dof", F.col("chi2").alias("statistic"), "cramers_v"), "statistic", "cramers_v")


_TWO = f"(SELECT model, count(*) FILTER (g) AS n1, avg(acc) FILTER (g) AS m1, var_samp(acc) FILTER (g) AS v1, count(*) FILTER (NOT g) AS n2, avg(acc) FILTER (NOT g) AS m2, var_samp(acc) FILTER (NOT g) AS v2 FROM (SELECT model, gender='Male' AS g, acc FROM {A} WHERE acc IS NOT NULL) GROUP BY 1)"


@query("v08_v14_cohens_d", f"WITH t AS {_TWO}, p AS (SELECT *, ((n1-1)*v1+(n2-1)*v2)/(n1+n2-2) AS pv FROM t) SELECT model, n1, n2, round(abs(m1-m2)/sqrt(pv),6) AS d, round((m1-m2)/sqrt(pv*(1.0/n1+1.0/n2)),6) AS t, n1+n2-2 AS dof FROM p")
def v08(spark, sf):
    return rounded(rp.cohens_d(audit(spark, sf), "acc", F.col("gender") == "Male", ["model"]), "d", "t")


@query("v09_mean_ci", f"SELECT model, count(acc) AS n, round(avg(acc),6) AS mean, round(stddev_samp(acc)/sqrt(count(acc)),6) AS sem, round(avg(acc)-1.959963984540054*stddev_samp(acc)/sqrt(count(acc)),6) AS low, round(avg(acc)+1.959963984540054*stddev_samp(acc)/sqrt(count(acc)),6) AS high FROM {A} GROUP BY 1")
def v09(spark, sf):
    return rounded(rp.mean_ci(audit(spark, sf), "acc", ["model"]), "mean", "sem", "low", "high")


@query("v10_v34_crosstab", "SELECT gender, " + ", ".join(f"round(100.0*count_if(pred_label='{x}')/count(*),6) AS \"{x}\"" for x in ru.LABELS) + f" FROM {A} WHERE pred_label IS NOT NULL GROUP BY 1")
def v10(spark, sf):
    return rounded(rp.crosstab_percent(audit(spark, sf), "gender", "pred_label", list(ru.LABELS)), *ru.LABELS)


@query("v11_v38_model_table", f"SELECT model, count(*) AS n, round_even(avg(acc),3) AS accuracy, round_even(stddev_samp(acc)/sqrt(count(acc)),3) AS sem, round_even(avg(latency_s),3) AS seconds FROM {A} GROUP BY 1")
def v11(spark, sf):
    return rp.model_table(audit(spark, sf), "model", "acc", "latency_s")


@query("v12_v32_label_counts", f"SELECT pred_label, count(*) AS n FROM {A} WHERE pred_label IS NOT NULL GROUP BY 1")
def v12(spark, sf):
    return rp.counts(audit(spark, sf), "pred_label")


@query("v13_radar", f"SELECT 'error' AS metric, round(1-(1-avg(acc)),6) AS value FROM {A} UNION ALL SELECT 'failure', round(1-(1-avg(CAST(ok AS INT))),6) FROM {A}")
def v13(spark, sf):
    one = audit(spark, sf).agg((1 - F.avg("acc")).alias("error"), (1 - F.avg(F.col("ok").cast("double"))).alias("failure"))
    return rounded(rp.radar(one, ["error", "failure"]), "value")


@query("v17_surface", f"SELECT age_group, round(coalesce(avg(acc) FILTER (ethnicity='A'),0),6) AS \"A\", round(coalesce(avg(acc) FILTER (ethnicity='N'),0),6) AS \"N\", round(coalesce(avg(acc) FILTER (ethnicity='R'),0),6) AS \"R\" FROM {A} GROUP BY 1")
def v17(spark, sf):
    return rounded(rp.surface(audit(spark, sf), "age_group", "ethnicity", "acc", ["A", "N", "R"]), "A", "N", "R")


@query("v18_profile", f"SELECT location, round(avg(acc),6) AS mean, round(stddev_samp(acc),6) AS std, count(acc) AS n FROM {A} GROUP BY 1")
def v18(spark, sf):
    return rounded(rp.profile_1d(audit(spark, sf), "location", "acc"), "mean", "std")


@query("v19_projection")
def v19(spark, sf):
    return rp.projection(audit(spark, sf).select("gender", "age", "latency_s", "cost"), ["gender", "age", "latency_s", "cost"]).select("gender", "age", vector_to_array("component").alias("component"))


_METRICS = ["acc", "age", "latency_s", "cost", "toi", "ordinal_error", "proposed_growth", "true_growth"]
_CORR = "(" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a},{b}) AS r FROM q" for i, a in enumerate(_METRICS) for b in _METRICS[i + 1 :]) + ")"


@query("v20_correlations", f"WITH q AS (SELECT * FROM {A}) SELECT a, b, n, round(r,6) AS r FROM {_CORR} c")
def v20(spark, sf):
    return rounded(rp.correlations(audit(spark, sf), _METRICS), "r")


@query("v21_network", f"WITH q AS (SELECT * FROM {A}), e AS (SELECT * FROM {_CORR} c WHERE abs(r)>=0.3), d AS (SELECT m, count(*) AS d FROM (SELECT a AS m FROM e UNION ALL SELECT b FROM e) GROUP BY 1) SELECT a, b, round(r,6) AS r, round(abs(r),6) AS weight, x.d AS degree_a, y.d AS degree_b FROM e JOIN d x ON x.m=a JOIN d y ON y.m=b")
def v21(spark, sf):
    return rounded(rp.network(audit(spark, sf), _METRICS), "r", "weight")


@query("v22_influence", f"""WITH q AS (SELECT *, CASE WHEN name_group IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY name_group NULLS LAST)-1 END AS kn, dense_rank() OVER (ORDER BY age_group)-1 AS ka FROM {A}),
c AS (SELECT 'name_group' AS demographic, 'age' AS metric, count(age) AS n, corr(kn,age) AS r FROM q UNION ALL SELECT 'age_group','age',count(age),corr(ka,age) FROM q UNION ALL SELECT 'name_group','acc',count(acc),corr(kn,acc) FILTER (acc IS NOT NULL) FROM q UNION ALL SELECT 'age_group','acc',count(acc),corr(ka,acc) FILTER (acc IS NOT NULL) FROM q)
SELECT demographic, metric, n, round(r,6) AS r, round(r*sqrt((n-2)/(1-r*r)),4) AS t FROM c WHERE abs(r)>0.1""")
def v22(spark, sf):
    return rounded(rp.influence(audit(spark, sf), ["name_group", "age_group"], ["age", "acc"]), "r").withColumn("t", F.round("t", 4))


@query("v24_metric_table", " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round(avg({m}),5) AS mean, round(stddev_samp({m}),5) AS std FROM {A} GROUP BY 1" for m in ("acc", "age", "cost")))
def v24(spark, sf):
    return rp.metric_table(audit(spark, sf), "model", ["acc", "age", "cost"]).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query("v25_v33_quartiles", f"SELECT model, min(latency_s) AS q0, round(quantile_cont(latency_s,0.25),4) AS q1, round(quantile_cont(latency_s,0.5),4) AS q2, round(quantile_cont(latency_s,0.75),4) AS q3, max(latency_s) AS q4 FROM {A} GROUP BY 1")
def v25(spark, sf):
    return rp.quartiles(audit(spark, sf), "model", "latency_s").withColumns({c: F.round(c, 4) for c in ("q1", "q2", "q3")})


@query("v26_auc", f"""WITH g AS (SELECT label, avg(CAST(pred_label=label AS INT)) FILTER (true_label=label) AS tpr, avg(CAST(pred_label=label AS INT)) FILTER (true_label<>label) AS fpr FROM {A}, (SELECT unnest([{', '.join(f"'{x}'" for x in ru.LABELS)}]) AS label) l WHERE pred_label IS NOT NULL GROUP BY 1),
s AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS s FROM g WINDOW w AS (ORDER BY fpr, tpr)) SELECT round(sum(s),9) AS auc FROM s""")
def v26(spark, sf):
    from equilens.operators import fairness as fa

    points = fa.one_vs_rest(audit(spark, sf).withColumn("all_", F.lit("all")), "all_", list(ru.LABELS)).select("tpr", "fpr")
    return rp.trapezoid(points).withColumn("auc", F.round("auc", 9))


#: Coefficients of a published rational approximation of the normal's quantile (numerator and denominator by rising power; middle, near and far tail).
_PROBIT = {
    "middle": ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
               (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)),
    "near": ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
             (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9)),
    "far": ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7),
            (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
}


def _ratio_sql(part: str, x: str) -> str:
    def horner(c):
        out = f"{c[-1]!r}::DOUBLE"
        for k in reversed(c[:-1]):
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    return f"{horner(_PROBIT[part][0])} / {horner(_PROBIT[part][1])}"


_QQ = f"""WITH r AS (SELECT model, latency_s AS value, row_number() OVER (PARTITION BY model ORDER BY latency_s) AS i, count(*) OVER (PARTITION BY model) AS n FROM {A}),
p AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM r),
q AS (SELECT *, 0.180625 - (p - 0.5) * (p - 0.5) AS m, sqrt(-ln(least(p, 1 - p))) AS t FROM p),
t AS (SELECT model, i, value, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_ratio_sql("middle", "m")} WHEN t <= 5 THEN sign(p - 0.5) * {_ratio_sql("near", "(t - 1.6)")} ELSE sign(p - 0.5) * {_ratio_sql("far", "(t - 5)")} END AS theoretical FROM q)"""


@query("v26_qq", f"{_QQ} SELECT model, i, round(theoretical, 6) AS theoretical, value FROM t")
def v26q(spark, sf):
    return rounded(rp.qq(audit(spark, sf), "latency_s", ["model"]), "theoretical")


@query("v26_qq_fit", f"{_QQ} SELECT model, count(*) AS n, round(regr_slope(value, theoretical), 4) AS slope, round(regr_intercept(value, theoretical), 4) AS intercept, round(corr(value, theoretical), 6) AS r FROM t GROUP BY 1")
def v26f(spark, sf):
    fit = rp.qq_fit(rp.qq(audit(spark, sf), "latency_s", ["model"]), ["model"])
    return rounded(fit, "r").withColumns({c: F.round(c, 4) for c in ("slope", "intercept")})


@query("v27_stars", f"WITH g AS (SELECT location, count(*) AS n FROM {A} GROUP BY 1) SELECT location, n, CASE WHEN n>0.8*max(n) OVER () THEN '***' WHEN n>0.6*max(n) OVER () THEN '**' WHEN n>0.4*max(n) OVER () THEN '*' ELSE '' END AS stars FROM g")
def v27(spark, sf):
    return rp.stars(audit(spark, sf).groupBy("location").agg(F.count("*").alias("n")), "n")


@query("v28_chart", f"SELECT model, condition, round(avg(acc),6) AS acc FROM {A} GROUP BY ALL")
def v28(spark, sf):
    return rounded(rp.Chart(audit(spark, sf)).aes("model", "acc", "condition").layer("bar").labs(title="accuracy").data(), "acc")


@query("v28_facets", f"SELECT gender, model, condition, round(log10(avg(latency_s)),6) AS latency_s FROM {A} WHERE latency_s BETWEEN 1000 AND 50000 GROUP BY ALL")
def v28f(spark, sf):
    chart = rp.Chart(audit(spark, sf)).aes("model", "latency_s", "condition").layer("bar").facet("gender").scale("y", "log10", (1000.0, 50000.0)).theme(palette="muted").labs(title="latency")
    return rounded(chart.build()["data"], "latency_s")


@query("v42_dashboard", f"""WITH k AS (SELECT * FROM {A} WHERE model IN ('1-URGENT','2-HIGH') AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-01-01'),
s AS (SELECT min(latency_s) AS lo, max(latency_s) AS hi FROM k), b AS (SELECT CAST(least(19, floor((latency_s - lo) / ((hi - lo) / 20))) AS INT) AS bin FROM k, s)
SELECT 'main' AS part, gender || '|' || age_group AS key, round(avg(latency_s), 4) AS value, count(*) AS n FROM k GROUP BY 1, 2 UNION ALL SELECT 'distribution', CAST(bin AS VARCHAR), NULL, count(*) FROM b GROUP BY 2
UNION ALL SELECT 'temporal', CAST(CAST(ts AS DATE) AS VARCHAR), round(avg(latency_s), 4), NULL FROM k GROUP BY 2 UNION ALL SELECT 'table', 'rows', NULL, least(100, count(*)) FROM k""")
def v42(spark, sf):
    """The parts of a dashboard under its filters, in long form."""
    a = audit(spark, sf).withColumn("ts", F.date_trunc("day", "ts"))
    p = rp.refreshed(a, "latency_s", ["gender", "age_group"], ["1-URGENT", "2-HIGH"], "1995-01-01", "1997-01-01", time="ts", metrics=_METRICS, order=["subject_id"])
    none = F.lit(None).cast("bigint").alias("n")
    parts = [
        p["main"].select(F.lit("main").alias("part"), F.concat_ws("|", "gender", "age_group").alias("key"), F.round("mean", 4).alias("value"), "n"),
        p["distribution"].select(F.lit("distribution").alias("part"), F.col("bin").cast("string").alias("key"), F.lit(None).cast("double").alias("value"), "n"),
        p["temporal"].select(F.lit("temporal").alias("part"), F.to_date("ts").cast("string").alias("key"), F.round("mean", 4).alias("value"), none),
        p["table"].agg(F.count("*").alias("n")).select(F.lit("table").alias("part"), F.lit("rows").alias("key"), F.lit(None).cast("double").alias("value"), "n"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("v29_v36_dashboard", f"SELECT subject_id, run_idx, condition, model FROM {A} WHERE model IN ('1-URGENT','2-HIGH') AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-01-01' ORDER BY subject_id, run_idx, condition, model LIMIT 100")
def v29(spark, sf):
    d = rp.dashboard(audit(spark, sf), "model", ["1-URGENT", "2-HIGH"], "ts", "1995-01-01", "1997-01-01", ["subject_id", "run_idx", "condition", "model"])
    return d.select("subject_id", "run_idx", "condition", "model")


@query("v37_summary_table", f"SELECT count(*) AS n, count(DISTINCT subject_id) AS subjects, round(100*avg(CAST(ok AS INT)),4) AS success_pct, round(avg(acc),6) AS accuracy, round(stddev_samp(acc)/sqrt(count(acc)),6) AS sem FROM {A}")
def v37(spark, sf):
    a = audit(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("subjects"), F.round(100 * F.avg(F.col("ok").cast("double")), 4).alias("success_pct"), F.avg("acc").alias("accuracy"), (F.stddev_samp("acc") / F.sqrt(F.count("acc"))).alias("sem"))
    return rounded(a, "accuracy", "sem")


_FACETS = [["gender"], ["age_group"], ["gender", "age_group"]]
_D01 = "(" + " UNION ALL ".join(f"SELECT provider, model, '{'+'.join(f)}' AS facet, count(*) AS n_groups, CAST(sum(k) AS BIGINT) AS n, max(a)-min(a) AS bias FROM (SELECT provider, model, {', '.join(f)}, count(*) AS k, avg(acc) AS a FROM {A} GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL HAVING count(*) >= 2" for f in _FACETS) + ")"


@query("d01_training_rows", f"SELECT provider, model, facet, n_groups, n, round(bias,6) AS bias FROM {_D01} d")
def d01(spark, sf):
    return rounded(pr.training_rows(audit(spark, sf), "provider", "model", _FACETS), "bias")


def _risks(spark, sf):
    return pr.training_rows(audit(spark, sf), "provider", "model", _FACETS)


@query("d02_features", f"SELECT provider, model, facet, round(ln(1+n),6) AS log_n, n*n*1.0 AS n_sq FROM {_D01} d".replace("n*n*1.0", "CAST(n AS DOUBLE)*n"))
def d02(spark, sf):
    return rounded(pr.features(_risks(spark, sf)), "log_n").select("provider", "model", "facet", "log_n", "n_sq")


@query("d03_d06_predictions")
def d03(spark, sf):
    rows = pr.features(_risks(spark, sf))
    model = pr.pipeline(["model", "facet"], ["n", "n_groups", "log_n"], "bias", "forest", numTrees=10).fit(rows)
    return pr.risk_level(pr.intervals(model, rows)).select("provider", "model", "facet", "prediction", "low", "high", "level")


_KINDS = {"linear": {"kind": "linear"}, "forest": {"kind": "forest", "numTrees": 10}, "boosted": {"kind": "boosted", "maxIter": 5}}


def _held_out(spark, sf):
    rows = stored(pr.features(_risks(spark, sf)))
    return stored(pr.held_out(rows, ["provider", "model", "facet"], ["model", "facet"], ["n", "n_groups", "log_n"], "bias", _KINDS, folds=3))


@query("d06_fold_errors")
def d06(spark, sf):
    """Errors of each kind of model on rows that it didn't see, and which kind is best."""
    return pr.fold_errors(_held_out(spark, sf), "bias")


@query("d09_profiles")
def d09p(spark, sf):
    """Risk profiles of all combinations by the best kind, each row predicted by a model that didn't see it."""
    predicted = _held_out(spark, sf)
    told = pr.risk_profiles(predicted, pr.fold_errors(predicted, "bias"), "n", {})
    return told.select("provider", "model", "facet", "kind", "prediction", "low", "high", "level", "power", "required_n", F.array_join("mitigations", "; ").alias("mitigations"))


@query("d09_d12_required_n", f"SELECT provider, model, facet, CASE WHEN bias<0.05 THEN 'low' WHEN bias<0.1 THEN 'moderate' WHEN bias<0.2 THEN 'high' ELSE 'critical' END AS level, CAST(greatest(50, floor((CASE WHEN bias<0.05 THEN 1000 WHEN bias<0.1 THEN 500 WHEN bias<0.2 THEN 200 ELSE 100 END)*ln(3))) AS INT) AS required_n FROM {_D01} d")
def d09(spark, sf):
    return pr.required_n(pr.risk_level(_risks(spark, sf), "bias"), "bias").select("provider", "model", "facet", "level", "required_n")


@query("d13_power")
def d13(spark, sf):
    return pr.with_power(_risks(spark, sf), "bias", "n").select("provider", "model", "facet", "power")


@query("d14_design", f"WITH d AS (SELECT facet, avg(bias) AS bias FROM {_D01} d GROUP BY 1), r AS (SELECT facet, CAST(greatest(50, floor((CASE WHEN bias<0.05 THEN 1000 WHEN bias<0.1 THEN 500 WHEN bias<0.2 THEN 200 ELSE 100 END)*ln(3))) AS INT) AS required_n, CAST(floor(2000/count(*) OVER ()) AS BIGINT) AS affordable_n FROM d) SELECT facet, required_n, affordable_n, least(required_n, affordable_n) AS n, round(CAST(least(required_n, affordable_n)*0.05 AS DOUBLE),4) AS cost FROM r")
def d14(spark, sf):
    r = _risks(spark, sf).groupBy("facet").agg(F.avg("bias").alias("bias"))
    return pr.recommend_design(r, "facet", "bias", 100.0).select("facet", "required_n", "affordable_n", "n", F.round("cost", 4).alias("cost"))


@query("d16_power_formulas", f"""WITH j AS (SELECT t.model, t.condition, coalesce(t.acc,0) AS t, coalesce(r.acc,0) AS r FROM {AUDIT} r JOIN {AUDIT} t ON r.condition='ND' AND t.condition<>'ND' AND t.provider=r.provider AND t.model=r.model AND t.subject_id=r.subject_id AND t.run_idx=r.run_idx),
g AS (SELECT model, condition, avg(r) AS p1, avg(t) AS p2, abs(avg(t) - avg(r)) AS d, avg(CAST(t <> r AS INT)) AS s FROM j GROUP BY ALL)
SELECT model, condition, round(p1, 6) AS p1, round(p2, 6) AS p2, CAST(ceil(round(pow(1.959964+0.841621,2)*(p1*(1-p1)+p2*(1-p2))/pow(p1-p2,2), 4)) AS BIGINT) AS n_group, CAST(ceil(round(pow(1.959964*sqrt(s)+0.841621*sqrt(s-d*d),2)/(d*d), 4)) AS BIGINT) AS n_pairs FROM g WHERE d > 0""")
def d16(spark, sf):
    """Sizes of studies that would show each condition's observed difference from ND, unpaired and paired."""
    m = fa.paired_mcnemar(audit(spark, sf), ["model"], ["provider", "subject_id", "run_idx"])
    n = F.col("n_pairs")
    seen = m.select("model", "condition", ((F.col("both_right") + F.col("ref_only")) / n).alias("p1"), ((F.col("both_right") + F.col("treat_only")) / n).alias("p2"), ((F.col("ref_only") + F.col("treat_only")) / n).alias("s"))
    seen = seen.withColumn("d", F.abs(F.col("p1") - F.col("p2"))).where("d > 0")
    sized = pr.n_for_mcnemar(pr.n_for_proportions(seen, "p1", "p2"), "d", "s")
    return rounded(sized, "p1", "p2").select("model", "condition", "p1", "p2", F.col("n_group").cast("bigint").alias("n_group"), F.col("n_pairs").cast("bigint").alias("n_pairs"))
