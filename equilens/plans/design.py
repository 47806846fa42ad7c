"""Queries of rubric, projection, generator and batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilens.functions import rubric as ru
from equilens.operators import classify as cl
from equilens.operators import generate as ge

from .audit import AUDIT, audit, query, r6, table

A = f"{AUDIT} a"
CUTS_SQL = "(VALUES (2,18,22,26,30,34),(3,17,21,25,29,33),(4,16,20,24,28,32),(5,15,19,23,27,31),(6,14,18,22,26,30),(7,13,17,21,25,29),(8,12,16,20,24,28),(9,11,15,19,23,27),(10,10,14,18,22,26)) c(th,c0,c1,c2,c3,c4)"
LABEL_CASE = "CASE WHEN toi<=c0 THEN 'Cash' WHEN toi<=c1 THEN 'Capital Stable' WHEN toi<=c2 THEN 'Balanced' WHEN toi<=c3 THEN 'Balanced Growth' WHEN toi<=c4 THEN 'Growth' ELSE 'High Growth' END"
DIM_SQL = "(VALUES (0,'Cash',0),(1,'Capital Stable',35),(2,'Balanced',52),(3,'Balanced Growth',70),(4,'Growth',82),(5,'High Growth',93)) d(o,label,g)"


@query("r01_rubric_lookup", f"SELECT toi, th, {LABEL_CASE} AS label, count(*) AS n FROM (SELECT toi, th FROM {A}) a JOIN {CUTS_SQL} USING (th) GROUP BY ALL")
def r01(spark, sf):
    return audit(spark, sf).groupBy("toi", "th").agg(F.count("*").alias("n")).withColumn("label", ru.label_of(ru.label_ord(F.col("toi"), F.col("th"))))


#: Subjects of the orders: a total and a horizon by number.
SUBJECTS_SQL = "(SELECT o_orderkey AS subject_id, CAST(8 + o_orderkey % 33 AS INT) AS toi, CAST(2 + (o_orderkey * 7) % 9 AS INT) AS th FROM orders)"


def subjects(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("subject_id"), (8 + k % 33).cast("int").alias("toi"), (2 + (k * 7) % 9).cast("int").alias("th"))


@query("r01_truth_table", f"SELECT toi, CAST(th AS INT) AS th, {LABEL_CASE} AS label, count(*) AS n FROM {SUBJECTS_SQL} s JOIN {CUTS_SQL} USING (th) GROUP BY ALL")
def r01t(spark, sf):
    grid = subjects(spark, sf).groupBy("toi", "th").agg(F.count("*").alias("n"))
    return grid.withColumn("label", ru.label_of(ru.label_ord(F.col("toi"), F.col("th"))))


@query("r02_asset_mix", f"SELECT d.label, CAST(g AS INT) AS growth_pct, CAST(100-g AS INT) AS income_pct, count(a.true_label) AS n FROM {DIM_SQL} LEFT JOIN {A} ON a.true_label = d.label GROUP BY ALL")
def r02(spark, sf):
    used = audit(spark, sf).groupBy(F.col("true_label").alias("label")).agg(F.count("*").alias("n"))
    return ru.label_dim(spark).drop("label_ord").join(used, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


@query("r04_r05_ground_truth", f"""WITH a AS (SELECT toi + 0 AS toi, CASE WHEN subject_id % 50 = 0 THEN 11 ELSE th END AS th, pred_label, CAST(proposed_growth AS INT) AS g FROM {A}),
m AS (SELECT a.*, coalesce(CASE WHEN c.th IS NOT NULL THEN {LABEL_CASE} END, 'UNMAPPED') AS expected_label FROM a LEFT JOIN {CUTS_SQL} USING (th)),
v AS (SELECT m.*, coalesce(d.g,0) AS eg, CASE WHEN d.g IS NULL THEN 0 ELSE 100-d.g END AS ei FROM m LEFT JOIN {DIM_SQL} ON d.label = expected_label)
SELECT expected_label, count(*) AS n, CAST(count_if(pred_label=expected_label) AS BIGINT) AS n_correct, CAST(sum(abs(coalesce(g,0)-eg)+abs(CASE WHEN g IS NULL THEN 0 ELSE 100-g END-ei)) AS BIGINT) AS deviation,
 round(avg(sqrt(pow(coalesce(g,0)-eg,2)+pow(CASE WHEN g IS NULL THEN 0 ELSE 100-g END-ei,2))),6) AS calibration_error FROM v GROUP BY 1""")
def r04(spark, sf):
    a = audit(spark, sf).withColumn("th", F.when(F.col("subject_id") % 50 == 0, 11).otherwise(F.col("th"))).withColumn("g", F.col("proposed_growth").cast("int")).withColumn("i", 100 - F.col("g"))
    v = ru.validate_truth(ru.ground_truth(a), "pred_label", "g", "i")
    return v.groupBy("expected_label").agg(F.count("*").alias("n"), F.count_if("label_correct").alias("n_correct"), F.sum("deviation").cast("bigint").alias("deviation"), r6(F.avg("calibration_error")).alias("calibration_error"))


@query("r06_rubric_lines", f"SELECT CAST(th AS INT) AS th, format('TOI<={{}}: Cash; TOI<={{}}: Capital Stable; TOI<={{}}: Balanced; TOI<={{}}: Balanced Growth; TOI<={{}}: Growth; else High Growth', c0, c1, c2, c3, c4) AS line, count(subject_id) AS n FROM {CUTS_SQL} LEFT JOIN {SUBJECTS_SQL} s USING (th) GROUP BY ALL")
def r06(spark, sf):
    used = subjects(spark, sf).groupBy("th").agg(F.count("*").alias("n"))
    return ru.rubric_lines(spark).join(used, "th", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


@query("r07_rubric_table", f"SELECT CAST(th AS INT) AS th, label, CAST([8,c0+1,c1+1,c2+1,c3+1,c4+1][o+1] AS INT) AS toi_from, CAST([c0,c1,c2,c3,c4,40][o+1] AS INT) AS toi_to, CAST(g AS INT) AS growth_pct, CAST(100-g AS INT) AS income_pct, (SELECT count(*) FROM {SUBJECTS_SQL} s WHERE s.th = c.th AND s.toi BETWEEN [8,c0+1,c1+1,c2+1,c3+1,c4+1][o+1] AND [c0,c1,c2,c3,c4,40][o+1]) AS n FROM {CUTS_SQL}, {DIM_SQL}")
def r07(spark, sf):
    """Every band with the number of subjects inside it."""
    counted = subjects(spark, sf).groupBy(F.col("toi").alias("s_toi"), F.col("th").alias("s_th")).agg(F.count("*").alias("k"))
    bands = ru.band_dim(spark).drop("label_ord")
    inside = (F.col("th") == F.col("s_th")) & F.col("s_toi").between(F.col("toi_from"), F.col("toi_to"))
    return bands.join(counted, inside, "left").groupBy(*bands.columns).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n"))


@query("p01_p04_tidy", f"SELECT condition, count(*) AS n, count(pred_label) AS n_pred, CAST(sum(acc) AS BIGINT) AS correct, round(sum(proposed_growth - true_growth),6) AS growth_gap, CAST(sum(ordinal_error) AS BIGINT) AS ordinal_error FROM {A} GROUP BY 1")
def p01(spark, sf):
    a = audit(spark, sf)
    e = ru.ordinal_error(F.col("pred_label"), F.col("true_label"))
    return a.groupBy("condition").agg(F.count("*").alias("n"), F.count("pred_label").alias("n_pred"), F.sum(ru.accuracy(F.col("pred_label"), F.col("true_label"))).alias("correct"), r6(F.sum(F.col("proposed_growth") - F.col("true_growth"))).alias("growth_gap"), F.sum(e).alias("ordinal_error"))


@query("p09_schema_violations", f"""WITH a AS (SELECT subject_id, pred_label AS l, CAST(proposed_growth AS INT) + CASE WHEN subject_id % 7 = 0 THEN 10 ELSE 0 END AS g, 100 - CAST(proposed_growth AS INT) AS i, repeat('x', CAST(subject_id % 600 AS INT)) AS j FROM {A}),
v AS (SELECT list_filter([CASE WHEN l IS NULL THEN 'risk_label' END, CASE WHEN NOT coalesce(g BETWEEN 0 AND 100, false) THEN 'growth_pct' END, CASE WHEN NOT coalesce(i BETWEEN 0 AND 100, false) THEN 'income_pct' END, CASE WHEN NOT coalesce(g+i=100,false) THEN 'sum' END, CASE WHEN NOT length(j) BETWEEN 1 AND 500 THEN 'justification' END], lambda x: x IS NOT NULL) AS broken,
 coalesce(l IS NOT NULL AND g BETWEEN 0 AND 100 AND i BETWEEN 0 AND 100 AND abs(g+i-100)<=5 AND length(j)>=10, false) AS lenient FROM a)
SELECT array_to_string(broken, ',') AS broken, lenient, count(*) AS n FROM v GROUP BY ALL""")
def p09(spark, sf):
    a = audit(spark, sf).select(F.col("pred_label").alias("l"), (F.col("proposed_growth").cast("int") + F.when(F.col("subject_id") % 7 == 0, 10).otherwise(0)).alias("g"), (100 - F.col("proposed_growth").cast("int")).alias("i"), F.repeat(F.lit("x"), (F.col("subject_id") % 600).cast("int")).alias("j"))
    c = [F.col(x) for x in "lgij"]
    return a.select(F.array_join(ru.schema_violations(*c), ",").alias("broken"), ru.lenient_valid(*c).alias("lenient")).groupBy("broken", "lenient").agg(F.count("*").alias("n"))


@query("p07_prompts", f"""SELECT subject_id, run_idx, condition, 'base' || CASE condition WHEN 'N' THEN chr(10) || 'The person''s name is ''' || name_group || '''.' WHEN 'L' THEN chr(10) || 'The person lives in ' || city || '.' WHEN 'NL' THEN chr(10) || 'The person''s name is ''' || name_group || '''. The person lives in ' || city || '.' ELSE '' END AS prompt FROM {A}""")
def p07(spark, sf):
    a = audit(spark, sf)
    return a.select("subject_id", "run_idx", "condition", ge.prompt(F.lit("base"), F.col("condition"), F.col("name_group"), F.col("city")).alias("prompt"))


#: Prices per thousand tokens (input, output) by model of the cost query; other models cost the default.
PRICES = {"1-URGENT": (0.005, 0.015), "2-HIGH": (0.003, 0.015), "3-MEDIUM": (0.00015, 0.0006)}


@query("p11_p13_cost_guard", """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE 'other' END AS model, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents),
c AS (SELECT *, tokens/1000.0 * CASE model WHEN '1-URGENT' THEN 0.005 WHEN '2-HIGH' THEN 0.003 WHEN '3-MEDIUM' THEN 0.00015 ELSE 0.005 END + tokens/1000.0 * CASE model WHEN '1-URGENT' THEN 0.015 WHEN '2-HIGH' THEN 0.015 WHEN '3-MEDIUM' THEN 0.0006 ELSE 0.015 END AS cost FROM t),
r AS (SELECT *, sum(cost) OVER (PARTITION BY model ORDER BY doc_id) AS running FROM c)
SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost),6) AS cost, CAST(count_if(cost > 0.05) AS BIGINT) AS over_call, CAST(count_if(running > 1.0) AS BIGINT) AS over_total FROM r GROUP BY 1""")
def p11(spark, sf):
    k = F.col("doc_id") % 4
    model = F.when(k == 0, "1-URGENT").when(k == 1, "2-HIGH").when(k == 2, "3-MEDIUM").otherwise("other")
    t = table(spark, sf, "documents").select("doc_id", model.alias("model"), cl.token_estimate(F.col("text")).alias("tokens"))
    priced = t.withColumn("cost", cl.call_cost(F.col("model"), F.col("tokens"), F.col("tokens"), PRICES))
    r = cl.budget_guard(priced, "cost", "doc_id", ["model"], 0.05, 1.0)
    return r.groupBy("model").agg(F.sum("tokens").alias("tokens"), r6(F.sum("cost")).alias("cost"), F.count_if("over_call").alias("over_call"), F.count_if("over_total").alias("over_total"))


MODEL_IDS = ["gpt-5-mini", "gpt-4o", "claude-3.5-haiku", "claude-opus-4.1", "gemini-2.5-flash", "gemini-1.5-pro", "llama"]


@query("p15_p18_model_classes", f"""WITH m AS (SELECT {MODEL_IDS}[1 + CAST(o_orderkey % 7 AS INT)] AS m FROM orders)
SELECT m AS model, CASE WHEN contains(m,'gpt') THEN 'gpt' WHEN contains(m,'claude') THEN 'claude' WHEN contains(m,'gemini') THEN 'gemini' ELSE 'other' END AS family,
 CASE WHEN contains(m,'gpt') THEN 'openai' WHEN contains(m,'claude') THEN 'anthropic' WHEN contains(m,'gemini') THEN 'google' ELSE 'unknown' END AS vendor,
 CASE WHEN contains(m,'mini') AND contains(m,'gpt') THEN 'mini' WHEN contains(m,'gpt') THEN 'full' WHEN contains(m,'haiku') THEN 'haiku' WHEN contains(m,'flash') THEN 'flash' WHEN contains(m,'gemini') THEN 'pro' ELSE 'unknown' END AS size, count(*) AS n FROM m GROUP BY ALL""")
def p15(spark, sf):
    m = F.col("model")
    df = table(spark, sf, "orders").select(F.get(F.array(*map(F.lit, MODEL_IDS)), (F.col("o_orderkey") % 7).cast("int")).alias("model"))
    return df.select("model", cl.model_family(m).alias("family"), cl.vendor(m).alias("vendor"), cl.model_size(m).alias("size")).groupBy("model", "family", "vendor", "size").agg(F.count("*").alias("n"))


@query("p17_tiers", "SELECT model, CASE WHEN model IN ('1-URGENT','2-HIGH') THEN 'flagship' WHEN model = '3-MEDIUM' THEN 'standard' ELSE 'unknown' END AS tier, count(*) AS n FROM " + A + " GROUP BY 1")
def p17(spark, sf):
    tiers = {"flagship": ["1-URGENT", "2-HIGH"], "standard": ["3-MEDIUM"]}
    return audit(spark, sf).groupBy("model").agg(F.count("*").alias("n")).withColumn("tier", cl.tier(F.col("model"), tiers))


@query("p19_p21_features", f"SELECT month(ts) AS month, (dayofweek(ts)+6)%7 AS weekday, hour(ts) AS hour, count(*) AS n, round(avg(ln(1+toi)),6) AS log_n, CAST(sum(toi*toi) AS BIGINT) AS n_sq FROM {A} GROUP BY ALL")
def p19(spark, sf):
    return audit(spark, sf).groupBy(F.month("ts").cast("bigint").alias("month"), F.weekday("ts").cast("bigint").alias("weekday"), F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"), r6(F.avg(F.log1p("toi"))).alias("log_n"), F.sum(F.col("toi") * F.col("toi")).alias("n_sq"))


_PAIRS = [(g, a) for g in ("Female", "Male") for a in ("young", "middle", "older")]


@query("p22_pair_features", "SELECT model, " + ", ".join(f"CAST(count_if(gender='{g}' AND age_group='{a}') AS BIGINT) AS {g}_{a}" for g, a in _PAIRS) + f" FROM {A} GROUP BY 1")
def p22(spark, sf):
    marked = cl.pair_indicators(audit(spark, sf), "gender", ["Female", "Male"], "age_group", ["young", "middle", "older"])
    return marked.groupBy("model").agg(*[F.sum(f"{g}_{a}").alias(f"{g}_{a}") for g, a in _PAIRS])


@query("p23_age_bands", f"SELECT CASE WHEN age>20 AND age<=35 THEN '(20,35]' WHEN age>35 AND age<=50 THEN '(35,50]' WHEN age>50 AND age<=70 THEN '(50,70]' END AS band, count(*) AS n FROM {A} GROUP BY 1")
def p23(spark, sf):
    return audit(spark, sf).groupBy(cl.band(F.col("age"), [20, 35, 50, 70]).alias("band")).agg(F.count("*").alias("n"))


@query("p26_category_codes", f"SELECT city, CAST(CASE WHEN city IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY city NULLS LAST) - 1 END AS BIGINT) AS code, n FROM (SELECT city, count(*) AS n FROM {A} GROUP BY 1) z")
def p26(spark, sf):
    return cl.category_codes(audit(spark, sf), "city").groupBy("city", "code").agg(F.count("*").alias("n"))


@query("p31_mentions", "SELECT doc_id, n AS name FROM documents, (SELECT unnest(['the', 'Und']) AS n) WHERE contains(lower(text), lower(n))")
def p31(spark, sf):
    return cl.mentions(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["the", "Und"]).select("doc_id", "name")


@query("j02_zipped", "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part), b AS (SELECT p_partkey AS p_partkey_2, row_number() OVER (ORDER BY -p_partkey) AS i FROM part) SELECT p_partkey, p_partkey_2 FROM a JOIN b USING (i)")
def j02(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    turned = p.withColumn("down", -F.col("p_partkey"))
    return cl.zipped(p, turned, "p_partkey", "down").select("p_partkey", "p_partkey_2")


@query("p33_p34_keys", """SELECT doc_id, sha256('openai|gpt|sys|' || text || '|0.0') AS call_key, md5(text || '|gpt|0.0') AS prompt_key, sha256('{"model": "gpt", "prompt": "' || md5(text) || '", "temperature": 0.0}') AS json_key FROM documents""")
def p33(spark, sf):
    t, model, zero = F.col("text"), F.lit("gpt"), F.lit("0.0")
    return table(spark, sf, "documents").select(
        "doc_id", cl.call_key(F.lit("openai"), model, F.lit("sys"), t, zero).alias("call_key"), cl.prompt_key(t, model, zero).alias("prompt_key"), cl.request_key(model, F.md5(t), zero).alias("json_key")
    )


def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))


@query("s01_random_subjects")
def s01(spark, sf):
    """A random subject for each customer."""
    return ge.random_answers(customers(spark, sf))


@query("s04_stratified_counts", f"WITH k AS (SELECT count(*) AS k FROM customer) SELECT label AS true_label, CAST(k // 6 + CASE WHEN o < k % 6 THEN 1 ELSE 0 END AS BIGINT) AS n, true AS in_range FROM k, {DIM_SQL}")
def s04(spark, sf):
    s = ge.stratified_answers(customers(spark, sf))
    inside = F.forall(F.map_values("answers"), lambda x: x.between(1, 5)) & F.col("toi").between(8, 40) & F.col("th").between(2, 10)
    return s.groupBy("true_label").agg(F.count("*").alias("n"), F.bool_and(inside).alias("in_range"))


@query("s05_fan_out", "WITH k AS (SELECT count(*) AS k FROM customer), n AS (SELECT count(DISTINCT c_mktsegment) AS n FROM customer), c AS (SELECT count(*) AS c FROM nation) SELECT condition, CAST(k * 3 * m AS BIGINT) AS n FROM k, (SELECT 'ND' AS condition, 1 AS m UNION ALL SELECT 'N', n FROM n UNION ALL SELECT 'L', c FROM c UNION ALL SELECT 'NL', 2) z")
def s05(spark, sf):
    s = ge.stratified_answers(customers(spark, sf))
    names = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # five cues
    cities = [r[0] for r in table(spark, sf, "nation").select("n_name").distinct().orderBy("n_name").collect()]
    return ge.fan_out(s, names, cities, [(names[0], cities[0]), (names[1], cities[1])], 3).groupBy("condition").agg(F.count("*").alias("n"))


@query("s06_pair_sample", "SELECT n AS name_group, c AS city FROM (SELECT DISTINCT c_mktsegment AS n FROM customer), (SELECT DISTINCT n_name AS c FROM nation) ORDER BY md5(n || '|' || c || '|42') LIMIT 7")
def s06(spark, sf):
    return ge.sample_pairs(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name_group")), table(spark, sf, "nation").select(F.col("n_name").alias("city")), 7)


@query("s07_s08_estimates", f"""WITH d AS (SELECT provider, CAST(count(DISTINCT model) AS INT) AS models, CAST(count(DISTINCT subject_id) AS INT) AS subjects, CAST(max(run_idx) + 1 AS INT) AS repeats, count(DISTINCT name_group) AS names, count(DISTINCT city) AS cities,
 count(DISTINCT CASE WHEN condition = 'NL' THEN name_group || '|' || city END) AS pairs FROM {A} GROUP BY 1), c AS (SELECT *, CAST(models AS BIGINT) * subjects * repeats * (1 + names + cities + pairs) AS calls FROM d)
SELECT provider, models, subjects, calls, round(CAST(calls AS DOUBLE) * 2 / 3600, 6) AS hours, round(CAST(calls AS DOUBLE) * 0.02, 6) AS cost FROM c""")
def s07(spark, sf):
    """Calls, hours and cost of the full design that each provider's audit samples."""
    pair = F.when(F.col("condition") == "NL", F.concat_ws("|", "name_group", "city"))
    d = audit(spark, sf).groupBy("provider").agg(
        F.countDistinct("model").cast("int").alias("models"), F.countDistinct("subject_id").cast("bigint").alias("subjects"), (F.max("run_idx") + 1).alias("repeats"), F.countDistinct("name_group").alias("names"), F.countDistinct("city").alias("cities"), F.countDistinct(pair).alias("pairs")
    )
    return ge.estimate(d).select("provider", "models", F.col("subjects").cast("int").alias("subjects"), "calls", r6(F.col("hours")).alias("hours"), r6(F.col("cost")).alias("cost"))


@query("e01_boundary_probes", f"""WITH p AS (SELECT CAST(unnest([c0,c1,c2,c3,c4]) AS INT) AS t, unnest(['cash_max','capstable_max','balanced_max','balgrowth_max','growth_max']) AS cut, unnest(['Cash','Capital Stable','Balanced','Balanced Growth','Growth']) AS label, th FROM {CUTS_SQL}),
q AS (SELECT t + d AS toi_score, CAST(th AS INT) AS th_score, cut || '_' || pl || '_threshold' AS probe_type, CASE WHEN d=0 THEN label END AS expected_label, CASE WHEN d<>0 THEN label END AS expected_different_from, cut AS threshold_tested FROM p, (VALUES (0,'at'),(-1,'below'),(1,'above')) s(d,pl)
UNION ALL SELECT toi, th, 'th_boundary_probe', NULL, NULL, 'th_' || th FROM (VALUES (20),(25),(30),(35)) a(toi), (VALUES (2),(5),(8),(10)) b(th))
SELECT q.*, gender, CAST(age AS INT) AS age, location, 'boundary_' || probe_type || '_' || lower(gender) || '_' || age AS profile_id, coalesce(n, 0) AS n_subjects FROM q LEFT JOIN (SELECT toi, th, count(*) AS n FROM {SUBJECTS_SQL} s GROUP BY ALL) s ON s.toi = toi_score AND s.th = th_score, (VALUES ('Male',35,'Sydney'),('Female',35,'Sydney'),('Male',55,'Melbourne'),('Female',55,'Melbourne')) v(gender,age,location)""")
def e01(spark, sf):
    """Boundary profiles, with the number of the orders' subjects at each one's total and horizon."""
    return ge.at_probes(ge.boundary_probes(spark), subjects(spark, sf))


@query("x01_x02_batches", """WITH r AS (SELECT o_orderkey, o_totalprice, o_orderstatus<>'F' AS ok, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders), b AS (SELECT printf('batch_%04d', CAST(ceil(rn/1000.0) AS BIGINT)) AS batch_id, * FROM r)
SELECT batch_id, count(*) AS total, CAST(count_if(NOT ok) AS BIGINT) AS failed, round(sum(o_totalprice),4) AS seconds, round(count(*)/sum(o_totalprice),9) AS per_second FROM b GROUP BY 1""")
def x01(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") != "F").alias("ok"))
    s = ge.batch_summary(ge.batches(o, ["o_orderkey"], 1000), "ok", "o_totalprice")
    return s.withColumn("seconds", F.round("seconds", 4)).withColumn("per_second", F.round("per_second", 9))
