"""Queries of uncertainty, calibration, individual and intersectional fairness, caches and responses."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equilens.operators import bootstrap as bo
from equilens.operators import cache as ca
from equilens.operators import isotonic as iso
from equilens.operators import nearest as ne
from equilens.operators import responses as re_
from equilens.operators import store as st
from equilens.operators import uncertainty as un
from equilens.session import shared_folder, stored

from .audit import AUDIT, audit, query, table
from .fairness import rounded

A = f"{AUDIT} a"


@query("u01_bootstrap_mean")
def u01(spark, sf):
    return un.bootstrap_means(audit(spark, sf).withColumn("k", F.xxhash64("subject_id", "run_idx", "condition")), "acc", "k", ["model"], 50)


def intervals(rows, replicates=200):
    """Intervals of each model's accuracy, accuracy range among name groups, calibration error, and gaps of true positive rates and odds."""
    said, true = F.col("pred_label") == "High Growth", F.col("true_label") == "High Growth"
    metrics = {
        "accuracy": bo.mean("acc"), "accuracy_range": bo.rate_range("name_group", "acc"), "calibration_error": bo.calibration_error("confidence", "acc"),
        "tpr_gap": bo.odds_gap("name_group", said, true), "odds_gap": bo.odds_gap("name_group", said, true, "odds"),
    }
    parts = [bo.bootstrap(rows, m, ["subject_id", "run_idx", "condition"], ["model"], replicates).withColumn("metric", F.lit(name)) for name, m in metrics.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("model", "metric", "value", "low", "high", "std", "n_replicates")


@query("u01_bootstrap_metrics")
def u01m(spark, sf):
    a = audit(spark, sf)
    return intervals(stored(a.select("subject_id", "run_idx", "condition", "model", "name_group", "pred_label", "true_label", "acc", "confidence")))


@query("u03_beta_posterior", f"SELECT model, count(*) AS n, CAST(sum(acc) AS BIGINT) AS s, round((sum(acc)+1.0)/(count(*)+2.0),6) AS mean FROM {A} WHERE acc IS NOT NULL GROUP BY 1")
def u03(spark, sf):
    return rounded(un.beta_posterior(audit(spark, sf), "acc", ["model"]).select("model", "n", "s", "mean"), "mean")


@query("u03_normal_posterior", f"SELECT model, count(*) AS n, round(sum(ordinal_error)/(count(*)+0.01),6) AS mean, round(sqrt(1/(count(*)+0.01)),6) AS sd FROM {A} WHERE ordinal_error IS NOT NULL GROUP BY 1")
def u03n(spark, sf):
    return rounded(un.normal_posterior(audit(spark, sf), "ordinal_error", ["model"]).select("model", "n", "mean", "sd"), "mean", "sd")


_BINS = f"(SELECT model, len(list_filter([i/10.0 FOR i IN range(10)], lambda e: e < confidence)) AS bin, count(*) AS n, avg(confidence) AS mp, avg(acc) AS my FROM {A} WHERE acc IS NOT NULL AND confidence > 0 GROUP BY ALL)"


@query("u04_calibration_suite", f"""WITH b AS {_BINS}, t AS (SELECT model, count(*) AS n, avg(pow(confidence-acc,2)) AS brier, avg(acc) AS base FROM {A} WHERE acc IS NOT NULL GROUP BY 1)
SELECT model, min(t.n) AS n, round(min(brier),6) AS brier, round(min(base),6) AS base, round(sum(b.n*abs(mp-my))/sum(b.n),6) AS ece, round(max(abs(mp-my)),6) AS mce, round(sum(b.n*pow(mp-my,2))/sum(b.n),6) AS reliability, round(sum(b.n*pow(my-base,2))/sum(b.n),6) AS resolution, round(min(base*(1-base)),6) AS uncertainty FROM t JOIN b USING (model) GROUP BY 1""")
def u04(spark, sf):
    return rounded(un.calibration_suite(audit(spark, sf), "confidence", "acc", ["model"]), "brier", "base", "ece", "mce", "reliability", "resolution", "uncertainty")


@query("p25_calibration_bins", f"SELECT model, bin, n, round(mp,6) AS mean_p, round(my,6) AS mean_y FROM {_BINS} b")
def p25(spark, sf):
    return rounded(un.calibration_bins(audit(spark, sf), "confidence", "acc", ["model"]).withColumn("bin", F.col("bin").cast("bigint")), "mean_p", "mean_y")


_L2 = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))))"


@query("u05_individual_fairness", f"""WITH e AS (SELECT * FROM embeddings), d AS (SELECT a.vec_id, a.label=b.label AS same, abs(a.embedding[1]::DOUBLE-b.embedding[1]::DOUBLE) AS dp, {_L2} AS d FROM e a, e b)
SELECT vec_id, round(max(CASE WHEN d>0 THEN dp/d ELSE 0 END),5) AS lipschitz, round(sum(dp/(d+1e-8)) FILTER (same)/sum(1/(d+1e-8)) FILTER (same),5) AS disparity FROM d GROUP BY 1""")
def u05(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("p", F.col("embedding")[0].cast("double"))
    return un.individual_fairness(e, "vec_id", "embedding", "p", "label").select("vec_id", F.round("lipschitz", 5).alias("lipschitz"), F.round("disparity", 5).alias("disparity"))


def _inter(cols: list[str]) -> str:
    return f"SELECT {len(cols)} AS level, '{','.join(cols)}' AS columns, concat_ws('|', {', '.join(cols)}) AS values_, count(*) AS n, avg(CAST(pred_label=true_label AS INT)) AS acc, avg(CAST(pred_label='Growth' AS INT)) AS pr, avg(CAST(true_label='Growth' AS INT)) AS tr FROM {A} GROUP BY ALL" + (" HAVING count(*) > 5" if len(cols) > 1 else "")


_SETS = [["gender"], ["age_group"], ["ethnicity"], ["gender", "age_group"], ["gender", "ethnicity"], ["age_group", "ethnicity"], ["gender", "age_group", "ethnicity"]]
_INTER = "(" + " UNION ALL ".join(_inter(s) for s in _SETS) + ")"


@query("u06_u09_intersections", f'SELECT level, columns, values_ AS "values", n, round(acc,6) AS accuracy, round(pr,6) AS predicted_rate, round(tr,6) AS true_rate FROM {_INTER} i')
def u06(spark, sf):
    return rounded(un.intersections(audit(spark, sf), ["gender", "age_group", "ethnicity"], "pred_label", "true_label", "Growth"), "accuracy", "predicted_rate", "true_rate")


@query("u10_amplification", f"""WITH r AS (SELECT level, columns, max(pr)-min(pr) AS r FROM {_INTER} i GROUP BY ALL), p AS (SELECT split_part(columns,',',1) AS a, split_part(columns,',',2) AS b, r FROM r WHERE level=2)
SELECT a, b, round(x.r,6) AS range_a, round(y.r,6) AS range_b, round(p.r,6) AS pair_range, p.r > greatest(x.r, y.r) AS amplified FROM p JOIN r x ON x.columns=a JOIN r y ON y.columns=b""")
def u10(spark, sf):
    i = un.intersections(audit(spark, sf), ["gender", "age_group", "ethnicity"], "pred_label", "true_label", "Growth")
    return rounded(un.amplification(i), "range_a", "range_b", "pair_range")


@query("u11_parity_interval")
def u11(spark, sf):
    a = audit(spark, sf).withColumn("k", F.xxhash64("subject_id", "run_idx", "condition")).withColumn("hit", F.col("pred_label") == "High Growth")
    return un.parity_interval(a, "name_group", "hit", "k", 50)


@query("p14_refusals", """WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'I cannot provide that. ' WHEN 1 THEN 'It is unclear. ' WHEN 2 THEN 'This could be harmful and not appropriate. ' WHEN 3 THEN 'I shouldn''t judge based on gender. ' ELSE '' END || text AS x FROM conversations WHERE role='assistant'),
h AS (SELECT *, regexp_matches(lower(x), 'i cannot provide|i''m not able to|i can''t provide|i''m unable to|i shouldn''t|i won''t|i cannot recommend') AS p, regexp_matches(lower(x), 'this could be harmful|potential risks|safety concerns|inappropriate|not appropriate|concerning') AS s, regexp_matches(lower(x), 'based on.*(?:gender|age|race|ethnicity)|demographic.*bias|discriminat|stereotype|unfair.*assumptions') AS d, regexp_matches(lower(x), 'i don''t have enough information|unclear|ambiguous|need more context|insufficient.*information') AS u FROM t)
SELECT conv_id, turn, p OR s OR d OR u AS is_refusal, CASE WHEN p THEN 'policy' WHEN s THEN 'safety' WHEN d THEN 'demographic' WHEN u THEN 'unclear' END AS refusal_type, d AS demographic_sensitivity FROM h""")
def p14(spark, sf):
    k = (F.col("conv_id") + F.col("turn")) % 5
    lead = F.when(k == 0, "I cannot provide that. ").when(k == 1, "It is unclear. ").when(k == 2, "This could be harmful and not appropriate. ").when(k == 3, "I shouldn't judge based on gender. ").otherwise("")
    c = table(spark, sf, "conversations").where("role = 'assistant'").withColumn("x", F.concat(lead, "text"))
    return re_.refusal(c, "x").select("conv_id", "turn", "is_refusal", "refusal_type", "demographic_sensitivity")


#: The fit at each value by its minimax formula: the greatest, over begins up to it, of the least mean, over ends from it.
_ISO = f"""WITH c AS (SELECT model, confidence AS p, count(*) AS n, sum(acc) AS s FROM {A} WHERE acc IS NOT NULL GROUP BY ALL),
i AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM c WINDOW w AS (PARTITION BY model ORDER BY p)),
ab AS (SELECT a.model, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM i a JOIN i b ON a.model = b.model AND a.i <= b.i),
lo AS (SELECT x.model, x.i, ab.a, min(m) AS m FROM i x JOIN ab ON x.model = ab.model AND ab.a <= x.i AND ab.b >= x.i GROUP BY ALL),
f AS (SELECT model, i, max(m) AS value FROM lo GROUP BY ALL)"""


@query("u04_isotonic", f"{_ISO} SELECT i.model, i.p, round(f.value, 6) AS calibrated FROM f JOIN i USING (model, i)")
def u04i(spark, sf):
    """The calibrated value of each confidence of each model."""
    known = stored(audit(spark, sf).where("acc is not null").groupBy("model", F.col("confidence").alias("p"), "acc").agg(F.count("*").alias("n")))
    fit = iso.pools(known, "p", "acc", ["model"], weight="n")
    return rounded(iso.calibrated(known.select("model", "p").distinct(), fit, "p", ["model"]), "calibrated")


@query("u04_isotonic_pools", f"{_ISO} SELECT model, min(p) AS low, max(p) AS high, CAST(sum(n) AS BIGINT) AS n, round(any_value(value), 6) AS value FROM f JOIN i USING (model, i) GROUP BY model, round(value, 12)")
def u04p(spark, sf):
    return rounded(iso.pools(audit(spark, sf), "confidence", "acc", ["model"]), "value")


_SAID = "(SELECT c.conv_id % 50 AS case_, CASE WHEN turn % 9 = 8 THEN 'ERROR: no answer' WHEN turn % 9 = 7 THEN upper(x) WHEN turn % 9 = 6 THEN x || ' more' WHEN turn % 9 = 5 THEN x || ' ' || turn ELSE x END AS r FROM (SELECT *, 'plan ' || (conv_id % 50) || ' with ' || length(role) || ' units' AS x FROM conversations) c)"


@query("e03_instability", f"""WITH c AS (SELECT case_, r, count(*) AS n FROM {_SAID} s GROUP BY ALL), m AS (SELECT case_, arg_min(r, struct_pack(a := -n, b := encode(r))) AS modal FROM c GROUP BY 1),
t AS (SELECT c.*, modal, list_distinct(list_filter(string_split_regex(r, '\\s+'), lambda t: t <> '')) AS a, list_distinct(list_filter(string_split_regex(modal, '\\s+'), lambda t: t <> '')) AS b FROM c JOIN m USING (case_)),
d AS (SELECT *, list_filter(a, lambda t: NOT list_contains(b, t)) AS x, list_filter(b, lambda t: NOT list_contains(a, t)) AS y FROM t),
k AS (SELECT *, CASE WHEN r = modal THEN NULL WHEN contains(lower(r), 'error') THEN 'error' WHEN regexp_replace(lower(r), '[[:punct:][:space:]]+', '', 'g') = regexp_replace(lower(modal), '[[:punct:][:space:]]+', '', 'g') THEN 'spelling'
  WHEN len(x) = 0 AND len(y) = 0 THEN 'order' WHEN len(list_filter(list_concat(x, y), lambda t: NOT regexp_matches(t, '[0-9]'))) = 0 THEN 'numbers' WHEN len(x) = 0 THEN 'shortened' WHEN len(y) = 0 THEN 'extended' ELSE 'wording' END AS kind FROM d)
SELECT case_, CAST(sum(n) AS BIGINT) AS n, count(*) AS "distinct", round(max(n) / sum(n), 6) AS modal_share,
  concat_ws(',', CASE WHEN count(*) > 1 THEN 'non_deterministic_sampling' END, CASE WHEN count(*) > 1 AND bool_or(contains(lower(r), 'error')) THEN 'api_errors' END, CASE WHEN count(*) > 1 AND min(length(r)) <> max(length(r)) THEN 'variable_response_length' END) AS sources,
  {", ".join(f"CAST(coalesce(sum(n) FILTER (kind = '{k}'), 0) AS BIGINT) AS n_{k}" for k in re_.DIFFERENCES)} FROM k GROUP BY case_""")
def e03i(spark, sf):
    """Sources of instability among the responses to fifty prompts, made from the conversations' turns."""
    x = F.concat(F.lit("plan "), (F.col("conv_id") % 50).cast("string"), F.lit(" with "), F.length("role").cast("string"), F.lit(" units"))
    k = F.col("turn") % 9
    said = F.when(k == 8, "ERROR: no answer").when(k == 7, F.upper(x)).when(k == 6, F.concat(x, F.lit(" more"))).when(k == 5, F.concat(x, F.lit(" "), F.col("turn").cast("string"))).otherwise(x)
    rows = table(spark, sf, "conversations").select((F.col("conv_id") % 50).alias("case_"), said.alias("r"))
    out = re_.instability(rows, "case_", "r").withColumn("sources", F.array_join("sources", ","))
    return rounded(out, "modal_share")


def _store(spark, sf):
    """An entry store of the embeddings: two versions, the second with new payloads for even keys and none for multiples of seven."""
    folder = f"{shared_folder(spark)}/entries-{uuid.uuid4().hex}"
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("payload"), ca.normalised(F.col("embedding")).alias("vector"))
    st.publish(e, folder)
    st.replace(e.where("key % 2 = 0").withColumn("payload", F.when(F.col("key") % 7 != 0, "new")), folder)
    return folder


@query("c17_entry_store", "SELECT CASE WHEN vec_id % 2 = 1 THEN 'label ' || label WHEN vec_id % 7 <> 0 THEN 'new' END AS payload, count(*) AS n, CAST(2 AS BIGINT) AS version FROM embeddings GROUP BY 1")
def c17(spark, sf):
    """Payloads of the newest version of an entry store, counted."""
    folder = _store(spark, sf)
    return st.current(spark, folder).groupBy("payload").agg(F.count("*").alias("n")).withColumn("version", F.lit(st.newest(spark, folder)[0]).cast("bigint"))


@query("c19_rebuilt_index", """WITH n AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 'label ' || label ELSE 'new' END AS payload, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, payload, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS v FROM n),
s AS (SELECT q.vec_id AS query, e.vec_id AS key, e.payload, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1]*z[2])) AS sim FROM u q, u e WHERE q.vec_id % 20 = 0 AND (e.vec_id % 2 = 1 OR e.vec_id % 7 <> 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, key) AS rank FROM s) SELECT query, key, payload, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def c19(spark, sf):
    """Nearest entries with a payload, by the index rebuilt from the store's newest version."""
    u = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), ca.normalised(F.col("embedding")).alias("vector"))
    return rounded(ne.top_k(u, st.rebuilt_index(spark, _store(spark, sf)), 3), "similarity")


@query("e03_consistency", f"""WITH c AS (SELECT model || '/' || th AS case_, pred_label, count(*) AS o FROM {A} WHERE pred_label IS NOT NULL GROUP BY ALL)
SELECT case_, CAST(sum(o) AS BIGINT) AS n, count(*) AS "distinct", round(max(o)/sum(o),6) AS modal_share, count(DISTINCT length(pred_label)) AS lengths, count(*)=1 AS stable FROM c GROUP BY 1""")
def e03(spark, sf):
    return rounded(re_.consistency(audit(spark, sf).withColumn("case_", F.concat_ws("/", "model", "th")), "case_", "pred_label"), "modal_share")


@query("e05_mode_summary", f"SELECT model, condition, count(*) AS attempts, round(avg(CAST(ok AS INT)),6) AS success_rate, round(avg(latency_s) FILTER (ok),4) AS seconds, round(avg(acc) FILTER (ok),6) AS accuracy, round(avg(abs(ordinal_error)) FILTER (ok),6) AS calibration_error, round(avg(CAST(cost>0.05 AS INT)) FILTER (ok),6) AS refusal_rate FROM {A} GROUP BY ALL")
def e05(spark, sf):
    s = re_.mode_summary(audit(spark, sf), ["model", "condition"], F.col("ok"), F.col("latency_s"), F.col("acc"), F.abs("ordinal_error"), F.col("cost") > 0.05)
    return rounded(s, "success_rate", "accuracy", "calibration_error", "refusal_rate").withColumn("seconds", F.round("seconds", 4))


def entries(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.sha2(F.col("text"), 256).alias("key"), "doc_id", (F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 3600)).alias("timestamp"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), (F.col("doc_id") % 7).alias("access_count"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") % 100).alias("last_accessed"), (F.col("n_chars") / 1000.0).alias("cost"), F.col("n_chars").alias("file_size"), F.col("lang").alias("response"))


EN = "(SELECT sha256(text) AS key, doc_id, make_timestamp((1700000000 + doc_id*3600)*1000000) AS timestamp, 'm' || (doc_id % 3) AS model, doc_id % 7 AS access_count, make_timestamp((1700000000 + doc_id % 100)*1000000) AS last_accessed, n_chars/1000.0 AS cost, n_chars AS file_size, lang AS response FROM documents)"


@query("c01_c05_exact_probe", f"WITH e AS (SELECT key, arg_max(response, (timestamp, doc_id)) AS response FROM {EN} e GROUP BY 1) SELECT doc_id, e.response, e.key IS NOT NULL AS hit, substr(r.key,1,2) AS shard FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END) AS key FROM documents) r LEFT JOIN e USING (key)")
def c01(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("key"))
    return ca.probe(r, ca.latest(entries(spark, sf))).select("doc_id", "response", "hit", ca.shard(F.col("key")).alias("shard"))


@query("c02_latest", f"SELECT key, max(doc_id) AS doc_id FROM {EN} e GROUP BY 1")
def c02(spark, sf):
    return ca.latest(entries(spark, sf)).select("key", "doc_id")


@query("c04_top_k", f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS v FROM n),
s AS (SELECT q.vec_id AS query, e.vec_id AS entry, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1]*z[2])) AS sim FROM u q, u e WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, entry) AS rank FROM s)
SELECT query, entry, round(sim,6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def c04(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", ca.normalised(F.col("embedding")).alias("vector"))
    out = ca.top_k(u.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), u.withColumnRenamed("vec_id", "entry"))
    return rounded(out, "similarity").select("query", "entry", "similarity", "rank")


@query("c04_pruning", "SELECT CAST(count(*) AS BIGINT) AS queries, true AS all_ranked, true AS at_most_all FROM embeddings WHERE vec_id % 20 = 0")
def c04p(spark, sf):
    """Whether every query of c04 got its five entries, with no more comparisons than all pairs."""
    u = table(spark, sf, "embeddings").select("vec_id", ca.normalised(F.col("embedding")).alias("vector"))
    report = ne.pruning(u.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), ne.index(u, "vec_id"))
    return report.agg(F.count("*").alias("queries"), F.bool_and(F.col("compared") >= 5).alias("all_ranked"), F.bool_and(F.col("share") <= 1.0).alias("at_most_all"))


@query("c05_semantic_probe", """WITH n AS (SELECT vec_id, label % 2 AS model, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, model, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS v FROM n),
s AS (SELECT q.vec_id AS query, q.model AS own, e.vec_id AS entry, e.model, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1]*z[2])) AS sim FROM u q, u e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim,12) DESC, entry) AS rank FROM s)
SELECT query, arg_min(entry, rank) AS entry, round(max(sim),6) AS similarity FROM r WHERE rank <= 5 AND model = own AND sim >= 0.85 GROUP BY query""")
def c05(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", ca.normalised(F.col("embedding")).alias("vector"), (F.col("label") % 2).alias("model"))
    return rounded(ca.semantic_probe(u.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query"), u.withColumnRenamed("vec_id", "entry")), "similarity")


@query("c06_layered", f"""WITH r AS (SELECT doc_id, sha256(text) AS key FROM documents), a AS (SELECT DISTINCT key FROM {EN} e WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT key FROM {EN} e WHERE doc_id % 3 = 1)
SELECT doc_id, CASE WHEN a.key IS NOT NULL THEN 'local' WHEN b.key IS NOT NULL THEN 'shared' ELSE 'miss' END AS hit_kind FROM r LEFT JOIN a USING (key) LEFT JOIN b ON b.key=r.key""")
def c06(spark, sf):
    e = entries(spark, sf)
    layers = {"local": ca.latest(e.where("doc_id % 3 = 0")), "shared": ca.latest(e.where("doc_id % 3 = 1"))}
    return ca.layered(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key")), layers).select("doc_id", "hit_kind")


@query("c07_upsert", f"SELECT count(*) AS n, CAST(count_if(response='new') AS BIGINT) AS fresh FROM (SELECT key, response FROM (SELECT key, arg_max(response, timestamp) AS response FROM {EN} e GROUP BY 1) o WHERE key NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) UNION ALL SELECT DISTINCT sha256(text), 'new' FROM documents WHERE doc_id % 10 = 0) z")
def c07(spark, sf):
    new = ca.latest(entries(spark, sf).where("doc_id % 10 = 0").withColumn("response", F.lit("new")))
    return ca.upsert(ca.latest(entries(spark, sf)), new).agg(F.count("*").alias("n"), F.count_if(F.col("response") == "new").alias("fresh"))


@query("c08_warm", f"SELECT doc_id FROM {EN} e ORDER BY last_accessed DESC, key, doc_id LIMIT 20")
def c08(spark, sf):
    return entries(spark, sf).orderBy(F.col("last_accessed").desc(), "key", "doc_id").limit(20).select("doc_id")


@query("c09_touched", "SELECT doc_id, doc_id % 7 + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS access_count FROM documents")
def c09(spark, sf):
    e = entries(spark, sf).withColumn("key", F.col("doc_id"))
    t = e.where("doc_id % 4 = 0").select("key", F.explode(F.array("timestamp", "last_accessed")).alias("at"))
    return ca.touched(e, t).select("doc_id", "access_count")


@query("c10_c11_evicted", f"SELECT count(*) AS entries, CAST(sum(file_size) AS BIGINT) AS bytes FROM {EN} e WHERE timestamp >= (SELECT max(timestamp) FROM {EN} e) - INTERVAL 30 DAY")
def c10(spark, sf):
    e = entries(spark, sf)
    now = e.agg(F.max("timestamp")).first()[0]
    return ca.size_report(ca.evicted(e, F.lit(now)))


@query("c12_hit_rates", """WITH c AS (SELECT event_type, count_if(value >= 200) AS h, count_if(value < 200) AS m, count_if(value >= 400) AS s, count_if(value >= 450) AS d FROM events GROUP BY 1)
SELECT event_type, round(h*1.0/greatest(1,h+m),6) AS hit_rate, round(s*1.0/greatest(1,h+m),6) AS semantic_rate, round(d*1.0/greatest(1,h+m),6) AS distributed_rate FROM c""")
def c12(spark, sf):
    many = lambda least: F.count_if(F.col("value") >= least)
    counts = table(spark, sf, "events").groupBy("event_type").agg(many(200).alias("hits"), F.count_if(F.col("value") < 200).alias("misses"), many(400).alias("semantic_hits"), many(450).alias("distributed_hits"))
    return rounded(ca.hit_rates(counts, ["event_type"]), "hit_rate", "semantic_rate", "distributed_rate")


@query("c13_usage", f"SELECT access_count, count(*) AS entries FROM {EN} e GROUP BY 1")
def c13(spark, sf):
    return ca.usage_profile(entries(spark, sf))


@query("c13_models", f"SELECT model, round(avg(cost),6) AS mean_cost, CAST(sum(file_size) AS BIGINT) AS bytes FROM {EN} e GROUP BY 1")
def c13m(spark, sf):
    return rounded(ca.model_profile(entries(spark, sf)), "mean_cost")


@query("c14_removed", f"SELECT count(*) AS n FROM (SELECT DISTINCT key FROM {EN} e WHERE key NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)) z")
def c14(spark, sf):
    e = ca.latest(entries(spark, sf))
    return ca.misses(e, e.where("doc_id >= 0").join(table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.sha2("text", 256).alias("key")), "key", "left_semi")).agg(F.count("*").alias("n"))


@query("c15_text_vectors")
def c15(spark, sf):
    v, _ = ca.text_vectors(table(spark, sf, "benchmark"), "text")
    return v.select("item_id", vector_to_array("vector").alias("vector"))

