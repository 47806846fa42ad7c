"""Queries of the temporal operators over ``events`` (series: event_type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilens.operators import changes as ch
from equilens.operators import temporal as te

from .audit import query, r6, table
from .fairness import rounded


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("version", F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")))


E = "(SELECT *, 'v' || (user_id % 4) AS version FROM events)"


@query("t02_linear_trend", f"""WITH d AS (SELECT event_type, value AS y, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 86400000000.0) AS DOUBLE) AS x FROM {E} e),
s AS (SELECT event_type, count(*) AS n, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, regr_r2(y,x) AS r2, regr_sxx(y,x) AS sxx, regr_syy(y,x) AS syy, regr_sxy(y,x) AS sxy FROM d GROUP BY 1)
SELECT event_type, n, round(b,6) AS slope, round(a,6) AS intercept, round(r2,6) AS r2, round(sqrt((syy-b*sxy)/(n-2)/sxx),6) AS se, round(b/sqrt((syy-b*sxy)/(n-2)/sxx),6) AS t, n-2 AS dof FROM s""")
def t02(spark, sf):
    d = te.day_offset(events(spark, sf), "ts", ["event_type"])
    return rounded(te.linear_trend(d, "value", by=["event_type"]), "slope", "intercept", "r2", "se", "t")


_V = f"(SELECT version, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value,0.5) AS median, var_samp(value) AS v, var_pop(value) AS p FROM {E} e GROUP BY 1)"
_T = "(b.mean-a.mean)/sqrt(((b.n-1)*b.v+(a.n-1)*a.v)/(a.n+b.n-2)*(1.0/a.n+1.0/b.n))"


@query("t04_version_summary", f"SELECT version, n, round(mean,6) AS mean, round(sd,6) AS std, round(median,6) AS median FROM {_V} v")
def t04(spark, sf):
    return rounded(te.versions(events(spark, sf), "version", "value").drop("v", "p"), "mean", "std", "median")


@query("t04_version_changes", f"WITH v AS {_V}, o AS (SELECT *, lag(version) OVER (ORDER BY version) AS prev FROM v) SELECT a.version AS version_a, b.version AS version_b, round(b.mean-a.mean,6) AS diff, round({_T},6) AS t, a.n+b.n-2 AS dof, round((b.mean-a.mean)/sqrt((a.p+b.p)/2),6) AS d FROM o b JOIN v a ON a.version=b.prev")
def t04c(spark, sf):
    return rounded(te.version_changes(events(spark, sf), "version", "value"), "diff", "t", "d")


@query("t08_version_pairs", f"WITH v AS {_V} SELECT a.version AS version_a, b.version AS version_b, round(b.mean-a.mean,6) AS diff, round({_T},6) AS t, a.n+b.n-2 AS dof, round((b.mean-a.mean)/sqrt((a.p+b.p)/2),6) AS d FROM v a JOIN v b ON a.version<b.version")
def t08(spark, sf):
    return rounded(te.version_changes(events(spark, sf), "version", "value", consecutive=False), "diff", "t", "d")


@query("t04_timeline", f"SELECT version, min(ts) AS first_seen, max(ts) AS last_seen FROM {E} e GROUP BY 1")
def t04t(spark, sf):
    return te.timeline(events(spark, sf), "version", "ts")


@query("t05_stability", f"""WITH r AS (SELECT event_type, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n, stddev_samp(value) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rs FROM {E} e WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)),
s AS (SELECT event_type, count(*) AS n, stddev_pop(value) AS sd, avg(value) AS m, max(value)-min(value) AS rg, quantile_cont(value,0.75)-quantile_cont(value,0.25) AS iqr, avg(rs) FILTER (i>=10) AS rm, stddev_samp(rs) FILTER (i>=10) AS rsd FROM r GROUP BY 1)
SELECT event_type, n, round(sd,6) AS std, round(sd/m,6) AS cv, round(m/sd,6) AS stability, round(rg,6) AS range, round(iqr,6) AS iqr, round(rm,5) AS rolling_mean, round(rsd,5) AS rolling_std FROM s""")
def t05(spark, sf):
    out = rounded(te.stability(events(spark, sf), "ts", "value", ["event_type"]), "std", "cv", "stability", "range", "iqr")
    return out.withColumn("rolling_mean", F.round("rolling_mean", 5)).withColumn("rolling_std", F.round("rolling_std", 5))


@query("t06_t07_drift", f"""WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {E} e),
b AS (SELECT *, avg(x) FILTER (i < n // 3) OVER (PARTITION BY event_type) AS m, stddev_pop(x) FILTER (i < n // 3) OVER (PARTITION BY event_type) AS sd FROM r),
p AS (SELECT *, sum(CASE WHEN i>0 THEN x-m-1.5*sd ELSE 0 END) OVER w AS pu, sum(CASE WHEN i>0 THEN -(x-m)-1.5*sd ELSE 0 END) OVER w AS pd, sum(CASE WHEN i>0 THEN x-m-sd ELSE 0 END) OVER w AS pp FROM b WINDOW w AS (PARTITION BY event_type ORDER BY i)),
c AS (SELECT *, pu - least(0, min(pu) OVER w) AS cu, pd - least(0, min(pd) OVER w) AS cd, pp - least(0, min(pp) OVER w) AS cp FROM p WINDOW w AS (PARTITION BY event_type ORDER BY i))
SELECT event_type, count(*) AS n, round(max(cu),4) AS cusum_up, min(CASE WHEN cu>3*sd THEN i END) AS first_up, round(max(cd),4) AS cusum_down, min(CASE WHEN cd>3*sd THEN i END) AS first_down, round(max(cp),4) AS ph_max, min(CASE WHEN cp>10 THEN i END) AS first_ph FROM c GROUP BY 1""")
def t06(spark, sf):
    d = te.drift(events(spark, sf), "ts", "value", ["event_type"])
    for c in ("cusum_up", "cusum_down", "ph_max"):
        d = d.withColumn(c, F.round(c, 4))
    return d.withColumn("first_up", F.col("first_up").cast("bigint")).withColumn("first_down", F.col("first_down").cast("bigint")).withColumn("first_ph", F.col("first_ph").cast("bigint"))


#: By the rules of the survey: the period from the median step, half-weighted ends of even periods, lines of least squares at the ends.
_SEASON = f"""WITH r AS (SELECT event_id, event_type, value AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap
  FROM {E} e WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)),
d AS (SELECT event_type, floor(quantile_cont(gap, 0.5) / 86400000000) AS days FROM r GROUP BY 1),
u AS (SELECT r.*, CASE WHEN days <= 1 THEN 7 WHEN days <= 7 THEN 4 ELSE 12 END AS q FROM r JOIN d USING (event_type) WHERE n >= 12),
p AS (SELECT *, CASE WHEN n < 2 * q THEN n // 2 ELSE q END AS p, (CASE WHEN n < 2 * q THEN n // 2 ELSE q END) // 2 AS h FROM u),
m AS (SELECT a.event_id, sum(b.x * CASE WHEN a.p % 2 = 0 AND abs(a.i - b.i) = a.h THEN 0.5 ELSE 1.0 END) / a.p AS t
  FROM p a JOIN p b ON a.event_type = b.event_type AND b.i BETWEEN a.i - a.h AND a.i + a.h WHERE a.i >= a.h AND a.i < a.n - a.h GROUP BY a.event_id, a.p),
j AS (SELECT p.*, t FROM p LEFT JOIN m USING (event_id)),
f AS (SELECT event_type, regr_slope(t, i) FILTER (i >= h AND i < least(h + p, n - 1 - h)) AS k0, regr_intercept(t, i) FILTER (i >= h AND i < least(h + p, n - 1 - h)) AS n0,
  regr_slope(t, i) FILTER (i >= greatest(h, n - 1 - h - p) AND i < n - 1 - h) AS k1, regr_intercept(t, i) FILTER (i >= greatest(h, n - 1 - h - p) AND i < n - 1 - h) AS n1 FROM j GROUP BY 1),
tr AS (SELECT j.*, coalesce(t, CASE WHEN i < h THEN k0 * i + n0 ELSE k1 * i + n1 END) AS trend FROM j JOIN f USING (event_type)),
ph AS (SELECT event_type, i % p AS z, avg(x - trend) AS s FROM tr GROUP BY ALL), c AS (SELECT event_type, z, s - avg(s) OVER (PARTITION BY event_type) AS season FROM ph),
parts AS (SELECT tr.event_type, event_id, x, p, trend, season FROM tr JOIN c ON tr.event_type = c.event_type AND tr.i % p = c.z)"""


@query("t09_seasonal", f"{_SEASON} SELECT event_id, round(trend,5) AS trend, round(season,5) AS season, round(x-trend-season,5) AS rest FROM parts")
def t09(spark, sf):
    s = te.seasonal(events(spark, sf), "ts", "value", by=["event_type"])
    return s.select("event_id", *[F.round(c, 5).alias(c) for c in ("trend", "season", "rest")])


@query("t09_daily_seasons", """WITH r AS (SELECT date_trunc('day', ts) AS day, avg(value) AS x FROM events GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM r),
t AS (SELECT a.i, sum(b.x) / 7 AS t FROM q a JOIN q b ON b.i BETWEEN a.i - 3 AND a.i + 3 WHERE a.i BETWEEN 3 AND a.n - 4 GROUP BY 1), j AS (SELECT q.*, t FROM q LEFT JOIN t USING (i)),
f AS (SELECT regr_slope(t, i) FILTER (i < least(10, n - 4)) AS k0, regr_intercept(t, i) FILTER (i < least(10, n - 4)) AS n0, regr_slope(t, i) FILTER (i >= n - 11 AND i < n - 4) AS k1, regr_intercept(t, i) FILTER (i >= n - 11 AND i < n - 4) AS n1 FROM j),
tr AS (SELECT j.*, coalesce(t, CASE WHEN i < 3 THEN k0 * i + n0 ELSE k1 * i + n1 END) AS trend FROM j, f), ph AS (SELECT i % 7 AS z, avg(x - trend) AS s FROM tr GROUP BY 1), c AS (SELECT z, s - avg(s) OVER () AS season FROM ph)
SELECT day, round(x, 5) AS x, round(trend, 5) AS trend, round(season, 5) AS season FROM tr JOIN c ON i % 7 = z""")
def t09d(spark, sf):
    days = events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("x"))
    return te.seasonal(days, "day", "x").select("day", *[F.round(c, 5).alias(c) for c in ("x", "trend", "season")])


@query("t09_strength", f"{_SEASON} SELECT event_type, CAST(p AS INT) AS period, round(var_pop(season) / var_pop(x), 6) AS strength FROM parts GROUP BY ALL")
def t09s(spark, sf):
    return rounded(te.seasonal_strength(te.seasonal(events(spark, sf), "ts", "value", by=["event_type"]), "value", ["event_type"]), "strength")


@query("t10_rolling", f"SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),5) AS rolling FROM {E} e")
def t10(spark, sf):
    return te.rolling_mean(events(spark, sf), "ts", "value", ["event_type"]).select("event_id", F.round("rolling", 5).alias("rolling"))


@query("t11_hour_crosstab", f"SELECT CAST(hour(ts) AS INT) AS hour, count(*) FILTER (version='v0') AS v0, count(*) FILTER (version='v1') AS v1, count(*) FILTER (version='v2') AS v2, count(*) FILTER (version='v3') AS v3 FROM {E} e GROUP BY 1")
def t11(spark, sf):
    return te.hour_crosstab(events(spark, sf), "ts", "version", ["v0", "v1", "v2", "v3"])


@query("t12_mean_by_time", "SELECT date_trunc('hour', ts) AS t, round(avg(value),6) AS mean FROM events GROUP BY 1")
def t12(spark, sf):
    e = events(spark, sf).withColumn("t", F.date_trunc("hour", "ts"))
    return rounded(te.mean_by_time(e, "t", "value"), "mean")


@query("t13_frames", "WITH f AS (SELECT CAST(ts AS DATE) AS d, value FROM events), g AS (SELECT d, dense_rank() OVER (ORDER BY d) AS frame, value FROM f), h AS (SELECT frame, count(*) AS k, sum(value) AS s FROM g GROUP BY 1) SELECT CAST(frame AS BIGINT) AS frame, CAST(sum(k) OVER (ORDER BY frame) AS BIGINT) AS n, round(sum(s) OVER (ORDER BY frame) / sum(k) OVER (ORDER BY frame),6) AS mean FROM h")
def t13(spark, sf):
    from pyspark.sql import Window

    f = te.frames(events(spark, sf).withColumn("d", F.to_date("ts")), "d").groupBy("frame").agg(F.count("*").alias("k"), F.sum("value").alias("s"))
    w = Window.orderBy("frame")  # one row for each distinct day
    return f.select(F.col("frame").cast("bigint").alias("frame"), F.sum("k").over(w).alias("n"), r6(F.sum("s").over(w) / F.sum("k").over(w)).alias("mean"))


@query("t14_histogram", "SELECT CAST(least(9, floor(value/500.0*10)) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def t14(spark, sf):
    return te.histogram(events(spark, sf), "value", 0.0, 500.0, 10)


@query("x_ks_drift", "WITH m AS (SELECT quantile_cont(epoch_us(ts), 0.5) AS c FROM events), g AS (SELECT value AS x, count_if(epoch_us(ts) <= c) AS a, count_if(epoch_us(ts) > c) AS b FROM events, m GROUP BY 1), k AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS d, a, b FROM g) SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, round(max(d),6) AS d FROM k")
def ks(spark, sf):
    e = events(spark, sf).withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    cut = e.agg(F.percentile("u", F.lit(0.5))).first()[0]
    return rounded(te.ks_drift(e, "value", F.col("u") <= F.lit(cut)), "d")


@query("t09_period", f"""WITH g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6 AS gap FROM {E} e),
s AS (SELECT event_type, count(*) AS n, quantile_cont(gap, 0.5) AS step FROM g GROUP BY 1),
q AS (SELECT *, CASE WHEN floor(step / 86400) <= 1 THEN 7 WHEN floor(step / 86400) <= 7 THEN 4 ELSE 12 END AS p FROM s)
SELECT event_type, n, round(step,6) AS step, CAST(CASE WHEN n >= 12 THEN CASE WHEN n < 2 * p THEN n // 2 ELSE p END END AS INT) AS period FROM q""")
def t09p(spark, sf):
    return rounded(te.infer_period(events(spark, sf), "ts", ["event_type"]), "step")


@query("t03_change_points")
def t03(spark, sf):
    """Segments of each event type's values by the kernel cost (penalty 10)."""
    return ch.change_points(events(spark, sf), "ts", "value", ["event_type"])


@query("t01_group_trends", f"""WITH d AS (SELECT version, value AS y, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY version)) / 86400000000.0) AS DOUBLE) AS x FROM {E} e)
SELECT version, count(*) AS n, round(regr_slope(y,x),6) AS slope, round(regr_intercept(y,x),6) AS intercept, round(regr_r2(y,x),6) AS r2 FROM d GROUP BY 1""")
def t01(spark, sf):
    parts = te.analysis(events(spark, sf), "ts", "value", groups=["version"])
    return rounded(parts["trend_by_version"], "slope", "intercept", "r2").select("version", "n", "slope", "intercept", "r2")
