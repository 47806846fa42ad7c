"""The audit-shaped view over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equilens.functions import rubric as ru

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """A double rounded for comparison, without negative zero."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of subjects under four conditions, with true and predicted labels; both column presets."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order) - 1)
    b = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("rn") % 4
    shift = F.col("l_quantity").cast("int") % 10
    out = b.select(
        F.col("l_orderkey").alias("subject_id"), F.floor(F.col("rn") / 4).cast("bigint").alias("run_idx"), F.get(F.array(*map(F.lit, ("ND", "N", "L", "NL"))), k).alias("condition"),
        F.col("o_orderstatus").alias("provider"), F.col("o_orderpriority").alias("model"), F.when(k.isin(1, 3), F.col("c_mktsegment")).alias("name_group"), F.when(k.isin(2, 3), F.col("n_name")).alias("city"),
        (8 + F.col("l_orderkey") % 33).cast("int").alias("toi"), (2 + (F.col("l_orderkey") * 7) % 9).cast("int").alias("th"),
        F.when(shift == 0, 1).when(shift == 1, -1).otherwise(0).alias("ord_shift"), (F.col("l_tax") < 0.08).alias("ok"),
        F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("latency_s"), F.col("l_discount").alias("cost"), F.when(F.col("l_linestatus") == "O", "Female").otherwise("Male").alias("gender"),
        (20 + F.col("l_quantity")).cast("int").alias("age"), F.col("l_returnflag").alias("ethnicity"), F.col("n_name").alias("location"), (F.floor(F.col("l_extendedprice") * 7) % 101 / 101.0).alias("confidence"),
    )
    out = out.withColumn("true_ord", ru.label_ord(F.col("toi"), F.col("th"))).withColumn("pred_ord", F.when(F.col("ok"), F.greatest(F.lit(0), F.least(F.lit(5), F.col("true_ord") + F.col("ord_shift")))))
    return (
        out.withColumn("true_label", ru.label_of(F.col("true_ord"))).withColumn("pred_label", ru.label_of(F.col("pred_ord")))
        .withColumn("true_growth", ru.growth_of(F.col("true_ord")).cast("double")).withColumn("proposed_growth", ru.growth_of(F.col("pred_ord")).cast("double"))
        .withColumn("acc", ru.accuracy(F.col("pred_label"), F.col("true_label"))).withColumn("ordinal_error", F.col("pred_ord") - F.col("true_ord"))
        .withColumn("age_group", F.when(F.col("age") <= 35, "young").when(F.col("age") <= 55, "middle").otherwise("older"))
    )


#: The same view in SQL. The cuts between labels are written out, and don't come from the Spark side's rule.
AUDIT = """(WITH cuts(th, c0, c1, c2, c3, c4) AS (VALUES (2,18,22,26,30,34),(3,17,21,25,29,33),(4,16,20,24,28,32),(5,15,19,23,27,31),(6,14,18,22,26,30),(7,13,17,21,25,29),(8,12,16,20,24,28),(9,11,15,19,23,27),(10,10,14,18,22,26)),
dim(o, label, growth) AS (VALUES (0,'Cash',0.0),(1,'Capital Stable',35.0),(2,'Balanced',52.0),(3,'Balanced Growth',70.0),(4,'Growth',82.0),(5,'High Growth',93.0)),
b AS (SELECT l.*, o_orderstatus, o_orderpriority, c_mktsegment, n_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate,l_quantity,l_discount,l_tax) - 1 AS rn
  FROM lineitem l JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey),
v AS (SELECT l_orderkey AS subject_id, CAST(floor(rn/4) AS BIGINT) AS run_idx, CASE rn%4 WHEN 0 THEN 'ND' WHEN 1 THEN 'N' WHEN 2 THEN 'L' ELSE 'NL' END AS condition,
  o_orderstatus AS provider, o_orderpriority AS model, CASE WHEN rn%4 IN (1,3) THEN c_mktsegment END AS name_group, CASE WHEN rn%4 IN (2,3) THEN n_name END AS city,
  CAST(8 + l_orderkey % 33 AS INT) AS toi, CAST(2 + (l_orderkey*7) % 9 AS INT) AS th, CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS ord_shift, l_tax < 0.08 AS ok,
  l_shipdate AS ts, l_extendedprice AS latency_s, l_discount AS cost, CASE WHEN l_linestatus='O' THEN 'Female' ELSE 'Male' END AS gender, CAST(20 + l_quantity AS INT) AS age, l_returnflag AS ethnicity, n_name AS location,
  floor(l_extendedprice*7) % 101 / 101.0 AS confidence FROM b),
t AS (SELECT v.*, CASE WHEN toi<=c0 THEN 0 WHEN toi<=c1 THEN 1 WHEN toi<=c2 THEN 2 WHEN toi<=c3 THEN 3 WHEN toi<=c4 THEN 4 ELSE 5 END AS true_ord FROM v JOIN cuts USING (th)),
p AS (SELECT t.*, CASE WHEN ok THEN greatest(0, least(5, true_ord + ord_shift)) END AS pred_ord FROM t)
SELECT p.*, dt.label AS true_label, dp.label AS pred_label, CAST(dt.growth AS DOUBLE) AS true_growth, CAST(dp.growth AS DOUBLE) AS proposed_growth, CAST(pred_ord = true_ord AS INT) AS acc, pred_ord - true_ord AS ordinal_error,
  CASE WHEN age<=35 THEN 'young' WHEN age<=55 THEN 'middle' ELSE 'older' END AS age_group
FROM p JOIN dim dt ON dt.o=true_ord LEFT JOIN dim dp ON dp.o=pred_ord)"""
