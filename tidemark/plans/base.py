"""Frames that bind the learning-log concepts to the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: user = customer, course = supplier, resource = part; an enrollment starts with the first order.
EVENTS = """ev AS (SELECT o_custkey AS user_id, l_suppkey AS course_id, l_partkey AS resource_id, o_orderdate AS enroll_time, l_shipdate AS event_time,
  l_quantity AS duration, 1 - l_discount AS speed, l_extendedprice AS score, l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ENROLLMENTS = f"""{EVENTS}, enr AS (SELECT user_id, course_id, min(enroll_time) AS enroll_time, count(*) AS n_events FROM ev GROUP BY 1, 2)"""
RUNS = f"""{EVENTS}, runs AS (SELECT course_id, date_trunc('month', enroll_time) AS run_month, min(enroll_time) AS run_start, max(enroll_time) AS run_end, count(DISTINCT user_id) AS n_users
  FROM ev GROUP BY 1, 2)"""
LABELLED = """lab AS (SELECT doc_id, source AS offering_id, lang AS course_id, n_chars, quality, toxic, quality * 2 + toxic - (quality * toxic) AS y_raw FROM documents JOIN labels USING (doc_id))"""
PREDICTIONS = """pred0 AS (SELECT doc_id, source AS offering_id, lang AS course_id, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS y_true,
    1.0 + doc_id % 7 AS a, 0.5 + n_chars % 5 + CASE WHEN quality = 0 THEN 3 ELSE 0 END AS b, 0.25 + doc_id % 3 + CASE WHEN toxic = 1 THEN 4 ELSE 0 END AS c, doc_id % 2 AS strict FROM documents JOIN labels USING (doc_id)),
  pred AS (SELECT doc_id, offering_id, course_id, y_true, strict, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2,
    CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS y_pred FROM pred0)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Interactions: order lines with their order's customer and date."""
    lines = read_table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("course_id"), F.col("l_partkey").alias("resource_id"), F.col("l_shipdate").alias("event_time"), F.col("l_quantity").alias("duration"),
        (1 - F.col("l_discount")).alias("speed"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"),
    )
    orders = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("enroll_time"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")


def enrollments(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id", "course_id").agg(F.min("enroll_time").alias("enroll_time"), F.count(F.lit(1)).alias("n_events"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Schedule runs: a course's months of enrollment, from first to last day."""
    return (
        events(spark, d)
        .groupBy("course_id", F.date_trunc("month", "enroll_time").alias("run_month"))
        .agg(F.min("enroll_time").alias("run_start"), F.max("enroll_time").alias("run_end"), F.count_distinct("user_id").alias("n_users"))
    )


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("offering_id"), F.col("lang").alias("course_id"), "n_chars")
    out = docs.join(read_table(spark, d, "labels"), "doc_id")
    return out.withColumn("y_raw", (F.col("quality") * 2 + F.col("toxic") - F.col("quality") * F.col("toxic")).cast("int"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows: three classes from the labels, probabilities from fixed functions of the row."""
    x = labelled(spark, d)
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    x = x.select(
        "doc_id", "offering_id", "course_id", F.when(toxic, 2).when(poor, 1).otherwise(0).alias("y_true"), (F.col("doc_id") % 2).cast("int").alias("strict"),
        (1.0 + F.col("doc_id") % 7).alias("a"), (0.5 + F.col("n_chars") % 5 + F.when(poor, 3).otherwise(0)).alias("b"), (0.25 + F.col("doc_id") % 3 + F.when(toxic, 4).otherwise(0)).alias("c"),
    )
    total = F.col("a") + F.col("b") + F.col("c")
    best = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), 0).when(F.col("b") >= F.col("c"), 1).otherwise(2)
    return x.select("doc_id", "offering_id", "course_id", "y_true", "strict", *((F.col(v) / total).alias(p) for v, p in (("a", "p0"), ("b", "p1"), ("c", "p2"))), best.alias("y_pred"))
