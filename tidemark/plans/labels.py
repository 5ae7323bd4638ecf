"""Queries of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..sources.tables import read_table, scratch_path
from .base import ENROLLMENTS, EVENTS, LABELLED, enrollments, events, labelled
from .registry import query

#: Progress of an enrollment: share of items, of value, and of days, each bounded.
PROGRESS = f"""{ENROLLMENTS}, tot AS (SELECT course_id, count(DISTINCT resource_id) AS items, max(n_events) AS most FROM ev JOIN enr USING (user_id, course_id) GROUP BY 1),
  pr AS (SELECT e.user_id, e.course_id, least(greatest(count(DISTINCT v.resource_id) / any_value(t.items) * 30, 0), 1) AS a, least(greatest(sum(v.duration) / 100, 0), 1) AS b,
    CASE WHEN count(*) FILTER (WHERE v.flag = 'R') = 0 THEN NULL ELSE least(avg(v.speed) FILTER (WHERE v.flag = 'R'), 1) END AS c FROM enr e JOIN ev v USING (user_id, course_id) JOIN tot t USING (course_id) GROUP BY 1, 2)"""


def progress(spark, d):
    ev = events(spark, d)
    items = ev.groupBy("course_id").agg(F.count_distinct("resource_id").alias("items"))
    per = ev.groupBy("user_id", "course_id").agg(F.count_distinct("resource_id").alias("k"), F.sum("duration").alias("dur"), F.avg(F.when(F.col("flag") == "R", F.col("speed"))).alias("v"))
    x = per.join(items, "course_id")
    return x.select("user_id", "course_id", L.bounded_ratio(F.col("k") * 30.0, F.col("items")).alias("a"), L.bounded_ratio(F.col("dur"), F.lit(100.0)).alias("b"), F.when(F.col("v").isNotNull(), F.least(F.col("v"), F.lit(1.0))).alias("c"))


@query(
    "l1_effective_score",
    f"""WITH {EVENTS} SELECT src, count(*) AS n, round(sum(s), 2) AS total FROM (SELECT CASE WHEN line <> 3 THEN 'observed' WHEN flag <> 'N' THEN 'rebuilt' ELSE 'unresolved' END AS src,
    CASE WHEN line <> 3 THEN score WHEN flag <> 'N' THEN CASE WHEN flag = 'R' THEN p_retailprice ELSE 0 END END AS s FROM ev JOIN part ON p_partkey = resource_id) GROUP BY 1""",
)
def l1(spark, d):
    x = events(spark, d).join(read_table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), "p_retailprice"), "resource_id")
    score, source = L.effective_score(F.when(F.col("line") != 3, F.col("score")), F.when(F.col("flag") != "N", F.col("flag") == "R"), F.col("p_retailprice"))
    return x.select(score.alias("s"), source.alias("src")).groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("l2_within_window", f"WITH {ENROLLMENTS} SELECT e.user_id, count(*) AS n FROM enr e JOIN ev v USING (user_id, course_id) WHERE v.event_time >= e.enroll_time AND v.event_time < e.enroll_time + INTERVAL 60 DAY GROUP BY 1")
def l2(spark, d):
    spine = enrollments(spark, d).select("user_id", "course_id", F.col("enroll_time").alias("s"), (F.col("enroll_time") + F.expr("interval 60 day")).alias("e"))
    return L.within_window(events(spark, d), spine, ["user_id", "course_id"], "event_time", "s", "e").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "l3_outcome_aggregates",
    f"WITH {EVENTS} SELECT user_id, course_id, count(*) FILTER (WHERE flag = 'R') AS problems, count(DISTINCT resource_id) AS items, round(max(score), 2) AS best FROM ev GROUP BY 1, 2",
)
def l3(spark, d):
    return events(spark, d).groupBy("user_id", "course_id").agg(F.count_if(F.col("flag") == "R").alias("problems"), F.count_distinct("resource_id").alias("items"), F.round(F.max("score"), 2).alias("best"))


@query(
    "l4_population",
    f"WITH {ENROLLMENTS}, act AS (SELECT DISTINCT user_id, course_id FROM ev WHERE flag = 'R') SELECT source, count(*) AS n FROM (SELECT 'timeline' AS source FROM enr WHERE n_events > 1 UNION ALL SELECT 'proxy' FROM enr JOIN act USING (user_id, course_id) WHERE n_events = 1) GROUP BY 1",
)
def l4(spark, d):
    pairs = events(spark, d).groupBy("user_id", "course_id").agg(F.count(F.lit(1)).alias("n_events"), F.max(F.col("flag") == "R").alias("active"))
    source = F.when(F.col("n_events") > 1, "timeline").when(F.col("active"), "proxy")
    return pairs.select(source.alias("source")).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "l5_effective_weights",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0 END AS wa, CASE WHEN p_size % 3 = 0 THEN 0.3 ELSE 0 END AS wb, p_type = 'PROMO' AS ha, p_size > 10 AS hb FROM part),
    y AS (SELECT *, wa * ha::INT AS ua, wb * hb::INT AS ub, ha::INT + hb::INT AS k FROM x) SELECT p_partkey, round(CASE WHEN ua + ub > 0 THEN ua / (ua + ub) WHEN k > 0 THEN ha::INT / k END, 6) AS video, round(CASE WHEN ua + ub > 0 THEN ub / (ua + ub) WHEN k > 0 THEN hb::INT / k END, 6) AS problem FROM y""",
)
def l5(spark, d):
    w = L.effective_weights(
        {"video": F.when(F.col("p_size") % 2 == 0, 0.5).otherwise(0.0), "problem": F.when(F.col("p_size") % 3 == 0, 0.3).otherwise(0.0)}, {"video": F.col("p_type") == "PROMO", "problem": F.col("p_size") > 10}
    )
    return read_table(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in w.items()))


@query("l6_progress_ratios", f"WITH {PROGRESS} SELECT user_id, course_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM pr")
def l6(spark, d):
    return progress(spark, d).select("user_id", "course_id", *(F.round(x, 6).alias(x) for x in "abc"))


@query(
    "l7_minmax_in_group",
    """SELECT p_partkey, round(CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (p_retailprice - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_size) AS lo, max(p_retailprice) OVER (PARTITION BY p_size) AS hi FROM part)""",
)
def l7(spark, d):
    return L.minmax_in_group(read_table(spark, d, "part"), "p_size", ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_scaled", 6).alias("scaled"))


@query("l8_masked_mean", f"WITH {PROGRESS} SELECT user_id, course_id, round((a + b + coalesce(c, 0)) / (2 + (c IS NOT NULL)::INT), 6) AS score, round((2 + (c IS NOT NULL)::INT) / 3, 6) AS coverage FROM pr")
def l8(spark, d):
    mean, coverage = L.masked_mean([F.col(x) for x in "abc"])
    return progress(spark, d).select("user_id", "course_id", F.round(mean, 6).alias("score"), F.round(coverage, 6).alias("coverage"))


@query("l9_breadth_score", f"WITH {PROGRESS} SELECT course_id, round(avg((a + b) / 2), 6) AS score FROM pr GROUP BY 1")
def l9(spark, d):
    return progress(spark, d).groupBy("course_id").agg(F.round(F.avg((F.col("a") + F.col("b")) / 2), 6).alias("score"))


@query(
    "l10_weighted_completion",
    f"WITH {PROGRESS} SELECT user_id, course_id, round((a * 0.5 + b * 0.3 + coalesce(c, 0) * 0.2) / (0.8 + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 6) AS with_comments, round((a * 0.5 + b * 0.3) / 0.8, 6) AS without_comments FROM pr",
)
def l10(spark, d):
    cols, w = [F.col(x) for x in "abc"], [F.lit(0.5), F.lit(0.3), F.lit(0.2)]
    return progress(spark, d).select("user_id", "course_id", F.round(L.weighted_mean(cols, w), 6).alias("with_comments"), F.round(L.weighted_mean(cols[:2], w[:2]), 6).alias("without_comments"))


BAND_SQL = "CASE WHEN s IS NULL THEN NULL WHEN s >= 0.6 THEN 'good' WHEN s >= 0.3 THEN 'average' ELSE 'poor' END"


@query("l11_floors", f"WITH {PROGRESS} SELECT failed, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN a < 0.2003 THEN 'items' END, CASE WHEN b < 0.3 THEN 'time' END, CASE WHEN c < 0.9503 THEN 'score' END) AS failed FROM pr) GROUP BY 1")
def l11(spark, d):
    failed = L.failed_floors({"items": (F.col("a"), 0.2003), "time": (F.col("b"), 0.3), "score": (F.col("c"), 0.9503)})
    return progress(spark, d).groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))


GEO = "CASE WHEN c IS NOT NULL THEN pow(a, 0.5) * pow(b, 0.3) * pow(c, 0.2) END"


def geo():
    return L.weighted_geo_mean([F.col(x) for x in "abc"], [0.5, 0.3, 0.2], F.lit(True))


@query("l12_geometric_mean", f"WITH {PROGRESS} SELECT user_id, course_id, round({GEO}, 6) AS score FROM pr")
def l12(spark, d):
    return progress(spark, d).select("user_id", "course_id", F.round(geo(), 6).alias("score"))


@query("l13_bands", f"WITH {PROGRESS} SELECT {BAND_SQL} AS band, CASE WHEN s IS NULL THEN 'missing_component' END AS reason, count(*) AS n FROM (SELECT {GEO} AS s FROM pr) GROUP BY 1, 2")
def l13(spark, d):
    x = progress(spark, d).withColumn("s", geo())
    return x.groupBy(L.band(F.col("s"), [("good", 0.6), ("average", 0.3)], "poor").alias("band"), F.when(F.col("s").isNull(), "missing_component").alias("reason")).agg(F.count("*").alias("n"))


@query("l14_vector_proximity", f"WITH {PROGRESS} SELECT user_id, course_id, round(1 - sqrt(pow(1 - a, 2) + pow(1 - b, 2) + pow(1 - c, 2)) / sqrt(3), 6) AS proximity FROM pr")
def l14(spark, d):
    return progress(spark, d).select("user_id", "course_id", F.round(L.vector_proximity([F.col(x) for x in "abc"]), 6).alias("proximity"))


@query("l15_hash_order_sample", "SELECT o_orderkey, row_number() OVER (ORDER BY sha256('42:' || o_orderkey), o_orderkey) <= 500 AS removed FROM orders")
def l15(spark, d):
    return L.hash_order_sample(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 42)


@query("l16_crosstab", f"WITH {LABELLED} SELECT course_id, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lab GROUP BY 1, 2")
def l16(spark, d):
    return L.crosstab(labelled(spark, d), ["course_id", "quality"]).withColumn("share", F.round("share", 6))


@query("l17_score_bins", f"WITH {PROGRESS} SELECT round(floor(least(a, 0.95) / 0.1) * 0.1, 6) AS bin_low, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pr GROUP BY 1")
def l17(spark, d):
    return L.score_bins(progress(spark, d), F.col("a"), 0.1).withColumn("share", F.round("share", 6))


@query(
    "l18_metric_summary",
    f"WITH {PROGRESS}, u AS (SELECT 'a' AS metric, a AS v FROM pr UNION ALL SELECT 'b', b FROM pr UNION ALL SELECT 'c', c FROM pr) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS p50, round(max(v), 6) AS high FROM u GROUP BY 1",
)
def l18(spark, d):
    path = scratch_path(spark, "progress")  # the summary reads it twice
    progress(spark, d).select("a", "b", "c").write.parquet(path)
    out = L.metric_summary(spark.read.parquet(path), ["a", "b", "c"])
    return out.select("metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "high")))


@query("l19_label_profile", f"WITH {LABELLED} SELECT offering_id, count(*) FILTER (WHERE y_raw = 0) AS \"0\", count(*) FILTER (WHERE y_raw = 1) AS \"1\", count(*) FILTER (WHERE y_raw = 2) AS \"2\" FROM lab GROUP BY 1")
def l19(spark, d):
    x = labelled(spark, d).withColumn("y", F.col("y_raw").cast("string"))
    return L.label_profile(x, "offering_id", "y", ["0", "1", "2"])


@query("l20_global_audit", f"WITH {PROGRESS} SELECT count(*) AS n, count(*) FILTER (WHERE c IS NULL) AS no_score, count(*) FILTER (WHERE a >= 1) AS full_items, count(DISTINCT user_id) AS users FROM pr")
def l20(spark, d):
    return progress(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("c").isNull()).alias("no_score"), F.count_if(F.col("a") >= 1).alias("full_items"), F.count_distinct("user_id").alias("users"))


EXAM = """cat AS (SELECT p_brand AS course_id, p_partkey, [CAST(p_size // 10 AS INTEGER), CAST(p_size % 10 AS INTEGER)] AS path, p_brand <> 'Brand#2' AS has_exam FROM part),
  ex AS (SELECT *, has_exam AND path = max(path) OVER (PARTITION BY course_id) AS is_exam FROM cat)"""


def exam(spark, d):
    text = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    x = read_table(spark, d, "part").select(F.col("p_brand").alias("course_id"), "p_partkey", L.chapter_path(text).alias("path"))
    return L.exam_partition(x, "course_id", "path", F.col("course_id") != "Brand#2")


@query("l21_exam_partition", f"WITH {EXAM} SELECT p_partkey, is_exam FROM ex")
def l21(spark, d):
    return exam(spark, d).select("p_partkey", "is_exam")


@query("l22_catalog_counts", f"WITH {EXAM} SELECT course_id, count(*) FILTER (WHERE is_exam) AS exam_items, count(*) FILTER (WHERE NOT is_exam) AS other_items FROM ex GROUP BY 1")
def l22(spark, d):
    return exam(spark, d).groupBy("course_id").agg(F.count_if("is_exam").alias("exam_items"), F.count_if(~F.col("is_exam")).alias("other_items"))


@query("l23_best_scores", f"WITH {EVENTS} SELECT user_id, resource_id, round(max(least(greatest(score / 100000, 0), 1)), 8) AS best, count(*) AS attempts FROM ev GROUP BY 1, 2")
def l23(spark, d):
    return L.best_scores(events(spark, d), ["user_id", "resource_id"], F.col("score"), F.lit(100000.0)).withColumn("best", F.round("best", 8))


@query("l24_attempt_summaries", f"WITH {EVENTS} SELECT user_id, count(*) FILTER (WHERE flag = 'R') AS exam_attempts, count(*) FILTER (WHERE flag = 'A') AS assignment_attempts, CAST(sum(duration) FILTER (WHERE flag = 'N') AS DOUBLE) AS video_time FROM ev GROUP BY 1")
def l24(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count_if(F.col("flag") == "R").alias("exam_attempts"), F.count_if(F.col("flag") == "A").alias("assignment_attempts"), F.sum(F.when(F.col("flag") == "N", F.col("duration"))).alias("video_time"))


@query("l25_no_scored_signal", f"WITH {EVENTS} SELECT s_suppkey AS course_id, count(resource_id) FILTER (WHERE flag = 'R' AND score > 90000) = 0 AS no_scored_signal FROM supplier LEFT JOIN ev ON course_id = s_suppkey GROUP BY 1")
def l25(spark, d):
    scored = events(spark, d).where("flag = 'R' and score > 90000").groupBy(F.col("course_id").alias("s_suppkey")).agg(F.count("*").alias("n"))
    out = read_table(spark, d, "supplier").join(scored, "s_suppkey", "left")
    return out.select(F.col("s_suppkey").alias("course_id"), (F.coalesce("n", F.lit(0)) == 0).alias("no_scored_signal"))


PERF = f"""{EVENTS}, base AS (SELECT user_id, course_id, count(*) AS n, avg(least(score / 100000, 1)) AS s, count(*) FILTER (WHERE flag = 'R') AS exams FROM ev GROUP BY 1, 2),
  perf AS (SELECT *, CASE WHEN n < 2 THEN 'too_few' WHEN exams = 0 THEN 'no_exam' END AS reason FROM base)"""


def performance(spark, d):
    x = events(spark, d).groupBy("user_id", "course_id").agg(F.count("*").alias("n"), F.avg(F.least(F.col("score") / 100000, F.lit(1.0))).alias("s"), F.count_if(F.col("flag") == "R").alias("exams"))
    from ..operators.cleaning import first_reason

    return x.withColumn("reason", first_reason([("too_few", F.col("n") < 2), ("no_exam", F.col("exams") == 0)]))


@query("l26_performance_label", f"WITH {PERF} SELECT reason, CASE WHEN reason IS NULL THEN CASE WHEN s >= 0.6 THEN 'E' WHEN s >= 0.4 THEN 'G' ELSE 'I/D' END END AS label, count(*) AS n FROM perf GROUP BY 1, 2")
def l26(spark, d):
    x = performance(spark, d).withColumn("label", F.when(F.col("reason").isNull(), L.band(F.col("s"), [("E", 0.6), ("G", 0.4)], "I/D")))
    return x.groupBy("reason", "label").agg(F.count("*").alias("n"))


@query("l27_sensitivity_label", f"WITH {PERF} SELECT CASE WHEN least(s, 0.5) >= 0.45 THEN 'E' WHEN least(s, 0.5) >= 0.3 THEN 'G' ELSE 'I/D' END AS label, count(*) AS n FROM perf WHERE reason IS NULL GROUP BY 1")
def l27(spark, d):
    x = performance(spark, d).where("reason is null")
    return x.groupBy(L.band(F.least(F.col("s"), F.lit(0.5)), [("E", 0.45), ("G", 0.3)], "I/D").alias("label")).agg(F.count("*").alias("n"))


@query("l28_label_invariants", f"""WITH {PROGRESS} SELECT 'range' AS "check", count(*) FILTER (WHERE a < 0 OR a > 1) AS violations FROM pr UNION ALL SELECT 'low_b', count(*) FILTER (WHERE b < 0.1) FROM pr""")
def l28(spark, d):
    return L.label_invariants(progress(spark, d), {"range": (F.col("a") < 0) | (F.col("a") > 1), "low_b": F.col("b") < 0.1})


@query("l29_label_times", "SELECT c_custkey AS user_id, CAST(coalesce(max(o_orderdate) FILTER (WHERE o_orderstatus = 'P'), max(o_orderdate), TIMESTAMP '2001-12-31') + INTERVAL 1 DAY AS DATE) AS label_time FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def l29(spark, d):
    from ..operators.schedule import resolve_assignments

    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "user_id")
    last = lambda x: x.groupBy("user_id").agg(F.to_date(F.max("o_orderdate")).alias("t"))
    rest = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2001-12-31").cast("date").alias("t"))
    out = resolve_assignments([("own", last(orders.where("o_orderstatus = 'P'"))), ("any", last(orders)), ("end", rest)], ["user_id"])
    return out.select("user_id", F.date_add("t", 1).alias("label_time"))
