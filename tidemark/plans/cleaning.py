"""Queries of sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..sources import tables as S
from .base import EVENTS, events
from .registry import query


@query("s1_json_scan", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def s1(spark, d):
    path = S.scratch_path(spark, "json")
    S.read_table(spark, d, "events").select("event_id", "user_id", "value", "ts").write.json(path)
    back = S.read_json_lines(spark, path, "event_id long, user_id long, value double, ts timestamp")
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s2_quoted_csv_scan", "SELECT doc_id, sha256(replace(text, chr(13), '')) AS text_hash FROM documents")
def s2(spark, d):
    path = S.scratch_path(spark, "csv")
    docs = S.read_table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    docs.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    return S.read_quoted_csv(spark, path, "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("s3_relation_scan", "SELECT CAST(l_suppkey AS VARCHAR) AS course, CAST(l_partkey AS VARCHAR) AS teacher FROM lineitem GROUP BY 1, 2")
def s3(spark, d):
    path = S.scratch_path(spark, "tsv")
    S.read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey").write.option("sep", "\t").csv(path)
    return S.read_relation(spark, path, "course", "teacher")


@query("s4_text_pairs_scan", "SELECT DISTINCT 'C_' || o_custkey AS course, 'Cm_' || o_orderkey AS comment FROM orders WHERE o_orderstatus <> 'P'")
def s4(spark, d):
    path = S.scratch_path(spark, "pairs")
    lead = F.when(F.col("o_orderstatus") == "P", "X_").otherwise("C_")
    S.read_table(spark, d, "orders").select(F.concat(F.lit("﻿"), lead, "o_custkey", F.lit("  Cm_"), "o_orderkey")).write.text(path)
    return S.read_text_pairs(spark, path, "course", "comment", "C_", "Cm_")


@query("s5_view_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'R'")
def s5(spark, d):
    return S.read_view(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], "l_shipdate >= timestamp'2000-01-01' and l_returnflag = 'R'")


@query("s6_table_sink", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def s6(spark, d):
    path = S.scratch_path(spark, "table")
    S.write_table(S.read_table(spark, d, "orders"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("s7_manifest_sink", "SELECT s_suppkey, s_name FROM supplier")
def s7(spark, d):
    path = S.scratch_path(spark, "manifest")
    S.write_manifest(S.read_table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return spark.read.text(path).select(F.from_json("value", "s_suppkey long, s_name string").alias("x")).select("x.*")


@query("s8_content_manifest")
def s8(spark, d):
    path = S.scratch_path(spark, "files")
    S.read_table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_custkey"))).write.text(path)
    return S.content_digest(S.content_manifest(spark, path))


@query(
    "s9_table_profile",
    """SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, CAST(0 AS BIGINT) AS n_null_keys,
    sha256('l_orderkey:bigint,l_linenumber:int') AS schema_sha256 FROM lineitem""",
)
def s9(spark, d):
    lines = S.read_table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return S.profile_table(lines, ["l_orderkey", "l_linenumber"])


@query(
    "s10_exclusion_union",
    """SELECT 'early' AS source, o_orderkey AS key, CAST(NULL AS DOUBLE) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'
    UNION ALL SELECT 'small', l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 2""",
)
def s10(spark, d):
    early = S.read_table(spark, d, "orders").where("o_orderdate < timestamp'1995-06-01'").select(F.col("o_orderkey").alias("key"))
    small = S.read_table(spark, d, "lineitem").where("l_quantity < 2").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("value"))
    return S.union_exclusions({"early": early, "small": small}).select("source", "key", "value")


@query("s11_partitioned_facts", "SELECT event_type, CAST(month(ts) AS INTEGER) AS month, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2")
def s11(spark, d):
    path = S.scratch_path(spark, "facts")
    facts = S.read_table(spark, d, "events").groupBy("event_type", F.month("ts").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    S.write_facts(facts, path, ["event_type", "month"])
    return spark.read.parquet(path).select("event_type", "month", "n", "mean_value")


@query("c1_enrollments", "SELECT DISTINCT o_custkey AS user_id, o_orderkey AS course_id, o_orderdate AS enroll_time, o_custkey || '::' || o_orderkey AS enrollment_id FROM orders")
def c1(spark, d):
    users = S.read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderdate"))).alias("x"))
    users = users.select("user_id", F.col("x.o_orderkey").alias("courses"), F.col("x.o_orderdate").alias("times"))
    rows = C.explode_parallel(users, ["user_id"], {"course_id": "courses", "enroll_time": "times"}).dropDuplicates()
    return rows.withColumn("enrollment_id", C.composite_key("user_id", "course_id"))


@query(
    "c2_course_resources",
    """SELECT DISTINCT l_suppkey AS course_id, p_partkey AS resource_id, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'video' WHEN p_type LIKE 'STANDARD%' THEN 'exercise' ELSE 'other' END AS kind
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def c2(spark, d):
    parts = C.typed_by_prefix(S.read_table(spark, d, "part"), "p_type", {"ECONOMY": "video", "STANDARD": "exercise"}, "kind", "other")
    lines = S.read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("course_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    return lines.join(parts, "p_partkey").select("course_id", F.col("p_partkey").alias("resource_id"), "kind")


@query(
    "c3_course_summary",
    """SELECT s_suppkey AS course_id, count(DISTINCT CASE WHEN p_type = 'ECONOMY' THEN p_partkey END) AS videos, count(DISTINCT CASE WHEN p_type = 'PROMO' THEN p_partkey END) AS exercises
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def c3(spark, d):
    lines = S.read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    res = lines.join(S.read_table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    per = res.groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("p_type") == "ECONOMY", F.col("p_partkey"))).alias("videos"), F.count_distinct(F.when(F.col("p_type") == "PROMO", F.col("p_partkey"))).alias("exercises"))
    out = S.read_table(spark, d, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select(F.col("s_suppkey").alias("course_id"), F.coalesce("videos", F.lit(0)).alias("videos"), F.coalesce("exercises", F.lit(0)).alias("exercises"))


@query(
    "c4_flatten_nested",
    """SELECT user_id, event_type, event_id, to_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT)) AT TIME ZONE 'UTC' - INTERVAL 8 HOUR AS utc_time FROM events""",
)
def c4(spark, d):
    raw = S.read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(F.struct("event_id", F.unix_timestamp("ts").alias("start"))).alias("segment"))
    raw = raw.groupBy("user_id").agg(F.collect_list(F.struct("event_type", "segment")).alias("seq"))
    flat = C.flatten_nested(raw, ["user_id"], "seq", "segment", {"event_type": "o.event_type", "event_id": "i.event_id", "start": "i.start"})
    return flat.select("user_id", "event_type", "event_id", C.wall_clock_to_utc(F.col("start"), "Asia/Shanghai").alias("utc_time"))


def video_rules():
    return [("nonpositive_speed", F.col("speed") <= 0.9), ("short_segment", F.col("duration") < 5), ("before_enrollment", F.col("event_time") < F.col("enroll_time"))]


VIDEO_SQL = "CASE WHEN speed <= 0.9 THEN 'nonpositive_speed' WHEN duration < 5 THEN 'short_segment' WHEN event_time < enroll_time THEN 'before_enrollment' END"


@query("c5_clean_video", f"WITH {EVENTS} SELECT user_id, count(*) AS n, CAST(sum(duration) AS DOUBLE) AS duration FROM ev WHERE {VIDEO_SQL} IS NULL GROUP BY 1")
def c5(spark, d):
    return C.cleaned(events(spark, d), video_rules()).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"))


@query("c6_video_exclusions", f"WITH {EVENTS} SELECT {VIDEO_SQL} AS reason, count(*) AS n FROM ev WHERE {VIDEO_SQL} IS NOT NULL GROUP BY 1")
def c6(spark, d):
    return C.excluded(events(spark, d), video_rules()).groupBy("reason").agg(F.count("*").alias("n"))


@query("c7_problem_catalog", "SELECT l_suppkey AS course_id, p_partkey AS problem_id, max(p_retailprice) AS full_score FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' GROUP BY 1, 2")
def c7(spark, d):
    problems = S.read_table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("problem_id"), F.col("p_retailprice").alias("full_score"))
    used = S.read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("course_id"), F.col("l_partkey").alias("problem_id")).distinct()
    return used.join(problems, "problem_id").select("course_id", "problem_id", "full_score")


def problem_rules():
    return [
        ("unknown_problem", F.col("p_type").isNull()), ("not_a_problem", F.col("p_type") != "PROMO"), ("before_enrollment", F.col("event_time") < F.col("enroll_time")),
        ("returned", F.col("flag") == "R"), ("open_line", F.col("status") == "O"),
    ]


PROBLEM_SQL = "CASE WHEN p_type IS NULL THEN 'unknown_problem' WHEN p_type <> 'PROMO' THEN 'not_a_problem' WHEN event_time < enroll_time THEN 'before_enrollment' WHEN flag = 'R' THEN 'returned' WHEN status = 'O' THEN 'open_line' END"


def _problems(spark, d):
    parts = S.read_table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), "p_type")
    return events(spark, d).join(parts, "resource_id", "left")


@query("c8_clean_problem", f"WITH {EVENTS} SELECT course_id, count(*) AS n, round(sum(score), 2) AS score FROM ev LEFT JOIN part ON p_partkey = resource_id WHERE {PROBLEM_SQL} IS NULL GROUP BY 1")
def c8(spark, d):
    return C.cleaned(_problems(spark, d), problem_rules()).groupBy("course_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


@query("c9_problem_exclusions", f"WITH {EVENTS} SELECT {PROBLEM_SQL} AS reason, count(*) AS n FROM ev LEFT JOIN part ON p_partkey = resource_id WHERE {PROBLEM_SQL} IS NOT NULL GROUP BY 1")
def c9(spark, d):
    return C.excluded(_problems(spark, d), problem_rules()).groupBy("reason").agg(F.count("*").alias("n"))


@query("c10_normalise_comments", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'U_' || conv_id ELSE 'U_' || role END AS user_id, trim(text) AS text, CAST(NULL AS DOUBLE) AS positive_score FROM conversations")
def c10(spark, d):
    x = S.read_table(spark, d, "conversations").withColumn("raw_id", F.when(F.col("role") == "user", F.concat(F.lit("U_"), "conv_id")).otherwise(F.col("role")))
    return x.select("conv_id", "turn", C.with_prefix("raw_id", "U_").alias("user_id"), F.trim("text").alias("text"), F.lit(None).cast("double").alias("positive_score"))


@query(
    "c11_map_comments",
    """SELECT o_orderkey, o_custkey, target, min(src) AS mapping_source FROM (SELECT o_orderkey, o_custkey, l_suppkey AS target, 'explicit' AS src FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    UNION ALL SELECT o_orderkey, o_custkey, c_nationkey, 'resource' FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2, 3""",
)
def c11(spark, d):
    comments = S.read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    explicit = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("long").alias("target")).distinct()
    fallback = S.read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("target"))
    return C.preferred_mapping(comments, explicit, fallback, "o_orderkey", "o_custkey", "target")


@query(
    "c12_split_comments",
    f"""WITH {EVENTS} SELECT CASE WHEN event_time < enroll_time THEN 'before_enrollment' ELSE 'kept' END AS part, count(*) AS n FROM ev GROUP BY 1
    UNION ALL SELECT 'unmapped', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def c12(spark, d):
    part = F.when(F.col("event_time") < F.col("enroll_time"), "before_enrollment").otherwise("kept").alias("part")
    mapped = events(spark, d).groupBy(part).agg(F.count("*").alias("n"))
    lines = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    lost = S.read_table(spark, d, "orders").join(lines, "o_orderkey", "left_anti")
    return mapped.unionByName(lost.agg(F.count("*").alias("n")).select(F.lit("unmapped").alias("part"), "n"))


@query(
    "c13_score_structure",
    """SELECT status, count(*) AS n, CAST(sum(surplus) AS BIGINT) AS surplus FROM (SELECT CASE WHEN l_quantity > 45 THEN 'invalid' WHEN l_linestatus = 'O' THEN 'inactive' ELSE 'valid' END AS status, count(*) - 1 AS surplus
    FROM lineitem GROUP BY l_suppkey, l_linestatus, l_returnflag, l_quantity) GROUP BY 1""",
)
def c13(spark, d):
    rows = C.split_exact_duplicates(S.read_table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", "l_returnflag", "l_quantity"))
    status = C.first_reason([("invalid", F.col("l_quantity") > 45), ("inactive", F.col("l_linestatus") == "O")])
    return rows.groupBy(F.coalesce(status, F.lit("valid")).alias("status")).agg(F.count("*").alias("n"), F.sum("surplus").alias("surplus"))


@query(
    "c14_component_pivot",
    """SELECT l_suppkey AS course_id, coalesce(sum(CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN l_quantity END), 0.0) AS video, coalesce(sum(CASE WHEN p_type = 'PROMO' THEN l_quantity END), 0.0) AS assignment,
    coalesce(sum(CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN l_quantity END), 0.0) AS comment FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def c14(spark, d):
    x = S.read_table(spark, d, "lineitem").join(S.read_table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumnRenamed("l_suppkey", "course_id")
    return C.component_pivot(x, "course_id", "p_type", "l_quantity", {"video": ["ECONOMY", "SMALL"], "assignment": ["PROMO"], "comment": ["LARGE", "MEDIUM"]})


@query("c15_teacher_summary", "SELECT role, count(*) AS n, 1.0 AS text_coverage, round(avg(length(trim(text))), 4) AS text_mean_length FROM conversations GROUP BY 1")
def c15(spark, d):
    out = C.text_profile(S.read_table(spark, d, "conversations"), "role", ["text"])
    return out.select("role", "n", "text_coverage", F.round("text_mean_length", 4).alias("text_mean_length"))


@query(
    "c16_school_summary",
    """SELECT s_nationkey AS key, count(*) AS n, avg(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END) AS motto_coverage FROM supplier GROUP BY 1""",
)
def c16(spark, d):
    x = S.read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("motto"))
    return C.text_profile(x, "key", ["motto"]).select("key", "n", "motto_coverage")


@query("c17_normalise_names", "SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, count(*) AS n FROM part GROUP BY 1")
def c17(spark, d):
    x = S.read_table(spark, d, "part").select(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t")).alias("raw"))
    return x.groupBy(C.normalize_name("raw").alias("name")).agg(F.count("*").alias("n"))


@query("c18_id_codes", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS code FROM customer")
def c18(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("X_"), "c_custkey")).otherwise(F.concat(F.lit("U_"), "c_custkey"))
    return S.read_table(spark, d, "customer").withColumn("id", raw).select("c_custkey", C.id_code("id", "U_").alias("code"))
