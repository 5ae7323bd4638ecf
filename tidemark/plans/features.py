"""Queries of point-in-time features. The flagship, ``phase_activity``, runs from scan to wide view and band counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.labels import band
from ..sources.tables import read_table, scratch_path
from .base import EVENTS, events
from .registry import query

PHASE_SQL = "(VALUES ('P1', 0.25), ('P2', 0.5), ('P3', 0.75), ('P4', 0.9)) AS ph(phase, ratio)"
#: Users' windows over the event stream, and the cutoffs of each phase.
SPINE = f"""win AS (SELECT user_id, min(ts) AS enroll_time, max(ts) + INTERVAL 1 DAY AS window_end FROM events GROUP BY 1),
  spine AS (SELECT user_id, phase, enroll_time, window_end, make_timestamp(CAST(floor(floor(epoch(enroll_time)) + (floor(epoch(window_end)) - floor(epoch(enroll_time))) * ratio) AS BIGINT) * 1000000) AS cutoff_time FROM win, {PHASE_SQL}),
  seen AS (SELECT e.*, s.phase, s.cutoff_time, s.enroll_time FROM events e JOIN spine s ON s.user_id = e.user_id AND e.ts >= s.enroll_time AND e.ts <= s.cutoff_time)"""


def spine(spark, d):
    windows = read_table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("enroll_time"), (F.max("ts") + F.expr("interval 1 day")).alias("window_end"))
    return X.phase_cutoffs(windows, "enroll_time", "window_end")


def seen(spark, d):
    s = spine(spark, d)
    out = X.until_cutoff(read_table(spark, d, "events"), s, ["user_id"], "ts", "enroll_time")
    return out.join(s.select("user_id", "enroll_time").distinct(), "user_id")


KEYS = ["user_id", "phase"]


@query("f1_phase_cutoffs", f"WITH {SPINE} SELECT user_id, phase, cutoff_time FROM spine")
def f1(spark, d):
    return spine(spark, d).select("user_id", "phase", "cutoff_time")


@query("f2_events_until_cutoff", f"WITH {SPINE} SELECT user_id, phase, count(*) AS n, round(sum(value), 2) AS total FROM seen GROUP BY 1, 2")
def f2(spark, d):
    return seen(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "f3_activity_features",
    f"""WITH {EVENTS} SELECT user_id, count(*) AS event_count, count(DISTINCT resource_id) AS unique_items, count(DISTINCT event_time) AS active_days, round(stddev(duration), 4) AS duration_std,
    round(stddev(date_diff('day', enroll_time, event_time)), 4) AS day_offset_std, round(avg(duration / speed), 4) AS mean_real_time, round(coalesce(variance(speed), 0), 10) AS speed_variance,
    round((count(*) - count(DISTINCT resource_id)) / count(*), 6) AS repeat_ratio, round(avg(dayofweek(event_time) + 1), 4) AS mean_weekday FROM ev GROUP BY 1""",
)
def f3(spark, d):
    path = scratch_path(spark, "activity")  # counted, searched for hot users, then grouped
    events(spark, d).select("user_id", "event_time", "enroll_time", "resource_id", "duration", "speed").write.parquet(path)
    out = X.activity_features(spark.read.parquet(path), ["user_id"], "event_time", "enroll_time", "resource_id", "duration", X.playback("duration", "speed"))
    r = lambda c, n=4: F.round(c, n).alias(c)
    return out.select("user_id", "event_count", "unique_items", "active_days", r("duration_std"), r("day_offset_std"), r("mean_real_time"), r("speed_variance", 10), r("repeat_ratio", 6), r("mean_weekday"))


@query(
    "f4_mode_by",
    f"""WITH {SPINE} SELECT user_id, phase, CAST(h AS INTEGER) AS common_hour FROM (SELECT user_id, phase, hour(ts) AS h, row_number() OVER (PARTITION BY user_id, phase ORDER BY count(*) DESC, hour(ts)) AS r FROM seen GROUP BY 1, 2, 3) WHERE r = 1""",
)
def f4(spark, d):
    return X.mode_by(seen(spark, d), KEYS, F.hour("ts"), "common_hour")


SESSION = f"""{SPINE}, lagged AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 1800 THEN 1 ELSE 0 END AS fresh FROM seen WINDOW w AS (PARTITION BY user_id, phase ORDER BY ts, event_id)),
  ses AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, phase ORDER BY ts, event_id) AS session_id FROM lagged),
  each_s AS (SELECT user_id, phase, session_id, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS s FROM ses GROUP BY 1, 2, 3)"""


@query("f5_sessions", f"WITH {SESSION} SELECT user_id, phase, count(*) AS sessions, round(coalesce(stddev(s), 0), 4) AS session_seconds_std FROM each_s GROUP BY 1, 2")
def f5(spark, d):
    out = X.session_spread(X.sessionize(seen(spark, d), KEYS, "ts", "event_id", 1800), KEYS, "ts")
    return out.withColumn("session_seconds_std", F.round("session_seconds_std", 4))


@query(
    "f6_score_features",
    f"""WITH {EVENTS} SELECT user_id, round(sum(score), 2) AS score_sum, round(avg(score / p_retailprice), 6) AS score_fraction_mean, CAST(count(*) FILTER (WHERE flag = 'R') AS DOUBLE) AS correct_count,
    round(avg(CASE WHEN flag = 'R' THEN 1.0 ELSE 0 END), 6) AS correct_ratio, CAST(sum(line) AS DOUBLE) AS attempts_sum FROM ev JOIN part ON p_partkey = resource_id GROUP BY 1""",
)
def f6(spark, d):
    x = events(spark, d).join(read_table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), "p_retailprice"), "resource_id")
    out = X.score_features(x, ["user_id"], "score", "p_retailprice", F.col("flag") == "R", F.col("line"))
    return out.select("user_id", F.round("score_sum", 2).alias("score_sum"), F.round("score_fraction_mean", 6).alias("score_fraction_mean"), "correct_count", F.round("correct_ratio", 6).alias("correct_ratio"), "attempts_sum")


@query(
    "f7_text_features",
    """SELECT conv_id, count(*) AS n, round(avg(length(trim(text))), 4) AS length_mean, round(stddev(length(trim(text))), 4) AS length_std, count(*) FILTER (WHERE role = 'user') AS user_count, round(avg(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0 END), 6) AS assistant_ratio
    FROM conversations GROUP BY 1""",
)
def f7(spark, d):
    out = X.text_features(read_table(spark, d, "conversations"), ["conv_id"], "text", F.col("role"), ["user", "assistant"])
    return out.select("conv_id", "n", F.round("length_mean", 4).alias("length_mean"), F.round("length_std", 4).alias("length_std"), "user_count", F.round("assistant_ratio", 6).alias("assistant_ratio"))


@query("f8_catalog_totals", "SELECT p_brand, count(DISTINCT p_partkey) AS items, round(sum(p_retailprice), 2) AS full_total FROM part GROUP BY 1")
def f8(spark, d):
    return X.catalog_totals(read_table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice").withColumn("full_total", F.round("full_total", 2))


@query(
    "f9_merged_features",
    f"""WITH {SPINE} SELECT s.user_id, s.phase, count(c.event_id) FILTER (WHERE c.event_type = 'click') AS n0, nullif(count(c.event_id) FILTER (WHERE c.event_type = 'purchase'), 0) AS purchases,
    CAST(count(c.event_id) FILTER (WHERE c.event_type = 'purchase') > 0 AS INTEGER) AS purchase_observed_mask FROM spine s LEFT JOIN seen c ON c.user_id = s.user_id AND c.phase = s.phase GROUP BY 1, 2""",
)
def f9(spark, d):
    x = seen(spark, d)
    count = lambda kind, name: x.where(F.col("event_type") == kind).groupBy(*KEYS).agg(F.count("*").alias(name))
    out = X.merge_features(spine(spark, d), {"click": count("click", "clicks"), "purchase": count("purchase", "purchases")}, KEYS, {"click": "clicks", "purchase": "purchases"})
    return out.select(*KEYS, F.coalesce("clicks", F.lit(0)).alias("n0"), "purchases", "purchase_observed_mask")


@query(
    "f10_scenario_windows",
    """SELECT scenario, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT 'timeline' AS scenario, o_custkey AS user_id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'hybrid', o_custkey FROM orders WHERE o_orderstatus IN ('P', 'F')) GROUP BY 1""",
)
def f10(spark, d):
    x = read_table(spark, d, "orders").withColumn("scenario", F.explode(F.when(F.col("o_orderstatus") == "P", F.array(F.lit("timeline"), F.lit("hybrid"))).when(F.col("o_orderstatus") == "F", F.array(F.lit("hybrid")))))
    return x.groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("users"))


@query(
    "f11_window_exclusions",
    """WITH w AS (SELECT l_suppkey AS id, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INTEGER) - 10) AS e FROM lineitem) SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT 'invalid_window' AS reason, count(*) AS n FROM w WHERE NOT e > s UNION ALL SELECT 'exact_duplicate', sum(c - 1) FROM (SELECT count(*) AS c FROM w GROUP BY id, s, e) WHERE c > 1) GROUP BY 1""",
)
def f11(spark, d):
    w = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int") - 10)).alias("e"))
    return X.window_exclusions(w, ["id"], "s", "e").groupBy("reason").agg(F.sum("n").alias("n"))


@query(
    "f12_phase_audit",
    f"""WITH {SPINE}, n AS (SELECT s.user_id, s.phase, count(c.event_id) AS k FROM spine s LEFT JOIN seen c ON c.user_id = s.user_id AND c.phase = s.phase AND c.event_type = 'signup' GROUP BY 1, 2)
    SELECT phase, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE k = 0) AS empty_users, round(avg(k), 4) AS mean_events FROM n GROUP BY 1""",
)
def f12(spark, d):
    per = seen(spark, d).where("event_type = 'signup'").groupBy(*KEYS).agg(F.count("*").alias("k"))
    n = spine(spark, d).join(per, KEYS, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return n.groupBy("phase").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("k") == 0).alias("empty_users"), F.round(F.avg("k"), 4).alias("mean_events"))


@query("f13_conformance", """SELECT 'phase_cardinality' AS "check", CAST(0 AS BIGINT) AS violations, true AS passed UNION ALL SELECT 'cutoff_in_window', 0, true""")
def f13(spark, d):
    s = spine(spark, d).withColumn("enroll_time", F.date_trunc("second", "enroll_time"))
    return X.conformance(s, ["user_id"], "enroll_time", "window_end", 4)


@query(
    "f15_widen_phases",
    f"WITH {SPINE}, n AS (SELECT user_id, phase, count(*) AS k FROM seen GROUP BY 1, 2) SELECT user_id, " + ", ".join(f"max(k) FILTER (WHERE phase = '{p}') AS n_{p}" for p in X.PHASES) + " FROM n GROUP BY 1",
)
def f15(spark, d):
    long = seen(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return X.widen_phases(long, ["user_id"], ["n"], list(X.PHASES))


@query(
    "f16_grain_audit",
    """WITH g AS (SELECT l_orderkey, l_linenumber, sum(c) AS r, count(*) AS u FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT CAST(sum(r) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(r - u) AS BIGINT) AS exact_copies, count(*) FILTER (WHERE u > 1) AS conflicting_keys FROM g""",
)
def f16(spark, d):
    return X.grain_audit(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("f17_cyclic_hours", "SELECT CAST(hour(ts) AS INTEGER) AS hour, round(any_value(sin(hour(ts) * 2 * pi() / 24)), 6) AS hour_sin, round(any_value(cos(hour(ts) * 2 * pi() / 24)), 6) AS hour_cos, count(*) AS n FROM events GROUP BY 1")
def f17(spark, d):
    s, c = X.cyclic(F.col("hour"), 24)
    return read_table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).select("hour", F.round(s, 6).alias("hour_sin"), F.round(c, 6).alias("hour_cos"), "n")


RATIO = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "final": 1.0}


@query(
    "f18_prefix_components",
    "WITH w AS (SELECT user_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY 1), x AS (SELECT user_id, value, (floor(epoch(ts)) - floor(epoch(s))) / (floor(epoch(e)) - floor(epoch(s))) AS f FROM events JOIN w USING (user_id)) SELECT user_id, "
    + ", ".join(f"round(sum(CASE WHEN f <= {r} THEN value ELSE 0 END) / sum(value), 6) AS {n}" for n, r in RATIO.items())
    + " FROM x GROUP BY 1",
)
def f18(spark, d):
    ev = read_table(spark, d, "events")
    w = ev.groupBy("user_id").agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    out = X.prefix_components(ev.join(w, "user_id"), ["user_id"], "ts", "s", "e", "value", RATIO)
    return out.select("user_id", *(F.round(n, 6).alias(n) for n in RATIO))


@query(
    "phase_activity",
    f"""WITH {SESSION}, f AS (SELECT user_id, phase, count(*) AS n, sum(value) AS total FROM seen GROUP BY 1, 2), k AS (SELECT user_id, phase, count(*) AS sessions FROM each_s GROUP BY 1, 2),
    b AS (SELECT phase, CASE WHEN n IS NULL THEN NULL WHEN n / sessions >= 1.05 THEN 'dense' WHEN n / sessions >= 1.0 THEN 'even' ELSE 'thin' END AS band, total FROM f JOIN k USING (user_id, phase))
    SELECT phase, band, count(*) AS users, round(sum(total), 2) AS total FROM b GROUP BY 1, 2""",
)
def phase_activity(spark, d):
    """Validity filter, cutoffs, as-of events, sessions, aggregates, band, counts."""
    x = seen(spark, d).where("value is not null")
    per = x.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    sessions = X.session_spread(X.sessionize(x, KEYS, "ts", "event_id", 1800), KEYS, "ts").select(*KEYS, "sessions")
    out = per.join(sessions, KEYS).withColumn("band", band(F.col("n") / F.col("sessions"), [("dense", 1.05), ("even", 1.0)], "thin"))
    return out.groupBy("phase", "band").agg(F.count("*").alias("users"), F.round(F.sum("total"), 2).alias("total"))
