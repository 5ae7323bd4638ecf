"""Queries over event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table, scratch_path
from ..streaming.sessions import run_available, stream_sessions
from .registry import query


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l), e AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM e WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
)
def sessions(spark, d):
    """Finished sessions: those the watermark has passed when the source is read to its end."""
    events = read_table(spark, d, "events")
    source = scratch_path(spark, "stream-source")
    events.select("event_id", "user_id", "ts").write.parquet(source)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(source)
    out = run_available(spark, stream_sessions(stream, ["user_id"], "ts", "30 minutes", "1 hour"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
