"""Session facts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Sessions of a (bounded or unbounded) event table: a pause of at least ``gap`` closes one; state of sessions older
    than the watermark ``late`` is dropped."""
    watched = events.withWatermark(time, late)
    return watched.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n"
    )


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what a source holds now, append finished rows to Parquet and read them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)
