"""Rows dealt by key to as many partitions as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a partition, on average.
PART_ROWS = 250_000
#: A key that holds this share of all rows or more may be hot; there can be a thousand such keys at most.
HOT_SHARE = 0.001


def dealt(df: DataFrame, keys: list[str], rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``df`` dealt by ``keys``, for groupings by them (or by more columns); the rows of hot keys, or None.

    The number of partitions grows with the number of rows, so that the memory of a task does not. A hot key fills a
    partition by itself and holds a thousandth of all rows: its rows come as they are, for groupings that Spark sums
    before the shuffle. Reads the keys of ``df`` up to three times before; no row is in both frames.
    """
    total = df.count()
    parts = max(-(-total // rows), df.sparkSession.sparkContext.defaultParallelism)
    name = F.xxhash64(*keys)
    least = max(rows, total * HOT_SHARE)
    hot = []
    if total >= least:
        likely = df.select(name.alias("h")).stat.freqItems(["h"], least / total).first()[0]  # all hot keys, and others
        counts = df.select(name.alias("h")).where(F.col("h").isin(likely)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        hot = [r.h for r in counts.where(F.col("n") >= least).collect()]  # a thousand rows at most
    if not hot:
        return df.repartition(parts, *keys), None
    return df.where(~name.isin(hot)).repartition(parts, *keys), df.where(name.isin(hot))
