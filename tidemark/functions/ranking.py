"""Totals over a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch_path


def running_total(df: DataFrame, order: list, value: str | list[str], out: str | list[str]) -> DataFrame:
    """Adds the total of ``value`` (one column or several) up to and including each row in a total order of rows.

    Rows are range-partitioned and sorted, written once so that the partitions stay as they are, summed inside each
    partition, and shifted by the totals of the earlier partitions (one row each).
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    totals = held.groupBy("__part").agg(*(F.sum(v).alias(f"__total{i}") for i, v in enumerate(values)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifted = totals.select("__part", *(F.coalesce(F.sum(f"__total{i}").over(before), F.lit(0)).alias(f"__before{i}") for i in range(len(values))))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = held.join(F.broadcast(shifted), "__part")  # one row a partition
    summed = {o: F.sum(v).over(inside) + F.col(f"__before{i}") for i, (v, o) in enumerate(zip(values, outs, strict=True))}
    return joined.withColumns(summed).drop("__part", *(f"__before{i}" for i in range(len(values))))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of ``column`` with their number and average rank (ties share one)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, [F.col(column)], "n", "upto").select(column, "n", (F.col("upto") - (F.col("n") - 1) / 2).alias(out))


def quantiles(df: DataFrame, columns: dict[str, Column], steps: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, feature, quantiles: exact quantiles, interpolated between neighbours, of each column's values that are not null.

    Ranks run over distinct values with their numbers, range-partitioned, so no task holds all values of a column. A
    feature without values has no row. ``columns``: name -> column. Keys are few, as the totals of each are broadcast.
    """
    own = [*(keys or []), "feature"]
    each = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("v")) for n, c in columns.items()))
    long = df.select(*(keys or []), F.explode(each).alias("x")).select(*(keys or []), "x.*").where("v is not null")
    counts = long.groupBy(*own, "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, [*map(F.col, own), F.col("v")], "n", "upto")
    totals = ranked.groupBy(*own).agg(F.sum("n").alias("size"), F.min(F.col("upto") - F.col("n")).alias("before"))
    x = ranked.join(F.broadcast(totals), own)  # a row for each feature of each key
    last = F.col("upto") - F.col("before") - 1
    first = last - F.col("n") + 1

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= last), F.col("v")))

    def step(q: float) -> Column:
        place = F.lit(q) * (F.col("size") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    return x.groupBy(*own).agg(F.array(*(step(q) for q in steps)).alias("quantiles"))


def top_by(df: DataFrame, keys: list[str], order: list, out: str | None = None) -> DataFrame:
    """The first row of each key in an order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")
