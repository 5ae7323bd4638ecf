"""Assembly of fact tables: merges with gates, wide tables, coverage and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"several rows for a key of {keys}")
    return df


def merge_facts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one full join that keeps what only one side has."""
    a, b = require_unique(left, keys).withColumn("__a", F.lit(1)), require_unique(right, keys).withColumn("__b", F.lit(1))
    side = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both")
    return a.join(b, keys, "full").withColumn("coverage", side).drop("__a", "__b")


def wide_table(facts: DataFrame, keys: list[str], column: Column, values: list[str], metric: str) -> DataFrame:
    """One column for each given value; repeated cells are refused."""
    named = facts.withColumn("__cell", column)
    require_unique(named, [*keys, "__cell"])
    return named.groupBy(*keys).pivot("__cell", values).agg(F.first(metric))


def group_summary(facts: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *(F.avg(m).alias(m) for m in metrics))


def phase_trend(facts: DataFrame, keys: list[str], phase: str, metric: str, first: str, last: str) -> DataFrame:
    pick = lambda p: F.max(F.when(F.col(phase) == p, F.col(metric)))
    return facts.groupBy(*keys).agg(pick(first).alias("first"), pick(last).alias("last")).withColumn("trend", F.col("last") - F.col("first"))


def resource_summary(df: DataFrame, keys: list[str], amount: str, names: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(amount).alias("mean"), F.sum(amount).alias("total"), F.min(amount).alias("low"), F.max(amount).alias("high"), F.concat_ws("|", F.sort_array(F.collect_set(names))).alias("names"))


def grid_coverage(facts: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Cells of the full grid without a fact."""
    grid = facts.sparkSession.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return grid.drop("id").join(facts.select(*axes).distinct(), list(axes), "left_anti")


def combine_facts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return require_unique(a.unionByName(b, allowMissingColumns=True), keys)


def acceptance(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule: rows that pass, and whether all do. A null does not pass."""
    one = facts.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("passing"), F.col("__n").alias("n")) for n in rules))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("accepted", F.col("passing") == F.col("n"))


def assemble_sequences(long: DataFrame, keys: list[str], phase: str, features: list[str]) -> DataFrame:
    """Per key the phases in order, each with its vector and mask, and the observed length."""
    values = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    masks = F.array(*(F.col(f).isNotNull().cast("int") for f in features))
    out = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(phase).alias("phase"), values.alias("values"), masks.alias("mask")))).alias("steps"))
    return out.withColumn("observed_length", F.size(F.filter("steps", lambda s: F.exists(s["mask"], lambda m: m == 1))))


def channel_pca(df: DataFrame, vector: str, k: int):
    """Components (rows of weights, largest weight positive) and explained shares of an array column."""
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    x = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(x).transform(x)
    model = PCA(k=k, inputCol="x", outputCol="y").fit(scaled)
    parts = model.pc.toArray().T
    sign = np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])
    return parts * sign[:, None], model.explainedVariance.toArray()


def parent_delta(facts: DataFrame, run: str, parent: str, keys: list[str], metric: str) -> DataFrame:
    """Each run's metric minus its parent's in the same cell."""
    parents = facts.select(F.col(run).alias(parent), *keys, F.col(metric).alias("__p"))
    return facts.join(parents, [parent, *keys]).withColumn("delta", F.col(metric) - F.col("__p")).drop("__p")


def selection_facts(history: DataFrame, run: str, step: str, metric: str, margin: float) -> DataFrame:
    """Per run: best step, best and second metric, their margin, and steps within ``margin`` of the best."""
    ranked = history.groupBy(run).agg(F.max(F.struct(F.col(metric), -F.col(step))).alias("b"), F.sort_array(F.collect_list(metric), asc=False).alias("m"))
    best = ranked.select(run, (-F.col("b.col2")).alias("best_step"), F.col(f"b.{metric}").alias("best"), F.get("m", F.lit(1)).alias("second"), "m")
    return best.withColumn("margin", F.col("best") - F.col("second")).withColumn("within", F.size(F.filter("m", lambda v: v >= F.col("best") - margin)).cast("long")).drop("m")


def overlay_reference(facts: DataFrame, reference: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replaces a column by a unique reference value, keeping the refit and the difference."""
    ref = require_unique(reference, keys).select(*keys, F.col(column).alias("__r"))
    out = facts.join(ref, keys, "left").withColumn(f"{column}_refit", F.col(column)).withColumn(column, F.coalesce("__r", column))
    return out.withColumn(f"{column}_difference", F.col(column) - F.col(f"{column}_refit")).drop("__r")


def reconcile_totals(a: DataFrame, b: DataFrame, keys: list[str], total: str) -> DataFrame:
    right = b.select(*keys, F.col(total).alias("__b"))
    return a.select(*keys, F.col(total).alias("left_total")).join(right, keys, "full").withColumnRenamed("__b", "right_total").withColumn("equal", F.col("left_total").eqNullSafe(F.col("right_total")))


def uniformity(facts: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column that must have exactly one."""
    one = facts.agg(*(F.count_distinct(c).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_values")) for c in columns))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("uniform", F.col("distinct_values") == 1)
