"""Score-based labels with provenance, masks and exclusion reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import quantiles


def effective_score(observed: Column, correct: Column, full: Column) -> tuple[Column, Column]:
    """The score and where it came from: observed, rebuilt from correctness, or unresolved."""
    rebuilt = F.when(correct.isNotNull() & full.isNotNull(), correct.cast("double") * full)
    source = F.when(observed.isNotNull(), "observed").when(rebuilt.isNotNull(), "rebuilt").otherwise("unresolved")
    return F.coalesce(observed.cast("double"), rebuilt), source


def within_window(events: DataFrame, spine: DataFrame, keys: list[str], time: str, start: str, end_exclusive: str) -> DataFrame:
    """Events in [start, end): label windows are half open."""
    bounds = spine.select(*keys, F.col(start).alias("__s"), F.col(end_exclusive).alias("__e"))
    return events.join(bounds, keys).where((F.col(time) >= F.col("__s")) & (F.col(time) < F.col("__e"))).drop("__s", "__e")


def effective_weights(weights: dict[str, Column], available: dict[str, Column]) -> dict[str, Column]:
    """Configured weights of what exists, scaled to sum 1; equal weights of what exists where none is configured."""
    masks = {k: F.coalesce(a, F.lit(False)).cast("double") for k, a in available.items()}
    used = {k: F.coalesce(w, F.lit(0.0)) * masks[k] for k, w in weights.items()}
    total, count = reduce(lambda a, b: a + b, used.values()), reduce(lambda a, b: a + b, masks.values())
    return {k: F.when(total > 0, used[k] / total).otherwise(F.try_divide(masks[k], count)) for k in weights}


def bounded_ratio(part: Column, whole: Column) -> Column:
    """part / whole clamped to [0, 1]; null without a whole."""
    ratio = F.try_divide(part, whole)
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def minmax_in_group(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``<c>_scaled`` in [0, 1] by group; a constant group is 0 if its maximum is not positive, else 1."""
    limits = df.groupBy(key).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(limits, key)
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(f"{c}_scaled", F.when(hi == lo, (hi > 0).cast("double")).otherwise((F.col(c) - lo) / (hi - lo)))
    return out.drop(*(f"__{n}_{c}" for c in columns for n in ("lo", "hi")))


def masked_mean(columns: list[Column]) -> tuple[Column, Column]:
    """Mean of the columns that are not null, and the share that is not."""
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.try_divide(total, present), present / len(columns)


def weighted_mean(columns: list[Column], weights: list[Column]) -> Column:
    """Weighted mean of what is not null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in zip(columns, weights, strict=True)])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in zip(columns, weights, strict=True)])
    return F.try_divide(total, weight)


def weighted_geo_mean(columns: list[Column], weights: list[float], valid: Column) -> Column:
    """Weighted geometric mean of values in [0, 1]; null where not valid or any value is missing or outside."""
    inside = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0) for c in columns])
    product = reduce(lambda a, b: a * b, [F.pow(c, F.lit(w / sum(weights))) for c, w in zip(columns, weights, strict=True)])
    return F.when(F.coalesce(valid, F.lit(False)) & inside, product)


def band(score: Column, bounds: list[tuple[str, float]], lowest: str) -> Column:
    """The first band whose lower bound the score reaches; a null score has a null band, never the lowest."""
    out = F.lit(lowest)
    for name, least in sorted(bounds, key=lambda b: b[1]):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def failed_floors(floors: dict[str, tuple[Column, float]]) -> Column:
    """Names of the floors a row misses, comma-joined in order."""
    return F.concat_ws(",", *(F.when(c < least, F.lit(n)) for n, (c, least) in floors.items()))


def vector_proximity(columns: list[Column]) -> Column:
    """1 minus the scaled distance to the ideal (1, ..., 1); null where a part is missing."""
    square = reduce(lambda a, b: a + b, [F.pow(1 - c, F.lit(2.0)) for c in columns])
    return 1 - F.sqrt(square) / (len(columns) ** 0.5)


def hash_order_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Marks the first ``n`` rows in the order of SHA-256(seed:key): a distributed top-n, then a join."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    chosen = df.select(key, order.alias("__h")).orderBy("__h", key).limit(n).select(key, F.lit(True).alias("removed"))
    return df.join(chosen, key, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def crosstab(df: DataFrame, rows: list[str]) -> DataFrame:
    counts = df.groupBy(*rows).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each combination


def score_bins(df: DataFrame, score: Column, width: float) -> DataFrame:
    low = F.floor(F.least(score, F.lit(1.0) - width / 2) / width) * width
    counts = df.where(score.isNotNull()).groupBy(F.round(low, 6).alias("bin_low")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each bin


def metric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each metric as long rows."""
    one = df.agg(*(F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in columns))).alias("y"))
    long = long.select("y.metric", "y.x.*").join(quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).withColumnRenamed("feature", "metric"), "metric", "left")
    return long.select("metric", "n", "mean", "std", "low", *(F.get("quantiles", F.lit(i)).alias(f"p{p}") for i, p in enumerate((25, 50, 75))), "high")


def label_profile(df: DataFrame, key: str, label: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(label, values).count().fillna(0, values)


def chapter_path(text: Column) -> Column:
    """A dotted chapter as integers; null if any part is none."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))
    return F.when(~F.exists(parts, lambda p: p.isNull()), parts)


def exam_partition(catalog: DataFrame, key: str, path: str, has_exam: Column) -> DataFrame:
    """Items of a course's last chapter are its exam, where it has exams; arrays compare element by element."""
    last = catalog.groupBy(key).agg(F.max(path).alias("__last"))
    return catalog.join(last, key).withColumn("is_exam", F.coalesce(has_exam & (F.col(path) == F.col("__last")), F.lit(False))).drop("__last")


def best_scores(events: DataFrame, keys: list[str], score: Column, full: Column) -> DataFrame:
    return events.groupBy(*keys).agg(F.max(bounded_ratio(score, full)).alias("best"), F.count(F.lit(1)).alias("attempts"))


def label_invariants(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row a check with its number of violations; a null condition is no violation."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks))).alias("x")).select("x.*")


def require_invariants(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    bad = label_invariants(df, checks).where("violations > 0").collect()  # one row a check
    if bad:
        raise ValueError(f"label checks failed: {[(r.check, r.violations) for r in bad]}")
    return df
