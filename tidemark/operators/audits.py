"""Audits of label leakage and populations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import average_ranks, quantiles, running_total


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rank correlation of each column with the target over rows where both are known."""
    out = None
    for c in columns:
        pairs = df.where(F.col(c).isNotNull() & F.col(target).isNotNull()).select(F.col(c).alias("x"), F.col(target).alias("y"))
        ranked = pairs.join(average_ranks(pairs, "x", "rx").select("x", "rx"), "x").join(average_ranks(pairs, "y", "ry").select("y", "ry"), "y")
        row = ranked.agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("feature"), "rho", "n")
        out = row if out is None else out.unionByName(row)
    return out


def rank_bins(df: DataFrame, id_col: str, column: str, bins: int, out: str) -> DataFrame:
    """id and bin of rows by rank (ties by id)."""
    x = df.where(F.col(column).isNotNull()).select(id_col, column, F.lit(1).alias("__one"))
    total = max(x.count(), 1)
    placed = running_total(x, [F.col(column), F.col(id_col)], "__one", "__rank")
    return placed.select(id_col, F.floor((F.col("__rank") - 1) * bins / total).cast("int").alias(out))


def mutual_information(table: DataFrame, a: str, b: str) -> DataFrame:
    """mi, ha, hb, nmi (by the mean entropy) of two discrete columns, from their contingency counts."""
    cells = table.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").over(Window.partitionBy())  # a row for each pair of values
    na, nb = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b))
    terms = cells.select(
        (F.col("n") / n * F.log(F.col("n") * n / (na * nb))).alias("mi"), (-F.col("n") / n * F.log(na / n)).alias("ha"), (-F.col("n") / n * F.log(nb / n)).alias("hb")
    )
    one = terms.agg(F.sum("mi").alias("mi"), F.sum("ha").alias("ha"), F.sum("hb").alias("hb"))
    return one.withColumn("nmi", F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(0.0)))


def column_roles(columns: list[tuple[str, str]], rules: list[tuple[str, str]], numeric: str = "feature", other: str = "context") -> list[tuple[str, str]]:
    """Role of each (name, type): the first rule whose pattern the name matches, else by type."""
    number = re.compile(r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    return [(n, next((r for r, p in rules if re.search(p, n)), numeric if number.match(t) else other)) for n, t in columns]


def proxy_gate(correlations: DataFrame, threshold: float, known: list[str], reviewed: list[str]) -> DataFrame:
    """Features whose correlation reaches the threshold, and whether someone has to look at them."""
    high = F.abs("rho") >= threshold
    return correlations.withColumn("status", F.when(F.col("feature").isin(known), "proxy").when(high & F.col("feature").isin(reviewed), "reviewed").when(high, "needs_review").otherwise("ok"))


def transition(df: DataFrame, before: Column, after: Column) -> DataFrame:
    counts = df.groupBy(before.alias("label_before"), after.alias("label_after")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("label_before")))


def compare_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids by side (left only, right only, both), with null and surplus ids of each side."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("b")).withColumnRenamed(key, "__k")
    both = a.join(b, F.col(key).eqNullSafe(F.col("__k")), "full")
    side = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"))


def reconcile(population: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Every id of the population with the first source that has it, else ``missing``; counts by category."""
    out = population.select(key).distinct()
    category = F.lit("missing")
    for name, frame in reversed(list(sources.items())):
        out = out.join(frame.select(key).distinct().withColumn(f"__{name}", F.lit(1)), key, "left")
        category = F.when(F.col(f"__{name}") == 1, F.lit(name)).otherwise(category)
    return out.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def ceiling(df: DataFrame, key: str, score: str, possible: float) -> DataFrame:
    """Best score by key against what is possible, with a decision."""
    best = df.groupBy(key).agg(F.max(score).alias("ceiling"), F.count(F.lit(1)).alias("n"))
    return best.withColumn("decision", F.when(F.col("ceiling") > possible, "overflow").when(F.col("ceiling") >= 0.9 * possible, "complete").otherwise("partial"))


def score_contract(df: DataFrame, flags: dict[str, Column], score: str) -> DataFrame:
    """Rows by the signature of what they have, with their share and score quantiles."""
    signature = F.concat_ws("+", *(F.when(c, F.lit(n)) for n, c in flags.items()))
    tagged = df.withColumn("signature", signature)
    steps = (0.5, 0.9, 0.99)
    out = tagged.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).join(quantiles(tagged, {"s": F.col(score)}, list(steps), ["signature"]), "signature", "left")
    out = out.withColumns({f"p{int(p * 100)}": F.get("quantiles", F.lit(i)) for i, p in enumerate(steps)}).drop("feature", "quantiles")
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each signature


def label_coverage(population: DataFrame, labelled: DataFrame, id_col: str, slice_col: str) -> DataFrame:
    x = population.select(id_col, slice_col).join(labelled.select(id_col).distinct().withColumn("__has", F.lit(1)), id_col, "left")
    return x.groupBy(slice_col).agg(F.count(F.lit(1)).alias("n"), F.count("__has").alias("labelled")).withColumn("coverage", F.try_divide("labelled", "n"))


def class_support(df: DataFrame, unit: str, label: str, dominance: float) -> DataFrame:
    """Per class: units that have it, the largest unit's share, and whether one unit dominates."""
    per = df.groupBy(label, unit).agg(F.count(F.lit(1)).alias("k"))
    out = per.groupBy(label).agg(F.count(F.lit(1)).alias("units"), F.sum("k").alias("n"), F.max("k").alias("most")).withColumn("top_share", F.col("most") / F.col("n"))
    return out.withColumn("dominated", F.col("top_share") > dominance).drop("most")


def grain_histogram(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How many keys have how many rows, and how many of those disagree on the label."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_per_key"), F.count_distinct(label).alias("labels"))
    return per.groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("labels") > 1).alias("conflicting"))
