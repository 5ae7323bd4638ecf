"""Class balancing of training rows by interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import running_total
from . import neighbours as N
from .neighbours import held as keep


def sampling_targets(df: DataFrame, label: str, share: int = 10, most: int = 10) -> DataFrame:
    """Target of each class: at least 1/share of the largest class, at most ``most`` times its own size (``cap_bound``: that limit holds it back)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    largest = F.max("n").over(Window.partitionBy())  # a row for each class
    return counts.withColumn("target", F.least(F.greatest(F.col("n"), F.ceil(largest / share)), F.col("n") * most)).withColumn("synthetic", F.col("target") - F.col("n")).withColumn(
        "cap_bound", F.ceil(largest / share) > F.col("n") * most
    )


def largest_remainder(df: DataFrame, group: list[str], unit: str, weight: str, total: str) -> DataFrame:
    """Integer quotas that add up to ``total`` in each group, in proportion to weights."""
    own = Window.partitionBy(*group)
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(own)
    x = df.withColumn("__e", exact).withColumn("quota", F.floor("__e"))
    left = (F.max(total).over(own) - F.sum("quota").over(own)).cast("long")
    rank = F.row_number().over(own.orderBy(F.desc(F.col("__e") - F.floor("__e")), unit))
    return x.withColumn("__left", left).withColumn("__r", rank).withColumn("quota", F.col("quota") + (F.col("__r") <= F.col("__left")).cast("int")).drop("__e", "__left", "__r")


def numbered(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows numbered from 0 in each key, with the key's size; keys are few, and no task holds all rows of one."""
    placed = running_total(df.withColumn("__one", F.lit(1).cast("long")), [*map(F.col, keys), F.col(id_col)], "__one", "__upto")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__upto").alias("__first"))
    return placed.join(F.broadcast(sizes), keys).withColumn("__i", F.col("__upto") - F.col("__first")).drop("__one", "__upto", "__first")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts: the same on every engine that has the digest."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def interpolated_pairs(members: DataFrame, quotas: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """Parent pairs by hash draw inside each key: as many as its quota (key..., quota). Columns: keys, nth, a, b, ratio."""
    m = numbered(members.select(*keys, id_col), keys, id_col)
    draws = quotas.where("quota > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota").cast("long"))))
    sizes = m.groupBy(*keys).agg(F.max("__n").alias("__n")).where("__n > 1")
    draws = draws.join(sizes, keys).select(*keys, "nth", "__n", F.floor(hash_unit(F.col("nth"), *map(F.col, keys), F.lit(seed)) * F.col("__n")).alias("ia"))
    step = F.floor(hash_unit(F.lit(seed + 1), F.col("nth"), *map(F.col, keys)) * (F.col("__n") - 1)) + 1
    draws = draws.withColumn("ib", F.pmod(F.col("ia") + step, F.col("__n"))).withColumn("ratio", hash_unit(F.lit(seed + 2), F.col("nth"), *map(F.col, keys)))
    place = lambda i, name: m.select(*keys, F.col("__i").alias(i), F.col(id_col).alias(name))
    return draws.join(place("ia", "a"), [*keys, "ia"]).join(place("ib", "b"), [*keys, "ib"]).select(*keys, "nth", "a", "b", "ratio")


def drawn_parents(members: DataFrame, quotas: DataFrame, label: str, id_col: str, seed: int, first: int = 0) -> DataFrame:
    """Draws of a first parent, as many as each class's quota: label, nth (after ``first``), a, ratio. Classes of one row give none."""
    rows = numbered(members.select(label, F.col(id_col).alias("a")), [label], "a")
    draws = quotas.where("quota > 0").withColumn("nth", F.explode(F.sequence(F.lit(first + 1).cast("long"), (F.lit(first) + F.col("quota")).cast("long"))))
    sizes = rows.groupBy(label).agg(F.max("__n").alias("__n")).where("__n > 1")
    place = F.floor(hash_unit(F.lit(seed), F.col("nth"), F.col(label)) * F.col("__n")).alias("__i")
    ratio = hash_unit(F.lit(seed + 2), F.col("nth"), F.col(label)).alias("ratio")
    return draws.join(F.broadcast(sizes), label).select(label, "nth", place, ratio).join(rows.drop("__n"), [label, "__i"]).drop("__i")


def radius_pairs(members: DataFrame, quotas: DataFrame, label: str, id_col: str, vector: str, radius: float, seed: int) -> DataFrame:
    """Parent pairs as many as each class's quota: a by hash draw, b one of all its neighbours within the radius, each equally
    likely, or the nearest row where there is none (``fallback``). Columns: label, nth, a, b, ratio, fallback."""
    draws = keep(drawn_parents(members, quotas, label, id_col, seed), "parents")
    index = N.cells(members.join(F.broadcast(quotas.where("quota > 0").select(label)), label), id_col, vector, label)  # a row a class
    found = N.radius_draws(index, draws.select(F.col("a").alias("id"), "nth"), radius, seed).withColumnsRenamed({"id": "a", "neighbour": "b"})
    return keep(draws.join(found, ["a", "nth"]).select(label, "nth", "a", "b", "ratio", "fallback"), "pairs")


def clusters(df: DataFrame, vector: str, label: str, value, k: int, seed: int) -> DataFrame:
    """Rows of one class with their k-means cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.where(F.col(label) == value).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, maxIter=10).fit(x).transform(x).withColumnRenamed("prediction", "cluster").drop("features")


def materialize(
    pairs: DataFrame, source: DataFrame, id_col: str, vector: str, inherited: list[str], seed: int, available: tuple[str, ...] = (), missing: tuple[str, ...] = ()
) -> DataFrame:
    """Synthetic rows: interpolated vectors, categories of the first parent, a hashed id, and the columns of the pairs.

    Masks are never interpolated: a modality is available if it is for both parents, a value is missing if it is for one.
    """
    masks = [*available, *missing]
    a = source.select(F.col(id_col).alias("a"), F.col(vector).alias("__a"), *inherited, *(F.col(m).alias(f"__a_{m}") for m in masks))
    b = source.select(F.col(id_col).alias("b"), F.col(vector).alias("__b"), *(F.col(m).alias(f"__b_{m}") for m in masks))
    x = pairs.drop(*inherited).join(a, "a").join(b, "b")
    both = [F.least(F.col(f"__a_{m}"), F.col(f"__b_{m}")).alias(m) for m in available]
    both += [F.greatest(F.col(f"__a_{m}"), F.col(f"__b_{m}")).alias(m) for m in missing]
    mixed = F.zip_with("__a", "__b", lambda p, q: p + (q - p) * F.col("ratio"))
    name = F.sha2(F.concat_ws("|", F.lit(str(seed)), "a", "b", "nth"), 256)
    return x.select(name.alias("synthetic_id"), *(c for c in pairs.columns if c not in inherited), *inherited, *both, mixed.alias(vector))


def interpolated_columns(columns: list[tuple[str, str]], phase: int, phases: int, fixed: set[str]) -> list[str]:
    """Columns of (name, type) that may be interpolated at a phase: numeric ones, static or of phases up to it; never ``fixed`` ones or masks."""
    masks = ("missing__", "phase_available_", "context__")
    later = tuple(f"_P{k}" for k in range(phase + 1, phases + 1))
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    return [n for n, t in columns if t.startswith(numeric) and n not in fixed and not n.startswith(masks) and "_observed_mask_" not in n and not n.endswith(later)]


def sampling_summary(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Per class: rows before and after, expansion, whether the target was met or bound by the cap, and the share of rows
    that fell back to the nearest neighbour (``fallback`` of ``after``, where it has one), flagged above one half."""
    fallback = F.avg(F.col("fallback").cast("int")) if "fallback" in after.columns else F.lit(0.0)
    grown = after.groupBy(label).agg(F.count(F.lit(1)).alias("added"), fallback.alias("fallback_rate"))
    x = sampling_targets(before, label).join(grown, label, "left").withColumn("added", F.coalesce("added", F.lit(0).cast("long"))).withColumn("fallback_rate", F.coalesce("fallback_rate", F.lit(0.0)))
    x = x.withColumn("radius_warning", F.col("fallback_rate") > 0.5)
    return x.withColumn("target_met", F.col("added") == F.col("synthetic")).withColumn("expansion", (F.col("n") + F.col("added")) / F.col("n"))
