"""Oversampling between visible neighbours, with candidates that inspectors accept, in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours as N
from .balance import drawn_parents, hash_unit, materialize, numbered
from .neighbours import held

LEAST_ANGLE = -1e-6


def visible(near: DataFrame, df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, neighbour, distance, rank, fallback: the nearest rows (as of ``k_nearest``) that no other of them hides.

    A neighbour y of x is visible if every other neighbour z sees x and y at an angle of at most 90 degrees:
    (x - z) . (y - z) >= -1e-6. A row all of whose neighbours are hidden keeps the nearest (``fallback``). The neighbours
    of a row, k at most, meet in one row of a table.
    """
    v = df.select(F.col(id_col).cast("long").alias("neighbour"), F.col(vector).cast("array<double>").alias("p"))
    one = F.struct("rank", "neighbour", "distance", "p")
    lists = near.join(v, "neighbour").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("near"))
    own = lists.join(v.withColumnsRenamed({"neighbour": "id", "p": "x"}), "id").select("id", "x", "near.rank", "near.neighbour", "near.distance", "near.p")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            for x, points in zip(b["x"], b["p"], strict=True):
                y = np.array(points.tolist(), dtype=float)
                to_x = np.array(x, dtype=float) - y
                angle = np.einsum("zd,yzd->yz", to_x, y[:, None, :] - y[None, :, :])
                kept.append((angle >= LEAST_ANGLE).all(axis=1))
            out = []
            for own_id, rank, ids, d, see in zip(b["id"], b["rank"], b["neighbour"], b["distance"], kept, strict=True):
                chosen = np.flatnonzero(see) if see.any() else [0]
                out += [(own_id, int(ids[i]), float(d[i]), int(rank[i]), not see.any()) for i in chosen]
            yield pd.DataFrame(out, columns=["id", "neighbour", "distance", "rank", "fallback"])

    return own.mapInPandas(seen, "id long, neighbour long, distance double, rank int, fallback boolean")


def inspectors(df: DataFrame, label: str, value, vector: str, id_col: str, most: int, trees: int, seed: int) -> list:
    """Forests that tell one class from the others: each learns all its rows and an own draw of about as many others.

    As many as it takes to draw all other rows once, ``most`` at most. Draws are by digest; a forest's own bags are
    drawn by ``pyspark.ml`` partition by partition, so votes can differ between layouts of the same rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = df.select(F.col(id_col).alias("__id"), (F.col(label) == F.lit(value)).cast("double").alias("own"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).where("own is not null")
    sizes = {r.own: r.n for r in x.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    own, others = sizes.get(1.0, 0), sizes.get(0.0, 0)
    share = own / others if others else 0.0
    forest = lambda i: RandomForestClassifier(labelCol="own", numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=10, seed=seed + i)
    drawn = lambda i: x.where((F.col("own") == 1) | (hash_unit(F.lit(seed + i), F.col("__id")) < share))
    return [forest(i).fit(drawn(i)) for i in range(min(-(-others // own), most))] if own and others else []


def votes_against(candidates: DataFrame, models: list, vector: str) -> DataFrame:
    """Adds ``against``: the share of inspectors that take the row for another class; 0 without inspectors."""
    from pyspark.ml.functions import array_to_vector

    x = candidates.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("__no", F.lit(0.0))
    for m in models:
        x = m.transform(x).withColumn("__no", F.col("__no") + 1 - F.col("prediction")).drop("rawPrediction", "probability", "prediction")
    return x.withColumn("against", F.col("__no") / max(len(models), 1)).drop("features", "__no")


def inspected_rows(
    df: DataFrame, quotas: DataFrame, label: str, id_col: str, vector: str, seed: int, k: int = 16, most_inspectors: int = 4, trees: int = 16, threshold: float = 0.5, least_batch: int = 4096, most_rounds: int = 32
) -> tuple[DataFrame, DataFrame]:
    """Accepted synthetic rows (label, nth, a, b, ratio, synthetic_id, vector, against), and facts, a row a class with a quota.

    A class's candidates interpolate between a drawn row and one of its visible neighbours and stay if at most
    ``threshold`` of the inspectors vote against them. A round makes twice what is lacking, ``least_batch`` at least; rounds
    go on until the quota is met, ``most_rounds`` at most; the first ones accepted, in order of draw, fill the quota. Facts:
    inspectors wanted and fitted, rounds, candidates generated and accepted, the share accepted, and whether the quota is
    met. A class of one row makes nothing.
    """
    spark, rows, facts = df.sparkSession, [], []
    for need in quotas.where("quota > 0").collect():  # a row a class
        value, quota = need[label], int(need["quota"])
        own = held(df.where(F.col(label) == F.lit(value)).select(label, id_col, vector), "class")
        n = own.count()
        near = N.k_nearest(N.cells(own, id_col, vector, label), k)
        seen = visible(near, own, id_col, vector).groupBy(F.col("id").alias("a")).agg(F.array_sort(F.collect_list("neighbour")).alias("__near"))  # k at most
        seen = held(seen, "visible")
        models = inspectors(df, label, value, vector, id_col, most_inspectors, trees, seed) if n > 1 else []
        generated, accepted, rounds, parts = 0, 0, 0, []
        while n > 1 and accepted < quota and rounds < most_rounds:
            batch = max(2 * (quota - accepted), least_batch)
            asked = spark.createDataFrame([(value, batch)], quotas.select(label, F.col("quota").cast("long")).schema)
            draws = drawn_parents(own, asked, label, id_col, seed, generated).join(seen, "a")
            b = F.get("__near", F.floor(hash_unit(F.lit(seed + 1), F.col("nth"), F.col(label)) * F.size("__near")).cast("int"))
            made = materialize(draws.withColumn("b", b).drop("__near"), own, id_col, vector, [label], seed)
            passed = held(votes_against(made, models, vector).where(F.col("against") <= threshold), "accepted")
            ranked = numbered(passed, [label], "nth").where(F.col("__i") < quota - accepted).drop("__i", "__n")
            parts.append(held(ranked, "round"))
            rounds, generated, accepted = rounds + 1, generated + batch, accepted + parts[-1].count()
        rows += parts
        others = df.where(F.col(label) != F.lit(value)).count()
        facts.append((value, quota, -(-others // n), len(models), rounds, generated, accepted, accepted / generated if generated else 0.0, accepted == quota))
    label_type = dict(quotas.dtypes)[label]
    schema = f"`{label}` {label_type}, quota long, inspectors_wanted long, inspectors int, rounds int, generated long, accepted long, acceptance double, met boolean"
    if not rows:
        none = held(df.where(F.lit(False)).select(label, id_col, vector), "class")
        pairs = none.select(label, *(F.col(id_col).alias(c) for c in "ab"), F.lit(0).cast("long").alias("nth"), F.lit(0.0).alias("ratio"))
        rows.append(materialize(pairs, none, id_col, vector, [label], seed).withColumn("against", F.lit(0.0)))
    return reduce(lambda a, b: a.unionByName(b), rows), spark.createDataFrame(facts, schema)
