"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, spill


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (a long, b long).

    Each round joins every node to the smallest of its neighbourhood, first for its larger neighbours, then for its
    smaller ones; partial minima fold hot nodes, and nodes with a great share of the links are joined by broadcast. Each step
    is written to the shared folder, so no lineage builds up and no step is worked twice.
    Null ends and self links are ignored; repeated links do no harm; an empty table gives an empty result.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    pairs = spill(pairs, "links")
    before, total = None, 2 * pairs.count()
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("small").alias("big"), F.col("big").alias("small")))
        least = both.groupBy("big").agg(F.min("small").alias("low"), F.count(F.lit(1)).alias("n")).select("big", F.least("big", "low").alias("low"), "n")
        large = heavy_join(both, spill(least, "least"), ["big"], "n", total).where("small > big").select(F.col("small").alias("big"), F.col("low").alias("small"))
        large = spill(large, "large")
        low = spill(large.groupBy("big").agg(F.min("small").alias("low"), F.count(F.lit(1)).alias("n")), "low")
        small = heavy_join(large, low, ["big"], "n", total).select(F.col("small").alias("big"), F.col("low").alias("small"))
        small = small.unionByName(low.select("big", F.col("low").alias("small")))
        pairs = spill(small.where("big <> small").distinct(), "links")
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before, total = now, 2 * now["n"]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    rooted = pairs.select(F.col("big").alias("node"), F.col("small").alias("root"))
    return rooted.unionByName(pairs.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())
