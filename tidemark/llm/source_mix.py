"""Mixing sources to target weights: a budget of words for each source, met by whole documents.

Budgets come from a water level over sources. Documents are counted by exact length, so a source is a short table of
lengths, however many rows it has. A budget is first met in proportion (the same share of each length), then length by
length in a seeded order, and the last words by a bounded-knapsack table over sums of the remaining documents. Which
documents of a length are taken is a matter of seeded ranks, dealt over parts so that no task holds a large length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import running_total
from .common import spill, text_of

WEIGHTS, MOST, WINDOW, PARTS = (5, 2, 1), 3, 1 << 16, 256
SOURCE = ["no_source", "source"]


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to no_source, source, source_size: shares by weight of all words, none above ``most`` times its size.

    Sources in order (null last) take the weights in turn. What a source cannot take goes to the others by weight, so
    each target is the smaller of its limit and weight times one level. Sources ordered by limit for each unit of weight
    give that level: the first one whose limit is not below what is left for it and those after it.
    """
    ranked = running_total(totals.withColumn("one", F.lit(1).cast("long")), SOURCE, "one", "rank").drop("one")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    x = ranked.withColumn("weight", turn).withColumn("limit", F.col("source_size") * most)
    x = spill(x.withColumn("full_at", F.col("limit") / F.col("weight")), "mix-sources")
    whole = x.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()  # one row
    upto = running_total(x, ["full_at", "rank"], ["limit", "weight"], ["limits", "weights"])
    level = (F.lit(whole.words) - (F.col("limits") - F.col("limit"))) / (F.lit(whole.weights) - (F.col("weights") - F.col("weight")))
    fits = upto.withColumn("level", level).where("full_at >= level")
    found = fits.agg(F.min_by("level", F.struct("full_at", "rank"))).first()[0]  # one row
    return x.select(*SOURCE, "source_size", F.least(F.col("limit").cast("double"), F.lit(float(found or 0)) * F.col("weight")).alias("target"))


def reach(lengths: np.ndarray, spare: np.ndarray, left: int) -> np.ndarray:
    """How many of each length to take, at most ``spare``, so that their sum comes nearest to ``left`` (ties: the smaller sum).

    A table over sums up to twice ``left`` notes the item by which each sum was first reached; items are 1, 2, 4, ...
    documents of a length, so counts stay bounded, and the walk back from a sum meets each item once.
    """
    taken = np.zeros(len(lengths), np.int64)
    most = 2 * left
    reached, by, items = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int32), []
    reached[0] = True
    for i in np.flatnonzero((spare > 0) & (lengths <= most) & (lengths > 0)):
        rest, k = int(min(spare[i], most // lengths[i])), 1
        while rest and not reached[left]:
            k = min(k, rest)
            step = k * int(lengths[i])
            new = reached[: most + 1 - step] & ~reached[step:]
            by[step:][new] = len(items)
            reached[step:] |= new
            items.append((i, k, step))
            rest, k = rest - k, 2 * k
        if reached[left]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, k, step = items[by[at]]
        taken[i] += k
        at -= step
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, goal: int, most: int, seed: int, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """Copies that every document gets, and for each length the number of documents that get one more, for ``goal`` words."""
    words = sum(int(n) * int(c) for n, c in zip(lengths, counts, strict=True))
    none = np.zeros(len(lengths), np.int64)
    if not words:
        return 0, none
    copies = min(goal // words, most)
    rest = goal - copies * words
    if copies == most or not rest:
        return copies, none
    more = np.array([int(c) * rest // words for c in counts], np.int64)
    left = rest - sum(int(m) * int(n) for m, n in zip(more, lengths, strict=True))
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:
        if left <= window:
            break
        if 0 < lengths[i] <= left and more[i] < counts[i]:
            more[i] += 1
            left -= int(lengths[i])
    if left:
        more[order] += reach(lengths[order], (counts - more)[order], int(left))
    return copies, more


def fitted(lengths: DataFrame, most: int, seed: int) -> DataFrame:
    """no_source, source, size, copies, more of a table with a row for each length of a source, its number and the source's target.

    A task holds one source's lengths: at most as many as its longest document has words.
    """

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("size")
        copies, more = fit_budget(x["size"].to_numpy(), x["n"].to_numpy(), round(float(x["target"].iloc[0])), most, seed)
        return x[[*SOURCE, "size"]].assign(copies=copies, more=more)

    return lengths.groupBy(*SOURCE).applyInPandas(fit, "no_source boolean, source string, size long, copies long, more long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: the words of each document that the mix takes.

    Size is the number of words between blanks (null text: 0). All targets together are all words; a source's taken words
    come as near its target as whole documents allow. One row for each row of ``docs``; a null source is a source of its
    own, in the last place; rows repeated with their identifier are documents like any other. Documents of a length
    are taken by a hash of seed and identifier, so reruns agree. Other columns are not read.
    """
    size = F.regexp_count(text_of(text_col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    source, draw = F.col(source_col).cast("string"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    sized = docs.select(F.col(id_col).alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"), draw.alias("draw"))
    sized = spill(sized.withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int")), "mix-sizes")
    own = [*SOURCE, "size"]
    parts = spill(sized.groupBy(*own, "part").agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    lengths = spill(parts.groupBy(*own).agg(F.sum("n").alias("n")), "mix-lengths")
    targets = source_targets(lengths.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    plan = fitted(lengths.join(targets, SOURCE), most, seed).join(targets, SOURCE)

    before = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
    share = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, own).withColumn("more", F.col("more") - F.col("before"))
    rank = F.row_number().over(Window.partitionBy(*own, "part").orderBy("draw", "doc_id"))
    ranked = sized.withColumn("rank", rank).join(share.select(*own, "part", "copies", "more", "source_size", "target"), [*own, "part"])
    copies = (F.col("copies") + (F.col("rank") <= F.col("more")).cast("long")).alias("copies")
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies)
