"""Exact neighbours of rows with vectors, within their class, by pivots and the triangle inequality.

Each class has pivots, at most ``PIVOTS`` of them. A row belongs to the cell of its nearest pivot and to a ring of that cell
by its distance from the pivot; a ring with many rows is cut into blocks by hash, so a block stays small even where
rows are equal. A row that looks for others within a reach visits only the rings that can hold one: by its distance from
the ring's pivot and the ring's bounds, and by the plane halfway between that pivot and its own. Rows and visitors of a
block meet in one task, visitors of a busy ring in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch_path

BLOCK_ROWS, VISITORS, PIVOTS, RINGS = 2000, 8000, 256, 256
BLOCK = ["c", "pivot", "ring", "block", "chunk"]


@dataclass(frozen=True)
class Cells:
    """rows: c, id, v, pivot, gap (distance from the pivot), ring, block. pivots: class -> matrix. rings: class -> a row for each ring."""

    rows: DataFrame
    pivots: dict[str, np.ndarray]
    rings: dict[str, pd.DataFrame]


def held(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y."""
    squares = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T
    return np.sqrt(np.maximum(squares, 0))


def cells(df: DataFrame, id_col: str, vector: str, label: str, block_rows: int = BLOCK_ROWS) -> Cells:
    """Rows with their ring and block. What the driver holds is bounded: pivots and rings, whatever the number of rows.

    Pivots are rows drawn by hash, about one for ``block_rows`` rows of the class. Rows with a null identifier, vector or label are left out.
    """
    x = df.select(F.col(label).cast("string").alias("c"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    sizes = {r.c: r.n for r in x.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    wanted = {c: min(PIVOTS, n // block_rows + 1) for c, n in sizes.items()}
    spark = df.sparkSession
    if not sizes:
        return Cells(x.withColumns({"pivot": F.lit(0), "gap": F.lit(0.0), "ring": F.lit(0), "block": F.lit(0)}), {}, {})
    share = spark.createDataFrame([(c, min(1.0, 4 * k / sizes[c])) for c, k in wanted.items()], "c string, share double")
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = x.join(F.broadcast(share), "c").where(draw < F.col("share")).select("c", "id", "v")  # about four times the pivots
    first = x.groupBy("c").agg(F.min_by("v", "id").alias("v")).select("c", F.lit(-1).cast("long").alias("id"), "v")
    found: dict[str, list] = {}
    for r in sorted(drawn.unionByName(first).collect(), key=lambda r: (r.c, r.id != -1, hash(r.id))):
        if len(found.setdefault(r.c, [])) < wanted[r.c]:
            found[r.c].append(r.v)
    pivots = {c: np.array(v, dtype=float) for c, v in found.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, own in b.groupby("c"):
                d = gaps(matrix(own["v"]), pivots[c])
                at = d.argmin(axis=1)
                yield own.assign(pivot=at, gap=d[np.arange(len(own)), at])

    placed = held(x.mapInPandas(nearest, "c string, id long, v array<double>, pivot int, gap double"), "cells")
    spans = placed.groupBy("c", "pivot").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.least(F.lit(RINGS), F.floor(F.count(F.lit(1)) / block_rows) + 1).alias("n_rings"))
    width = F.greatest(F.col("high") - F.col("low"), F.lit(1e-300))
    ring = F.least(F.floor((F.col("gap") - F.col("low")) / width * F.col("n_rings")), F.col("n_rings") - 1).cast("int")
    ringed = placed.join(F.broadcast(spans), ["c", "pivot"]).withColumn("ring", ring).drop("low", "high", "n_rings")  # a row a pivot
    bounds = ringed.groupBy("c", "pivot", "ring").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("n"))
    bounds = bounds.withColumn("blocks", F.floor(F.col("n") / block_rows) + 1)
    rings = bounds.toPandas()  # at most RINGS rows a pivot
    blocked = ringed.join(F.broadcast(bounds.select("c", "pivot", "ring", "blocks")), ["c", "pivot", "ring"])  # bounded likewise
    rows = blocked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return Cells(rows, pivots, {c: g.reset_index(drop=True) for c, g in rings.groupby("c")})


def visits(index: Cells, seekers: DataFrame, k: int) -> DataFrame:
    """Seekers (c, id, v, reach, pivot, ...) once for each ring that can hold a row within ``reach``; a null reach stands for a bound that holds ``k`` other rows."""
    pivots, rings = index.pivots, index.rings
    between = {c: gaps(p, p) for c, p in pivots.items()}
    names = seekers.columns

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, own in b.groupby("c"):
                r, x = rings[c], matrix(own["v"])
                d = gaps(x, pivots[c])
                home = own["pivot"].to_numpy()
                slack = 1e-6 * (np.sqrt((x**2).sum(axis=1)) + np.sqrt((pivots[c] ** 2).sum(axis=1).max()))  # rounding of distances
                to, low, high = r["pivot"].to_numpy(), r["low"].to_numpy(), r["high"].to_numpy()
                out, reaches = [], own["reach"].to_numpy(dtype=float).copy()
                for i, reach in enumerate(reaches):
                    if np.isnan(reach):
                        upper = d[i, to] + high
                        order = np.argsort(upper)
                        enough = np.searchsorted(np.cumsum(r["n"].to_numpy()[order]), k + 1)
                        reach = upper[order[enough]] + slack[i] if enough < len(order) else np.inf
                    plane = (d[i] ** 2 - d[i, home[i]] ** 2) / np.where(between[c][home[i]] > 0, 2 * between[c][home[i]], np.inf)
                    least = np.maximum(np.maximum(d[i, to] - high, low - d[i, to]), plane[to])
                    out.append(np.flatnonzero(least <= reach + slack[i]))
                    reaches[i] = reach
                at = np.repeat(np.arange(len(own)), [len(o) for o in out])
                hit = np.concatenate(out) if out else np.empty(0, int)
                yield own.assign(reach=reaches).iloc[at].assign(to=to[hit], ring=r["ring"].to_numpy()[hit], blocks=r["blocks"].to_numpy()[hit])[[*names, "to", "ring", "blocks"]]

    schema = ", ".join(f"{n} {t}" for n, t in seekers.dtypes) + ", to int, ring int, blocks long"
    return seekers.mapInPandas(go, schema).withColumn("pivot", F.col("to")).drop("to")


def meet(index: Cells, seekers: DataFrame, k: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` of the seekers (first frame) and the rows of each block they visit (second frame: id2, v2)."""
    going = held(visits(index, seekers, k), "visits")
    chunks = going.groupBy("c", "pivot", "ring").agg((F.floor(F.count(F.lit(1)) / VISITORS) + 1).cast("int").alias("chunks"))
    chunks = F.broadcast(chunks)  # a row a ring at most
    left = going.join(chunks, ["c", "pivot", "ring"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks", "chunks")
    right = index.rows.join(chunks, ["c", "pivot", "ring"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = right.select(*BLOCK, F.col("id").alias("id2"), F.col("v").alias("v2"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return work(a, b.sort_values("id2")) if len(a) and len(b) else pd.DataFrame(columns=[part.split()[0] for part in schema.split(", ")])

    return left.groupBy(*BLOCK).cogroup(right.groupBy(*BLOCK)).applyInPandas(both, schema)


def squares(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each seeker: its place, the squared distances of the block's other rows, and their ids in order."""
    u, w, ids = matrix(a["v"]), matrix(b["v2"]), b["id2"].to_numpy()
    for i, own in enumerate(a["id"]):
        other = ids != own
        yield i, ((w[other] - u[i]) ** 2).sum(axis=1), ids[other]  # exact differences, a row at a time: little memory at every size


def nearest_in(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for i, d, ids in squares(a, b):
        best = np.argsort(d, kind="stable")[:k]
        own = a["id"].iat[i]
        out += [(own, int(ids[j]), float(d[j])) for j in best]
    return pd.DataFrame(out, columns=["id", "neighbour", "distance"])


def k_nearest(index: Cells, k: int, of: DataFrame | None = None) -> DataFrame:
    """id, neighbour, distance (squared), rank: the k nearest other rows of the same class, ties by id; of the rows ``of`` (id) only, if given.

    The k-th nearest row of a row's own block bounds how far the others can be; where the block holds fewer, a bound
    comes from the rings' sizes.
    """
    marked = index.rows.withColumn("seeks", F.lit(True))
    if of is not None:
        chosen = of.select("id").distinct().withColumn("seeks", F.lit(True))
        marked = index.rows.join(chosen, "id", "left").withColumn("seeks", F.coalesce("seeks", F.lit(False)))

    def bounded(own: pd.DataFrame) -> pd.DataFrame:
        u, ids = matrix(own["v"]), own["id"].to_numpy()
        out = own[own["seeks"]][["c", "id", "v", "pivot"]]
        kth = []
        for i in np.flatnonzero(own["seeks"].to_numpy()):
            d = ((u - u[i]) ** 2).sum(axis=1)[ids != ids[i]]
            kth.append(np.sqrt(np.partition(d, k - 1)[k - 1]) if len(d) >= k else np.nan)
        return out.assign(reach=np.array(kth, dtype=float))

    seekers = marked.groupBy("c", "pivot", "ring", "block").applyInPandas(bounded, "c string, id long, v array<double>, pivot int, reach double")
    near = meet(index, seekers, k, lambda a, b: nearest_in(a, b, k), "id long, neighbour long, distance double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour")))
    return ranked.where(F.col("rank") <= k)


def radius_neighbours(index: Cells, radius: float) -> DataFrame:
    """id, neighbour, distance (squared): all other rows of the same class within the radius."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(a["id"].iat[i], int(ids[j]), float(d[j])) for i, d, ids in squares(a, b) for j in np.flatnonzero(d <= radius * radius)]
        return pd.DataFrame(out, columns=["id", "neighbour", "distance"])

    return meet(index, seeking(index.rows, radius), 0, work, "id long, neighbour long, distance double")


def seeking(rows: DataFrame, radius: float, *more: str) -> DataFrame:
    return rows.select("c", "id", "v", "pivot", *more, F.lit(float(radius)).alias("reach"))


def radius_degrees(index: Cells, radius: float) -> DataFrame:
    """id, n: how many other rows of the class stand within the radius, for every row; no pair leaves a task."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(a["id"].iat[i], int((d <= radius * radius).sum())) for i, d, _ in squares(a, b)], columns=["id", "n"])

    return meet(index, seeking(index.rows, radius), 0, work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of integers below 2^63, as a well-known generator ends a step; products wrap at 2^64."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x >> np.uint64(1)


def radius_draws(index: Cells, draws: DataFrame, radius: float, seed: int) -> DataFrame:
    """nth, id, neighbour, fallback: one neighbour within the radius for each draw (id, nth), each equally likely; the nearest row where there is none.

    A draw takes the neighbour with the smallest hash of (nth, neighbour): the minimum of a block, then of all blocks, so no
    list of neighbours is ever held. ``nth`` tells draws of one id apart. Rows alone in their class give no row.
    """

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        with np.errstate(over="ignore"):
            for i, d, ids in squares(a, b):
                inside = ids[d <= radius * radius]
                if len(inside):
                    h = mixed(mixed(inside) ^ mixed(np.array([a["nth"].iat[i] + seed]))).astype(np.int64)
                    j = int(h.argmin())
                    out.append((a["id"].iat[i], a["nth"].iat[i], int(inside[j]), int(h[j])))
        return pd.DataFrame(out, columns=["id", "nth", "neighbour", "h"])

    seekers = seeking(index.rows.join(draws.select("id", "nth"), "id"), radius, "nth")
    found = meet(index, seekers, 0, work, "id long, nth long, neighbour long, h long").groupBy("id", "nth").agg(F.min_by("neighbour", F.struct("h", "neighbour")).alias("neighbour"))
    found = held(found.withColumn("fallback", F.lit(False)), "draws")
    alone = held(draws.select("id", "nth").join(found, ["id", "nth"], "left_anti"), "alone")
    nearest = k_nearest(index, 1, alone).select("id", "neighbour")
    return found.unionByName(alone.join(nearest, "id").withColumn("fallback", F.lit(True)))
