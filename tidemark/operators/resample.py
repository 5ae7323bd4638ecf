"""Slices, cohorts, joins by hashed id, and bootstrap intervals from sufficient statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_total
from .metrics import confusion, overall, per_class


def sliced(df: DataFrame, name: Column) -> DataFrame:
    """Every row twice: in the slice ALL and in its own."""
    return df.withColumn("slice", F.explode(F.array(F.lit("ALL"), name)))


def slice_metrics(df: DataFrame, name: Column, keys: list[str]) -> DataFrame:
    keys = [*keys, "slice"]
    return overall(per_class(confusion(sliced(df, name), keys), keys), keys)


def slice_partition(df: DataFrame, name: Column, parts: list[str]) -> DataFrame:
    """Per cell of the confusion matrix: do the parts add up to ALL."""
    cm = confusion(sliced(df, name), ["slice"])
    sums = cm.groupBy("y_true", "y_pred").agg(F.sum(F.when(F.col("slice") == "ALL", F.col("n")).otherwise(0)).alias("n_all"), F.sum(F.when(F.col("slice").isin(parts), F.col("n")).otherwise(0)).alias("n_parts"))
    return sums.withColumn("matches", F.col("n_all") == F.col("n_parts"))


def hashed_id(column: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), column.cast("string")), 256)


def hash_join(predictions: DataFrame, context: DataFrame, hash_col: str, id_col: str, salt: str) -> DataFrame:
    """Joins stored predictions to their context by salted hash; refuses repeated hashes on either side."""
    keyed = context.withColumn(hash_col, hashed_id(F.col(id_col), salt))
    for side in (predictions, keyed):
        if side.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError("the join is not one to one")
    return predictions.join(keyed, hash_col)


def class_f1(table: np.ndarray) -> np.ndarray:
    """F1 of each class for confusion matrices (..., truth, guess)."""
    tp = np.diagonal(table, axis1=-2, axis2=-1)
    both = table.sum(axis=-1) + table.sum(axis=-2)
    return np.divide(2 * tp, both, out=np.zeros_like(tp, dtype=float), where=both > 0)


def spread(values: np.ndarray) -> tuple[float | None, float | None]:
    """The 95 % interval of the values that are not NaN."""
    known = values[np.isfinite(values)]
    return tuple(float(q) for q in np.percentile(known, [2.5, 97.5])) if len(known) else (None, None)


def divided(a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.shape(a), empty), where=b > 0)


def stratified_ci(cm: DataFrame, keys: list[str], classes: int, replicates: int, seed: int, small_support: int = 400) -> DataFrame:
    """Keys, class_id, metric, support, small_support, estimate (mean of the draws), low, high: 95 % intervals of each present
    class's precision, recall and F1 when rows are drawn again inside each true class.

    The draw needs only the confusion counts (a few rows a key): of a class's rows, those it is guessed for are binomial.
    Precision is 0 where a draw guesses the class for no row.
    """
    columns = ["class_id", "metric", "support", "small_support", "estimate", "low", "high"]

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, *x[keys].astype(str).sum(axis=1).iloc[0].encode()])
        table = np.zeros((classes, classes), dtype=np.int64)
        np.add.at(table, (x["y_true"].to_numpy(), x["y_pred"].to_numpy()), x["n"].to_numpy())
        support, out = table.sum(axis=1), []
        for c in np.flatnonzero(support):
            guessed = np.array([rng.binomial(support[t], table[t, c] / support[t], replicates) if support[t] else np.zeros(replicates, int) for t in range(classes)])
            tp, all_guessed = guessed[c].astype(float), guessed.sum(axis=0)
            for metric, v in (("precision", divided(tp, all_guessed, 0.0)), ("recall", tp / support[c]), ("f1", 2 * tp / (support[c] + all_guessed))):
                out.append((int(c), metric, int(support[c]), bool(support[c] < small_support), v.mean(), *spread(v)))
        frame = pd.DataFrame(out, columns=columns)
        for k in keys:
            frame[k] = x[k].iloc[0]
        return frame[[*keys, *columns]]

    types = dict(cm.dtypes)
    named = "".join(f"`{k}` {types[k]}, " for k in keys)
    return cm.groupBy(*keys).applyInPandas(draw, named + "class_id int, metric string, support long, small_support boolean, estimate double, low double, high double")


PARTS = 4096


def part_draws(n: int, size: int, part: int, replicates: int, seed: int) -> np.ndarray:
    """How many of n draws from n clusters fall on the clusters of a part (``size`` a part, in order), for each replicate.

    Halving the range of parts, the draws of a half are binomial given those of the whole; the generator of each halving is
    named by it, so every task that comes through it finds the same numbers, and parts add up to n.
    """
    low, high, drawn = 0, -(-n // size), np.full(replicates, n)
    while high - low > 1:
        mid = (low + high) // 2
        before, own = (mid - low) * size, min(high * size, n) - low * size
        left = np.random.default_rng([seed, low, high]).binomial(drawn, before / own)
        low, high, drawn = (low, mid, left) if part < mid else (mid, high, drawn - left)
    return drawn


def cluster_draws(cells: DataFrame, cluster: str, cell: list[str], replicates: int, seed: int, least: int = 500) -> DataFrame:
    """replicate, the cell's columns, n: counts of each cell when as many clusters as there are are drawn again, each equally likely.

    cells: cluster, cell columns, n. Clusters are numbered and cut into parts of bounded size, ``PARTS`` at most; a part
    gets its draws from the cascade of ``part_draws`` and deals them to its clusters. Rows without a cluster are one.
    """
    known = cells.withColumn(cluster, F.coalesce(F.col(cluster).cast("string"), F.lit("<null>")))
    named = running_total(known.select(cluster).distinct().withColumn("__one", F.lit(1).cast("long")), [cluster], "__one", "__i")
    n = named.count()
    size = max(least, -(-n // PARTS))
    placed = known.join(named, cluster).select(F.floor((F.col("__i") - 1) / size).cast("int").alias("part"), ((F.col("__i") - 1) % size).cast("int").alias("at"), *cell, "n")

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        part = int(x["part"].iloc[0])
        own = min(size, n - part * size)
        per = part_draws(n, size, part, replicates, seed)
        kinds, which = np.unique(x[cell].to_numpy(), axis=0, return_inverse=True)
        counts = np.zeros((own, len(kinds)))
        np.add.at(counts, (x["at"].to_numpy(), which.ravel()), x["n"].to_numpy())
        rng = np.random.default_rng([seed, part])
        sums = np.stack([rng.multinomial(k, np.full(own, 1 / own)) @ counts for k in per])
        out = pd.DataFrame(np.tile(kinds, (replicates, 1)), columns=cell).astype("int32")
        return out.assign(replicate=np.repeat(np.arange(replicates), len(kinds)), n=sums.ravel().round().astype(np.int64))[["replicate", *cell, "n"]]

    schema = "replicate int, " + ", ".join(f"{c} int" for c in cell) + ", n long"
    return placed.groupBy("part").applyInPandas(draw, schema).groupBy("replicate", *cell).agg(F.sum("n").alias("n"))


def tables_of(x: pd.DataFrame, guess: str, classes: int, replicates: int) -> np.ndarray:
    out = np.zeros((replicates, classes, classes))
    np.add.at(out, (x["replicate"].to_numpy(), x["y_true"].to_numpy(), x[guess].to_numpy()), x["n"].to_numpy())
    return out


def cluster_support(df: DataFrame, cluster: str, classes: int) -> DataFrame:
    """class_id, support, clusters (that hold the class), recall, status: whether an interval over clusters can be told.

    A class that stands in one cluster only has none (``single_cluster``); an absent class neither (``class_absent``).
    """
    per = confusion(df, [cluster]).groupBy(cluster, "y_true").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y_pred") == F.col("y_true"), F.col("n")).otherwise(0)).alias("hit"))
    own = per.groupBy(F.col("y_true").alias("class_id")).agg(F.sum("n").alias("support"), F.count(F.lit(1)).alias("clusters"), (F.sum("hit") / F.sum("n")).alias("recall"))
    every = df.sparkSession.createDataFrame([(c,) for c in range(classes)], "class_id int")
    status = F.when(F.col("clusters") > 1, "estimated").when(F.col("clusters") == 1, "single_cluster").otherwise("class_absent")
    filled = every.join(own, "class_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("support", "clusters")})
    return filled.withColumn("status", status)


def cluster_ci(df: DataFrame, cluster: str, classes: int, replicates: int, seed: int) -> DataFrame:
    """metric, class_id, estimate, valid, missing, status, low, high: 95 % intervals when whole clusters are drawn again.

    Of each class's recall and F1, over replicates that hold the class (the others are ``missing``), and of macro F1
    (class_id null). No interval where ``cluster_support`` says that there is none.
    """
    cells = confusion(df, [cluster])
    drawn = cluster_draws(cells, cluster, ["y_true", "y_pred"], replicates, seed)
    whole = cells.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n")).withColumn("replicate", F.lit(replicates))
    status = {r.class_id: r.status for r in cluster_support(df, cluster, classes).collect()}  # a row a class
    several = cells.select(cluster).distinct().limit(2).count() > 1

    def intervals(x: pd.DataFrame) -> pd.DataFrame:
        table = tables_of(x, "y_pred", classes, replicates + 1)  # the last one is the data itself
        tp, support, f1 = np.diagonal(table, axis1=-2, axis2=-1), table.sum(axis=-1), class_f1(table)
        out = []
        for metric, v in (("recall", divided(tp, support, np.nan)), ("f1", np.where(support > 0, f1, np.nan))):
            for c in range(classes):
                own = v[:-1, c]
                valid = int(np.isfinite(own).sum())
                out.append((metric, c, v[-1, c], valid, replicates - valid, status[c], *(spread(own) if status[c] == "estimated" else (None, None))))
        macro = f1.mean(axis=-1)
        out.append(("macro_f1", None, macro[-1], replicates, 0, "estimated" if several else "single_cluster", *(spread(macro[:-1]) if several else (None, None))))
        frame = pd.DataFrame(out, columns=["metric", "class_id", "estimate", "valid", "missing", "status", "low", "high"])
        return frame.assign(class_id=frame["class_id"].astype("Int32"), estimate=frame["estimate"].where(np.isfinite(frame["estimate"]), None).astype(object))

    every = drawn.unionByName(whole.select(*drawn.columns)).withColumn("one", F.lit(1))  # a table a replicate
    return every.groupBy("one").applyInPandas(intervals, "metric string, class_id int, estimate double, valid long, missing long, status string, low double, high double")


def delta_facts(n: int, delta: np.ndarray, estimate: float) -> pd.DataFrame:
    """Interval of a difference, the share of positive draws, and how likely a draw falls on the other side of zero, both ways."""
    sign = min(1.0, 2 * min((delta <= 0).mean(), (delta >= 0).mean()))
    return pd.DataFrame([(n, estimate, delta.mean(), *spread(delta), (delta > 0).mean(), sign)], columns=["n", "estimate", "delta", "low", "high", "positive_share", "sign_probability"])


DELTA = "n long, estimate double, delta double, low double, high double, positive_share double, sign_probability double"


def paired_delta_by_cluster(pairs: DataFrame, cluster: str, classes: int, replicates: int, seed: int) -> DataFrame:
    """Macro-F1 difference of two predictions (y_true, a, b) when whole clusters are drawn again: ``delta_facts``."""
    cells = pairs.groupBy(cluster, "y_true", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    drawn = cluster_draws(cells, cluster, ["y_true", "a", "b"], replicates, seed)
    whole = cells.groupBy("y_true", "a", "b").agg(F.sum("n").alias("n")).withColumn("replicate", F.lit(replicates))

    def facts(x: pd.DataFrame) -> pd.DataFrame:
        macro = [class_f1(tables_of(x, g, classes, replicates + 1)).mean(axis=-1) for g in "ab"]
        delta = macro[0] - macro[1]
        return delta_facts(int(x.loc[x["replicate"] == replicates, "n"].sum()), delta[:-1], delta[-1])

    return drawn.unionByName(whole.select(*drawn.columns)).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(facts, DELTA)  # a table a replicate


def paired_delta(pairs: DataFrame, classes: int, replicates: int, seed: int) -> DataFrame:
    """Macro-F1 difference of two predictions of the same rows (y_true, a, b) when rows are drawn again: ``delta_facts``.

    Only the joint cell counts (classes cubed) are drawn again.
    """
    cells = pairs.groupBy("y_true", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["y_true", "a", "b"])
        n = x["n"].to_numpy()
        counts = np.vstack([np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), replicates), n])
        tables = np.zeros((2, replicates + 1, classes, classes))
        for j, (y, a, b) in enumerate(zip(x["y_true"], x["a"], x["b"], strict=True)):
            tables[0, :, y, a] += counts[:, j]
            tables[1, :, y, b] += counts[:, j]
        delta = class_f1(tables[0]).mean(axis=-1) - class_f1(tables[1]).mean(axis=-1)
        return delta_facts(int(n.sum()), delta[:-1], delta[-1])

    return cells.groupBy("one").applyInPandas(draw, DELTA)


def compare_runs(a: DataFrame, b: DataFrame, key: str, probs: list[str]) -> DataFrame:
    right = b.select(key, F.col("y_true").alias("__t"), F.col("y_pred").alias("__g"), *(F.col(p).alias(f"__{p}") for p in probs))
    gap = F.greatest(*(F.abs(F.col(p) - F.col(f"__{p}")) for p in probs))
    return a.join(right, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") != F.col("__t")).alias("label_changes"), F.count_if(F.col("y_pred") != F.col("__g")).alias("prediction_changes"), F.max(gap).alias("max_gap"))


def flag_cells(facts: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of facts and support cells, with where each cell was found."""
    a, b = facts.withColumn("__a", F.lit(1)), support.withColumn("__b", F.lit(1))
    return a.join(b, keys, "full").withColumn("found", F.when(F.col("__b").isNull(), "facts_only").when(F.col("__a").isNull(), "support_only").otherwise("both")).drop("__a", "__b")
