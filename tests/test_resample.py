"""Bootstrap draws and intervals against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import resample as R


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 1500)
    return [(f"c{int(i)}", int(t), int(t if rng.random() < 0.7 else rng.integers(0, 3)), int(t if rng.random() < 0.5 else rng.integers(0, 3))) for i, t in zip(np.sort(rng.integers(0, 60, 1500) ** 2 // 60), y, strict=True)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, y_true int, y_pred int, other int")


def test_parts_add_up():
    """Parts get all draws of every replicate, with the moments of a multinomial."""
    n, size, replicates = 103, 10, 4000
    parts = np.stack([R.part_draws(n, size, p, replicates, 5) for p in range(11)])
    assert (parts.sum(axis=0) == n).all()
    share = np.array([10 / 103] * 10 + [3 / 103])
    assert np.allclose(parts.mean(axis=1), n * share, atol=0.25) and np.allclose(parts.var(axis=1), n * share * (1 - share), rtol=0.12)
    cov = np.cov(parts)
    assert abs(cov[0, 1] + n * share[0] * share[1]) < 0.4


def test_draws_have_as_many_clusters_as_there_are(spark):
    """Each cluster is a cell of its own: a replicate's counts add up to the clusters, with mean 1 and variance 1 - 1/n."""
    n, replicates = 57, 3000
    cells = spark.createDataFrame([(f"g{i}", i, 1) for i in range(n)], "g string, k int, n long")
    got = R.cluster_draws(cells.repartition(5), "g", ["k"], replicates, 3, least=10).toPandas()
    table = np.zeros((replicates, n))
    table[got["replicate"], got["k"]] = got["n"]
    assert (table.sum(axis=1) == n).all()
    assert np.allclose(table.mean(axis=0), 1, atol=0.09) and np.allclose(table.var(axis=0), 1 - 1 / n, atol=0.15)


def test_cluster_intervals_like_numpy(frame, rows):
    names = sorted({r[0] for r in rows})
    counts = np.zeros((len(names), 3, 3))
    for g, t, p, _ in rows:
        counts[names.index(g), t, p] += 1
    draws = np.random.default_rng(1).multinomial(len(names), np.full(len(names), 1 / len(names)), 4000)
    tables = np.einsum("rg,gtp->rtp", draws, counts)
    for r in R.cluster_ci(frame, "g", 3, 2000, 1).collect():
        if r.metric == "recall":
            v = tables[:, r.class_id, r.class_id] / tables[:, r.class_id].sum(axis=1)
            assert abs(r.estimate - counts[:, r.class_id, r.class_id].sum() / counts[:, r.class_id].sum()) < 1e-12
        else:
            f = R.class_f1(tables)
            v = f.mean(axis=1) if r.class_id is None else f[:, r.class_id]
        low, high = np.percentile(v, [2.5, 97.5])
        assert r.status == "estimated" and r.valid == 2000 and r.missing == 0
        assert abs(r.low - low) < 0.15 * (high - low) and abs(r.high - high) < 0.15 * (high - low)


def test_status(spark):
    """Class 1 in one cluster, class 2 in two of them and now and then in none drawn, class 3 nowhere."""
    rows = [("a", 0, 0)] * 5 + [("b", 0, 1)] * 5 + [("b", 1, 1)] * 3 + [("c", 2, 2), ("d", 2, 0), ("d", 0, 0)]
    got = {(r.metric, r.class_id): r for r in R.cluster_ci(spark.createDataFrame(rows, "g string, y_true int, y_pred int"), "g", 4, 400, 1).collect()}
    assert [got["recall", c].status for c in range(4)] == ["estimated", "single_cluster", "estimated", "class_absent"]
    assert got["recall", 1].low is None and got["recall", 1].estimate == 1.0 and got["recall", 3].estimate is None and got["recall", 3].missing == 400
    r = got["recall", 2]
    assert r.valid + r.missing == 400 and abs(r.missing / 400 - (2 / 4) ** 4) < 0.04 and 0 <= r.low <= r.high <= 1
    one = R.cluster_ci(spark.createDataFrame(rows[:5], "g string, y_true int, y_pred int"), "g", 2, 50, 1).where("metric = 'macro_f1'").first()
    assert one.status == "single_cluster" and one.low is None
    assert R.cluster_ci(spark.createDataFrame([], "g string, y_true int, y_pred int"), "g", 2, 50, 1).count() == 0


def test_paired_differences(frame, rows):
    pairs = frame.select("g", "y_true", F.col("y_pred").alias("a"), F.col("other").alias("b"))
    f1 = lambda k: R.class_f1(np.histogram2d([r[1] for r in rows], [r[k] for r in rows], bins=[range(4)] * 2)[0]).mean()
    for r in (R.paired_delta(pairs, 3, 1000, 1).first(), R.paired_delta_by_cluster(pairs, "g", 3, 1000, 1).first()):
        assert r.n == 1500 and abs(r.estimate - (f1(2) - f1(3))) < 1e-12
        assert r.low < r.estimate < r.high and r.low > 0 and r.sign_probability == 0 and r.positive_share == 1
    same = pairs.withColumn("b", F.col("a"))
    for r in (R.paired_delta(same, 3, 200, 1).first(), R.paired_delta_by_cluster(same, "g", 3, 200, 1).first()):
        assert r.estimate == r.delta == 0 and r.positive_share == 0 and r.sign_probability == 1
    mixed = pairs.withColumn("b", F.when(F.xxhash64("g", "y_true", "a", "b") % 2 == 0, F.col("a")).otherwise(F.col("y_true")))
    r = R.paired_delta(mixed, 3, 500, 1).first()
    assert r.estimate < 0 and 0 <= r.sign_probability <= 1


def test_stratified_intervals(frame, rows):
    """Each metric within its binomial interval; the flag for small classes; an absent class has no row."""
    table = np.histogram2d([r[1] for r in rows], [r[2] for r in rows], bins=[range(4)] * 2)[0]
    got = R.stratified_ci(M.confusion(frame.withColumn("k", F.lit("all")), ["k"]), ["k"], 4, 4000, 1, small_support=500).collect()
    assert len(got) == 9
    rng = np.random.default_rng(0)
    for r in got:
        c, support = r.class_id, table.sum(axis=1)
        hits = np.stack([rng.binomial(int(support[t]), table[t, c] / support[t], 8000) for t in range(3)])
        v = {"recall": hits[c] / support[c], "precision": hits[c] / hits.sum(axis=0), "f1": 2 * hits[c] / (support[c] + hits.sum(axis=0))}[r.metric]
        assert r.support == support[c] and r.small_support == (support[c] < 500)
        assert np.allclose([r.estimate, r.low, r.high], [v.mean(), *np.percentile(v, [2.5, 97.5])], atol=0.006)
