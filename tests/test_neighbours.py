"""Neighbours by pivots and rings, visible neighbours and candidate rounds against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import balance as B
from tidemark.operators import inspected as Z
from tidemark.operators import neighbours as N

LABELS = ["a", "b"]


@pytest.fixture(scope="module")
def points():
    """Two classes in clumps, equal points, far ones, and a class of one row."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(8, 4)) * 3
    v = np.concatenate([middle[rng.integers(0, 8, 500)] + rng.normal(size=(500, 4)) * 0.4, np.ones((60, 4)), rng.normal(size=(10, 4)) * 40, np.zeros((1, 4))])
    label = np.array([LABELS[i % 3 == 0] for i in range(len(v) - 1)] + ["one"])
    gap = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    gap[label[:, None] != label] = np.inf
    np.fill_diagonal(gap, np.inf)
    return v, label, gap


@pytest.fixture(scope="module")
def frame(spark, points):
    v, label, _ = points
    rows = [(i, [float(x) for x in p], str(c), 1) for i, (p, c) in enumerate(zip(v, label, strict=True))]
    more = [(None, [0.0] * 4, "a", 1), (10_000, None, "a", 1), (10_001, [0.0] * 4, None, 1)]  # left out
    return spark.createDataFrame(rows + more, "id long, v array<double>, c string, pivot int").repartition(5)


@pytest.fixture(scope="module", params=[20, 10_000])
def index(request, frame):
    return N.cells(frame, "id", "v", "c", block_rows=request.param)


def test_k_nearest(points, index):
    _, _, gap = points
    got = {}
    for r in N.k_nearest(index, 4).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    for i in range(len(gap)):
        order = [int(j) for j in np.lexsort((np.arange(len(gap)), gap[i]))[:4] if gap[i, j] < np.inf]
        assert [got.get(i, {})[k + 1] for k in range(len(order))] == order and len(got.get(i, {})) == len(order)


def test_radius(spark, points, index):
    _, label, gap = points
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(gap <= 1), strict=True)}
    assert {(r.id, r.neighbour) for r in N.radius_neighbours(index, 1.0).collect()} == pairs
    assert {r.id: r.n for r in N.radius_degrees(index, 1.0).collect()} == {i: int((gap[i] <= 1).sum()) for i in range(len(gap))}
    draws = spark.createDataFrame([(i % len(gap), i) for i in range(4 * len(gap))], "id long, nth long")
    found = N.radius_draws(index, draws, 1.0, 3).collect()
    assert sorted(r.nth for r in found) == [i for i in range(4 * len(gap)) if label[i % len(gap)] != "one"]
    assert all((r.id, r.neighbour) in pairs if not r.fallback else gap[r.id].min() > 1 and gap[r.id, r.neighbour] == gap[r.id].min() for r in found)
    assert any(r.fallback for r in found)


def test_only_rings_within_reach_are_visited(spark):
    """Far clumps never meet: a row visits its own clump's rings."""
    rows = [(i, [float(100 * (i % 10)), i / 10_000], "a") for i in range(2000)]
    index = N.cells(spark.createDataFrame(rows, "id long, v array<double>, c string"), "id", "v", "c", block_rows=50)
    seen = N.visits(index, N.seeking(index.rows, 0.3), 0)
    rings = sum(len(r) for r in index.rings.values())
    assert seen.count() < 0.25 * 2000 * rings
    far = seen.join(index.rows.groupBy("pivot", "ring").agg(F.min(F.col("v")[0]).alias("lo"), F.max(F.col("v")[0]).alias("hi")), ["pivot", "ring"])
    assert far.where((F.col("lo") > F.col("v")[0] + 1) | (F.col("hi") < F.col("v")[0] - 1)).count() < 0.1 * seen.count()


def test_equal_rows_are_cut_into_blocks(spark):
    """A third of all rows are one point: no block holds more than a few times ``block_rows``, and all pairs count."""
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(i), 0.0], "a") for i in range(1500)]
    index = N.cells(spark.createDataFrame(rows, "id long, v array<double>, c string"), "id", "v", "c", block_rows=50)
    assert index.rows.groupBy("pivot", "ring", "block").count().agg(F.max("count")).first()[0] < 150
    assert N.radius_degrees(index, 0.1).where("n = 499").count() == 500


def test_draws_are_even(spark):
    """Each of five neighbours is drawn about as often as the others."""
    rows = [(i, [0.1 * i], "a") for i in range(6)]
    index = N.cells(spark.createDataFrame(rows, "id long, v array<double>, c string"), "id", "v", "c")
    draws = spark.range(3000).select(F.lit(2).cast("long").alias("id"), F.col("id").alias("nth"))
    counts = [r["count"] for r in N.radius_draws(index, draws, 9.0, 7).groupBy("neighbour").count().collect()]
    assert len(counts) == 5 and min(counts) > 500 and max(counts) < 700


def test_visible_on_a_line(spark):
    """From 0, 1 hides 2; from 2, 1 hides 0; from 1 both are seen."""
    df = spark.createDataFrame([(i, [float(i), 0.0], "a") for i in range(3)], "id long, v array<double>, c string")
    seen = Z.visible(N.k_nearest(N.cells(df, "id", "v", "c"), 2), df, "id", "v").collect()
    assert {(r.id, r.neighbour) for r in seen} == {(0, 1), (1, 0), (1, 2), (2, 1)} and not any(r.fallback for r in seen)


def test_visible(frame, points, index):
    v, _, gap = points
    near = N.k_nearest(index, 6)
    lists = {}
    for r in near.collect():
        lists.setdefault(r.id, []).append((r["rank"], r.neighbour))
    want = set()
    for i, own in lists.items():
        ids = [j for _, j in sorted(own)]
        seen = [j for j in ids if all((v[i] - v[z]) @ (v[j] - v[z]) >= -1e-6 for z in ids)]
        want |= {(i, j, not seen) for j in seen or ids[:1]}
    assert {(r.id, r.neighbour, r.fallback) for r in Z.visible(near, frame.where("id is not null and v is not null"), "id", "v").collect()} == want


def test_visible_of_given_neighbours(spark):
    """Any neighbours can be given, not only the nearest ones: a row between hides, one on the other side does not."""
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [-1.0]), (3, [3.0])], "id long, v array<double>")
    near = spark.createDataFrame([(0, 1, 1.0, 1), (0, 3, 9.0, 2), (0, 2, 1.0, 3), (1, 3, 4.0, 1), (1, 2, 4.0, 2)], "id long, neighbour long, distance double, rank int")
    got = {(r.id, r.neighbour, r.fallback) for r in Z.visible(near, df, "id", "v").collect()}
    assert got == {(0, 1, False), (0, 2, False), (1, 3, False), (1, 2, False)}


def test_a_second_round(spark):
    """A class between two others: inspectors refuse many candidates, so more than one round is needed; every row kept passed."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=2)], 0) for i in range(300)]
    rows += [(300 + i, [float(x) for x in rng.normal(size=2) * 0.8 + (2.0 * (i % 2) - 1.0, 0)], 1) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c int")
    quotas = spark.createDataFrame([(0, 0), (1, 60)], "c int, quota long")
    made, facts = Z.inspected_rows(df, quotas, "c", "id", "v", 5, k=5, trees=8, threshold=0.0, least_batch=1, most_rounds=12)
    f = facts.collect()
    assert len(f) == 1 and f[0].c == 1 and f[0].inspectors_wanted == 13 and f[0].inspectors == 4 and f[0].rounds >= 2 and f[0].met
    got = made.collect()
    assert len(got) == 60 == len({r.synthetic_id for r in got}) and f[0].generated > 60 and f[0].acceptance == 60 / f[0].generated
    near = Z.visible(N.k_nearest(N.cells(df.where("c = 1"), "id", "v", "c"), 5), df, "id", "v").collect()
    assert {(r.a, r.b) for r in got} <= {(r.id, r.neighbour) for r in near} and all(r.against == 0 for r in got)
    again, _ = Z.inspected_rows(df.repartition(3), quotas, "c", "id", "v", 5, k=5, trees=8, threshold=0.0, least_batch=1, most_rounds=1)
    assert again.count() < 60


def test_rounds_without_rows(spark):
    """A class of one row, or no quota: nothing is made, and the facts say so."""
    df = spark.createDataFrame([(i, [float(i)], int(i == 0)) for i in range(9)], "id long, v array<double>, c int")
    made, facts = Z.inspected_rows(df, spark.createDataFrame([(1, 5)], "c int, quota long"), "c", "id", "v", 5)
    assert made.count() == 0 and [(r.rounds, r.accepted, r.met) for r in facts.collect()] == [(0, 0, False)]
    made, facts = Z.inspected_rows(df, spark.createDataFrame([], "c int, quota long"), "c", "id", "v", 5)
    assert made.count() == 0 and facts.count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "id long, v array<double>, c string")
    index = N.cells(none, "id", "v", "c")
    assert N.k_nearest(index, 3).count() == 0 and N.radius_degrees(index, 1.0).count() == 0
    assert B.radius_pairs(none, spark.createDataFrame([], "c string, quota long"), "c", "id", "v", 1.0, 3).count() == 0
