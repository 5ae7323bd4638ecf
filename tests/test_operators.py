"""Operators that have no SQL, and edge cases, against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranking import average_ranks, quantiles, running_total
from tidemark.operators import balance as B
from tidemark.operators import facts as X
from tidemark.operators import features as P
from tidemark.operators import impute as I
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import quality as D
from tidemark.operators import resample as R
from tidemark.operators import schedule as T
from tidemark.operators import splits as V
from tidemark.sources import tables as S


def test_text_pairs(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("﻿C_1  Cm_2\nC_1 Cm_2\nX_1 Cm_3\nC_4\tCm_5\n\n", encoding="utf-8")
    got = S.read_text_pairs(spark, str(tmp_path / "pairs.txt"), "course", "comment", "C_", "Cm_")
    assert sorted(map(tuple, got.collect())) == [("C_1", "Cm_2"), ("C_4", "Cm_5")]


def test_content_digest_ignores_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        for f in ("x.txt", "y.txt"):
            (tmp_path / name / f).write_text(f)
    digests = {S.content_digest(S.content_manifest(spark, str(tmp_path / n))).first()["digest"] for n in "ab"}
    assert len(digests) == 1


def test_running_total(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit(2).alias("v")).repartition(7)
    got = {r.k: r.total for r in running_total(df, [F.col("k")], "v", "total").collect()}
    assert got == {k: 2 * (k + 1) for k in range(5000)}


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, None, 3.0)], "x double")
    assert {r.x: r.r for r in average_ranks(df, "x", "r").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_parse_dates_of_malformed_lists(spark):
    text = "['2020-01-05'; 2020-13-40, 2019-2-3 nonsense"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(T.parse_dates(F.col("t")).alias("d")).collect()
    assert got[0].d == [dt.date(2020, 1, 5), dt.date(2019, 2, 3)] and got[1].d is None


def test_anchored_intervals_like_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(i), dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d), hours=5)) for i, (k, d) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 1500, 200), strict=True))]
    got = {(r.k, r.id): r.sequence for r in T.anchored_intervals(spark.createDataFrame(rows, "k int, id int, t timestamp"), "k", "t", "id", {}, 90).collect()}
    for k in range(4):
        end, n = None, 0
        for _, t, i in sorted((r[0], r[2], r[1]) for r in rows if r[0] == k):
            if end is None or t > end:
                n, end = n + 1, dt.datetime(t.year, t.month, t.day) + dt.timedelta(days=90)
            assert got[(k, i)] == n


def test_a_hot_course_is_spread(spark):
    """A course of a million points: rows of it come from several tasks, and each has the interval of a loop over its times."""
    count = 1_000_000
    when = F.timestamp_seconds(F.lit(1_500_000_000) + F.when(F.col("id") % 50 == 0, F.col("id") * 400 - F.pmod(F.lit(1_500_000_000) + F.col("id") * 400, F.lit(86_400))).otherwise(F.col("id") * 400))
    df = spark.range(count).select((F.col("id") % 100 == 7).cast("int").alias("course"), when.alias("t"), F.col("id"))
    out = T.anchored_intervals(df, "course", "t", "id", {1: 7}, 131).withColumn("task", F.spark_partition_id())
    got = out.groupBy("course", "sequence", "start_date", "end_date", "anchor").agg(F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).orderBy("course", "sequence").collect()
    assert out.where("course = 0").select("task").distinct().count() > 1
    rows = df.toPandas().sort_values(["course", "t", "id"])
    for course, own in rows.groupby("course"):
        times, ids, at, k = own["t"].to_numpy(), own["id"].to_numpy(), 0, 0
        mine = [r for r in got if r.course == course]
        while at < len(own):
            start = times[at].astype("datetime64[D]")
            last = (start.astype("datetime64[M]") + 7).astype("datetime64[D]") + (start - start.astype("datetime64[M]").astype("datetime64[D]")) - 1 if start.astype("datetime64[M]").astype(int) % 12 == 0 else start + 131
            after = int(np.searchsorted(times, last.astype(times.dtype), "right"))
            r = mine[k]
            assert (r.sequence, np.datetime64(r.start_date), r.anchor, r.n, r.first.id) == (k + 1, start, ids[at], after - at, ids[at])
            at, k = after, k + 1
        assert k == len(mine)
    none = T.anchored_intervals(spark.createDataFrame([(None, None, 1), (1, None, 2)], "course int, t timestamp, id long"), "course", "t", "id", {1: 7}, 131)
    assert [r.sequence for r in none.collect()] == [None, None]


def test_balanced_deal(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", 1 + i % 2, int(n), int(n * p), int(n * (1 - p))) for i, (n, p) in enumerate(zip(rng.integers(5, 90, 60), rng.random(60), strict=True))]
    units = spark.createDataFrame(rows, "unit string, s int, n int, n_a int, n_b int")
    dealt = V.balanced_deal(units, "s", "unit", {"n": 1.0, "n_a": 2.0, "n_b": 2.0}, {1: ["B", "C"], 2: ["D", "E"]}, 42)
    assert dealt.count() == 60
    sums = {r.block: r for r in dealt.groupBy("block").agg(F.sum("n").alias("n"), F.sum("n_a").alias("a")).collect()}
    for a, b in (("B", "C"), ("D", "E")):
        assert abs(sums[a].n - sums[b].n) < 0.1 * (sums[a].n + sums[b].n) and abs(sums[a].a - sums[b].a) < 0.1 * (sums[a].a + sums[b].a)


def test_prefix_view_hides_later_phases(spark):
    view = spark.createDataFrame([(1, 1.0, 2.0, 1, 1)], "id int, x_P1 double, x_P2 double, phase_available_P1 int, phase_available_P2 int")
    row = V.prefix_view(view, ["P1", "P2"], 1).first()
    assert (row.x_P1, row.x_P2, row.phase_available_P1, row.phase_available_P2) == (1.0, None, 1, 0)


def test_gates_refuse(spark):
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id int, v double")
    for call in (lambda: X.require_unique(twice, ["id"]), lambda: P.require_grain(twice, ["id"]), lambda: L.require_invariants(twice, {"low": F.col("v") < 2}), lambda: V.attach_strict(twice, twice.where("id > 1"), ["id"])):
        with pytest.raises(ValueError):
            call()


def test_missing_never_becomes_the_lowest_band(spark):
    df = spark.createDataFrame([(0.9,), (0.1,), (None,)], "s double")
    assert [r.b for r in df.select(L.band(F.col("s"), [("good", 0.6)], "poor").alias("b")).collect()] == ["good", "poor", None]


def test_macro_f1_with_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "y_true int, y_pred int")
    r = M.overall(M.per_class(M.confusion(df, []), []), []).first()
    assert (round(r.macro_f1_fixed, 6), r.macro_f1_present, r.accuracy) == (round(2 / 3, 6), 1.0, 1.0)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(1 - b), float(b), "x") for a, b in zip(y, s, strict=True)], "y_true int, p0 double, p1 double, k string")
    got = {r.class_id: r.auc for r in M.roc_auc(M.one_vs_rest(df, ["k"], (0, 1), ("p0", "p1")), ["k"]).collect()}
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(got[1] - want) < 1e-9


def test_chained_imputation_beats_medians(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=800)
    rows = [(i, float(x), float(3 * x + rng.normal() * 0.1) if i % 4 else None, float(rng.normal())) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    for how, limit in (("tree", 0.9), ("ridge", 0.9)):
        out = I.fit_chained(df, ["a", "b", "c"], how, key="id")(df).where("id % 4 = 0").agg(F.avg(F.abs(F.col("b") - 3 * F.col("a"))).alias("e")).first()
        assert out.e < limit


def test_synthetic_rows_lie_between_their_parents(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, 0, [float(x) for x in rng.normal(size=3)]) for i in range(20)], "id int, label int, v array<double>")
    pairs = B.interpolated_pairs(df, spark.createDataFrame([(0, 30)], "label int, quota int"), ["label"], "id", 9)
    made = B.materialize(pairs, df, "id", "v", ["label"], 9).collect()
    vectors = {r.id: r.v for r in df.collect()}
    assert len(made) == 30 and len({r.synthetic_id for r in made}) == 30
    for r in made:
        assert r.a != r.b and all(min(p, q) - 1e-9 <= x <= max(p, q) + 1e-9 for x, p, q in zip(r.v, vectors[r.a], vectors[r.b], strict=True))


def test_cell_states(spark):
    df = spark.createDataFrame([(1.0, 0, 1), (1.0, 1, 0), (None, 1, 1), (0.0, 1, 1), (2.0, 1, 1)], "v double, available int, observed int")
    got = [r.s for r in df.select(D.cell_state(F.col("v"), F.col("available") == 1, F.col("observed") == 1).alias("s")).collect()]
    assert got == ["unavailable", "structural", "missing", "zero", "observed"]


def test_pca_ignores_row_order(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6) * [5, 1, 1, 1, 1, 0.1]]) for i in range(64)]
    a, _ = X.channel_pca(spark.createDataFrame(rows, "i int, v array<double>"), "v", 2)
    b, _ = X.channel_pca(spark.createDataFrame(rows[::-1], "i int, v array<double>"), "v", 2)
    assert np.allclose(a, b, atol=1e-6)


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "id int, unit string, t timestamp, label string, n int")
    units = V.unit_table(rows, "unit", "t", "label", ["a"], "id")
    assert V.early_block(units, ["unit_start", "unit"], 0.6).count() == 0
    assert L.hash_order_sample(rows, "id", 5, 1).count() == 0
    assert T.allocate_blocks(units, ["unit_start", "unit"], "n", {"A": 0.5, "B": 0.5}).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else "b", float(v), float(w) if i % 5 else None) for i, (v, w) in enumerate(zip(np.round(rng.normal(size=700), 1), rng.random(700), strict=True))] + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    steps = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.k, r.feature): r.quantiles for r in quantiles(df, {"x": F.col("x"), "y": F.col("y")}, steps, ["k"]).collect()}
    for k in "abc":
        for j, c in ((1, "x"), (2, "y")):
            values = [r[j] for r in rows if r[0] == k and r[j] is not None]
            assert ((k, c) in got) == bool(values)
            assert not values or np.allclose(got[k, c], np.quantile(values, steps))
    assert np.allclose(quantiles(df, {"x": F.col("x")}, [0.5]).first().quantiles[0], np.median([r[1] for r in rows if r[1] is not None]))


def test_absent_classes_count_zero(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 1, 1), ("b", 1, 0)], "k string, y_true int, y_pred int")
    each = M.per_class(M.confusion(df, ["k"]), ["k"])
    got = {r.k: r for r in M.overall(each, ["k"]).collect()}
    assert round(got["a"].balanced_accuracy, 9) == round(2 / 3, 9) and got["a"].gmean == 0 and round(got["b"].balanced_accuracy, 9) == round(0.5 / 3, 9)
    assert {r.k: (r.mcc, r.kappa) for r in M.mcc_kappa(each, ["k"]).collect()} == {"a": (1.0, 1.0), "b": (0.0, 0.0)}


def test_composite_like_numpy(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 240)
    p = rng.dirichlet([1, 1, 1], 240) * 0.6 + 0.4 * np.eye(3)[y]
    p[:3] = [[1, 0, 0], [0, 1, 0], [0.2, 0.2, 0.6]]
    keys = ["bad" if i == 200 else "good" if i < 200 else "bad" for i in range(240)]
    p[200] = [0.5, 0.5, 0.5]
    rows = [(k, int(t), *map(float, q), float(i % 4 > 0)) for i, (k, t, q) in enumerate(zip(keys, y, p, strict=True))]
    df = spark.createDataFrame(rows, "k string, y_true int, p0 double, p1 double, p2 double, e double")
    train = {0: 50, 1: 30, 2: 20}
    got = {r.k: r for r in M.composite(df, ["k"], train, "e", 0.8).collect()}
    for k in ("good", "bad"):
        own = [i for i in range(240) if keys[i] == k]
        q = np.clip(p[own], 1e-12, 1 - 1e-12)
        q = q / q.sum(axis=1, keepdims=True)
        t, g = y[own], q.argmax(axis=1)
        m = np.zeros((3, 3))
        np.add.at(m, (t, g), 1)
        f1 = 2 * np.diag(m) / (m.sum(0) + m.sum(1))
        n, c = m.sum(), np.trace(m)
        chance = (m.sum(0) * m.sum(1)).sum()
        mcc = (c * n - chance) / np.sqrt((n * n - (m.sum(0) ** 2).sum()) * (n * n - (m.sum(1) ** 2).sum()))
        kappa = (c * n - chance) / (n * n - chance)
        perf = np.prod(np.clip([f1.mean(), (np.diag(m) / m.sum(1)).mean(), (mcc + 1) / 2, (kappa + 1) / 2], 1e-3, 1)) ** 0.25

        def jsd(a, b):
            a, b = (np.asarray(v, float) + 1e-12 for v in (a, b))
            a, b = a / a.sum(), b / b.sum()
            h = (a + b) / 2
            return (a * np.log2(a / h) + b * np.log2(b / h)).sum() / 2

        entropy = np.median(-(q * np.log(q)).sum(axis=1) / np.log(3))
        parts = [float(k == "good"), 1 - jsd(m.sum(0), m.sum(1)), 1 - min(abs(entropy - 0.5) / 0.5, 1), 1 - jsd(m.sum(0), [50, 30, 20]), np.mean([i % 4 > 0 for i in own]), 0.8]
        san = np.prod(np.clip(parts, 1e-3, 1)) ** (1 / 6)
        assert np.allclose([got[k].s_perf, got[k].s_san, got[k].composite], [perf, san, perf**0.6 * san**0.4])


def test_chained_equations_like_numpy(spark):
    """State, order and bounds of chained least squares; later rounds see what earlier ones filled."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=400)
    x = np.stack([a, 2 * a + rng.normal(size=400) * 0.3, a - rng.normal(size=400)], axis=1)
    gone = np.stack([rng.random(400) < 0.2, rng.random(400) < 0.4, np.zeros(400, bool)], axis=1)
    rows = [(i, *(None if g else float(v) for v, g in zip(r, m, strict=True))) for i, (r, m) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    seen = np.where(gone, np.nan, x)
    results = []
    for rounds in (1, 3):
        state = np.where(gone, np.nanmedian(seen, axis=0), x)
        for _ in range(rounds):
            for j in (0, 1):
                others = np.column_stack([state[:, [k for k in range(3) if k != j]], np.ones(400)])
                w = np.linalg.lstsq(others[~gone[:, j]], x[~gone[:, j], j], rcond=None)[0]
                state[gone[:, j], j] = np.clip(others[gone[:, j]] @ w, np.nanmin(seen[:, j]), np.nanmax(seen[:, j]))
        got = np.array([r[1:] for r in sorted(map(tuple, I.fit_chained(df, ["a", "b", "c"], "ridge", rounds, key="id")(df).select("id", "a", "b", "c").collect()))])
        assert np.allclose(got, state, atol=1e-5)
        results.append(got)
    assert np.abs(results[0] - results[1]).max() > 1e-3


def test_radius_pairs_and_masks(spark):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(40, 3))
    rows = [(i, i % 2, [float(x) for x in v[i]], int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>, here int, missing__v int")
    pairs = B.radius_pairs(df, spark.createDataFrame([(0, 50), (1, 0)], "label int, quota int"), "label", "id", "v", 0.8, 3)
    gap = ((v[:, None] - v[None]) ** 2).sum(axis=2) + np.where(np.arange(40)[:, None] % 2 == np.arange(40) % 2, 0, np.inf)
    np.fill_diagonal(gap, np.inf)
    made = pairs.collect()
    assert len(made) == 50 and all(0 <= r.ratio < 1 and r.label == 0 and r.fallback == (gap[r.a].min() > 0.64) for r in made)
    assert all(gap[r.a, r.b] <= 0.64 or (r.fallback and gap[r.a].argmin() == r.b) for r in made)
    for r in B.materialize(pairs, df, "id", "v", ["label"], 3, ("here",), ("missing__v",)).collect():
        a, b = rows[r.a], rows[r.b]
        assert r.here == (a[3] and b[3]) and r.missing__v == (a[4] or b[4])
    names = [("x_P1", "double"), ("x_P2", "double"), ("age", "int"), ("user_code", "int"), ("missing__x_P1", "int"), ("phase_available_P1", "int"), ("video_observed_mask_P1", "int"), ("label", "string"), ("y_P3", "float")]
    assert B.interpolated_columns(names, 2, 4, {"user_code"}) == ["x_P1", "x_P2", "age"]


def test_static_parity(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5), (3, 3.0, 6)], "id int, x double, y int")
    b = spark.createDataFrame([(1, 1.0, 4), (2, 2.5, 5), (4, 1.0, 1)], "id int, x double, y int")
    assert {r.feature: (r.compared, r.mismatches, r.one_side) for r in D.static_parity(a, b, "id", ["x", "y"]).collect()} == {"x": (2, 1, 2), "y": (2, 1, 2)}


def test_interval_match_over_months(spark):
    rng = np.random.default_rng(14)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=int(n))
    points = [(i, int(k), day(d)) for i, (k, d) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 900, 200), strict=True))]
    spans = [(int(k), day(s), day(s + w)) for k, s, w in zip(rng.integers(0, 3, 40), rng.integers(0, 800, 40), rng.integers(-5, 300, 40), strict=True)]
    got = T.interval_match(spark.createDataFrame(points, "id int, k int, t date"), spark.createDataFrame(spans, "k int, s date, e date"), "k", "t", "s", "e", ["id"])
    assert {r.id: r.matches for r in got.collect()} == {i: sum(k == q and s <= t <= e for q, s, e in spans) for i, k, t in points}
