"""Probes against a plain fit in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M


def plain_fit(x, y, weights, classes, penalty=1.0):
    """Softmax regression by Newton steps on the summed loss plus half the squared weights; intercepts are free."""
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    w, target = np.zeros((d + 1, classes)), np.eye(classes)[y]
    ridge = np.diag([penalty] * d + [1e-9])
    for _ in range(60):
        p = np.exp(z @ w - (z @ w).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = z.T @ (weights[:, None] * (p - target)) + ridge @ w
        hess = np.zeros((w.size, w.size))
        for a in range(classes):
            for b in range(classes):
                block = z.T @ (z * (weights * (p[:, a] * ((a == b) - p[:, b])))[:, None])
                hess[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] = block + (ridge if a == b else 0)
        w -= (np.linalg.lstsq(hess, grad.T.ravel(), rcond=None)[0]).reshape(classes, d + 1).T
    return lambda q: np.exp(np.hstack([q, np.ones((len(q), 1))]) @ w)


def auc(score, positive):
    a, b = score[positive], score[~positive]
    return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) if len(a) and len(b) else None


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = (rng.random((900, 4)) < 0.3).astype(int)
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 0.8, 900) > 0.9).astype(int) + (x[:, 2] > 0).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frames(spark, data):
    x, y = data
    rows = [(int(i), *map(int, a), int(c), "ab"[i % 2] if i % 30 else "few") for i, (a, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, f0 int, f1 int, f2 int, f3 int, y int, slice string")
    return df.where("id < 600"), df.where("id >= 600")


FLAGS = ["f0", "f1", "f2", "f3"]


@pytest.mark.parametrize("weighted", [False, True])
def test_probe_like_numpy(data, frames, weighted):
    x, y = data
    mean, std = x[:600].mean(axis=0), x[:600].std(axis=0, ddof=1)
    counts = np.bincount(y[:600])
    weights = (600 / (3 * counts))[y[:600]] if weighted else np.ones(600)
    want = plain_fit((x[:600] - mean) / std, y[:600], weights, 3)((x[600:] - mean) / std)
    want /= want.sum(axis=1, keepdims=True)
    got = {r.id: (r.p0, r.p1, r.p2, r.argmax) for r in M.probe(*frames, FLAGS, "y", weighted).collect()}
    for i in range(300):
        assert np.allclose(got[600 + i][:3], want[i], atol=2e-4) and (got[600 + i][3] == want[i].argmax() or np.sort(want[i])[-2] > want[i].max() - 1e-3)


def test_leak_probe(data, frames):
    """Macro AUC of each slice; a slice without all classes has none; the same again from other partitions."""
    x, y = data
    train, held = frames
    scored = {r.id: (r.p0, r.p1, r.p2) for r in M.probe(train, held, FLAGS, "y").collect()}
    got = {r.slice: r for r in M.leak_probe(train, held.where("slice <> 'few' or y = 0"), FLAGS, "y", ["slice"]).collect()}
    for s, k in (("a", 0), ("b", 1)):
        ids = [i for i in range(600, 900) if i % 30 and i % 2 == k]
        p = np.array([scored[i] for i in ids])
        want = np.mean([auc(p[:, c], y[ids] == c) for c in range(3)])
        assert abs(got[s].auc - want) < 1e-9 and abs(got[s].leak_free - (1 - 2 * max(want - 0.5, 0))) < 1e-9 and got[s].leak_free < 0.6
    assert got["few"].auc is None and got["few"].leak_free is None
    again = {r.slice: r.auc for r in M.leak_probe(train.repartition(1), held.repartition(3), FLAGS, "y", ["slice"]).collect()}
    assert abs(again["a"] - got["a"].auc) < 1e-6


def test_composite_takes_the_probe(frames):
    train, held = frames
    rows = M.probe(train, held, FLAGS, "y").withColumnRenamed("y", "y_true")
    leak = M.leak_probe(train, held, FLAGS, "y", ["slice"])
    with_, without = ({r.slice: r for r in M.composite(rows, ["slice"], leak_free=x).collect()} for x in (leak.where("slice <> 'b'"), None))
    told = {r.slice: r.leak_free for r in leak.collect()}
    assert abs(with_["a"].s_leak - told["a"]) < 1e-12 and with_["b"].s_leak == 1 == without["a"].s_leak
    assert abs(with_["a"].s_san / without["a"].s_san - told["a"] ** (1 / 6)) < 1e-9 and with_["a"].composite < without["a"].composite


def test_static_probe_tells_what_transfers(spark):
    """A column that goes with the class in training and the other way round in one slice: good in one, bad in the other."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        c, part = int(rng.integers(0, 3)), ("train", "same", "flipped")[i % 3]
        mark = (c if part != "flipped" else 2 - c) + rng.normal(0, 0.3)
        rows.append((i, part, float(mark), float(rng.normal()), c))
    df = spark.createDataFrame(rows, "id int, slice string, mark double, noise double, y int")
    facts = {(r.features, r.arm, r.slice): r for r in M.static_probe(df.where("slice = 'train'"), df.where("slice <> 'train'"), {"mark": ["mark"], "noise": ["noise"]}, "y", ["slice"]).collect()}
    assert len(facts) == 8
    assert facts["mark", "balanced", "same"].balanced_accuracy > 0.85 > 0.5 > facts["mark", "balanced", "flipped"].balanced_accuracy
    assert all(abs(facts["noise", a, "same"].balanced_accuracy - 1 / 3) < 0.12 for a in ("plain", "balanced"))
    assert all(r.macro_f1 <= r.macro_f1_present + 1e-12 for r in facts.values())


def test_probe_without_classes(frames):
    train, held = frames
    one = M.probe(train.where("y = 1"), held, FLAGS, "y").agg(F.min("p1"), F.max("p0"), F.max("argmax")).first()
    assert tuple(one) == (1.0, 0.0, 1)
    two = M.probe(train.where("y < 2"), held, FLAGS, "y").agg(F.max("p2"), F.max("argmax")).first()
    assert two[0] == 0.0 and two[1] == 1
