"""Dealing of units against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import splits as V

METRICS = {"n": 1.0, "n_a": 2.0, "n_b": 2.0}


def plain_deal(units, blocks, weights):
    """Units in order, each to the block after which all deviations are least; units: (name, sizes)."""
    k = len(weights)
    totals = [float(sum(u[1][m] for u in units)) for m in range(k)]
    targets, sums, out = [t / len(blocks) for t in totals], {b: [0.0] * k for b in blocks}, {}
    for name, sizes in units:
        scores = []
        for block in blocks:
            value = 0.0
            for other in blocks:
                for m in range(k):
                    off = (sums[other][m] + (float(sizes[m]) if other == block else 0.0) - targets[m]) / max(targets[m], 1.0)
                    value += weights[m] * off**2
            scores.append((value, block))
        out[name] = min(scores)[1]
        sums[out[name]] = [a + b for a, b in zip(sums[out[name]], sizes, strict=True)]
    return out


def made_units(count, seed=3):
    rng = np.random.default_rng(seed)
    n = rng.integers(5, 60, count)
    a = (n * rng.random(count) ** 3 * 0.4).astype(int)
    return [(f"u{i}", 1 + i % 2, int(x), int(y), int(max(x - 2 * y, 0) // 3)) for i, (x, y) in enumerate(zip(n, a, strict=True))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("count", [50, 5000])
def test_units_go_the_same_way_at_every_size(spark, count):
    rows = made_units(count)
    df = spark.createDataFrame(rows, "unit string, s int, n int, n_a int, n_b int")
    totals = [max(sum(r[k] for r in rows), 1) for k in (3, 4)]
    order = sorted(rows, key=lambda r: (-(r[3] / totals[0] + r[4] / totals[1]), -r[2], sha(r[0])))
    got = {r.unit: r.block for r in V.allocate_units(df.repartition(6), "unit", METRICS, list("BCDEFG")).collect()}
    assert got == plain_deal([(r[0], r[2:]) for r in order], list("BCDEFG"), [1.0, 2.0, 2.0])


@pytest.mark.parametrize("strategy", ["balanced", "rarest_first"])
def test_pairs_of_blocks(spark, strategy):
    rows = made_units(300)
    df = spark.createDataFrame(rows, "unit string, s int, n int, n_a int, n_b int")
    got = {r.unit: r.block for r in V.balanced_deal(df.repartition(5), "s", "unit", METRICS, {1: ["B", "C"], 2: ["D", "E"]}, 42, strategy).collect()}
    want = {}
    for s, blocks in ((1, ["B", "C"]), (2, ["D", "E"])):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], sha(f"42|{r[0]}")))
        totals = [sum(r[k] for r in own) for k in (2, 3, 4)]
        rare = [1.0, *(totals[0] / max(t, 1) for t in totals[1:])] if strategy == "rarest_first" else [1.0] * 3
        want |= plain_deal([(r[0], r[2:]) for r in own], blocks, [w * x for w, x in zip([1.0, 2.0, 2.0], rare, strict=True)])
    assert got == want


def test_dealing_refuses(spark):
    df = spark.createDataFrame(made_units(4), "unit string, s int, n int, n_a int, n_b int")
    with pytest.raises(ValueError, match="blocks without units"):
        V.allocate_units(df, "unit", METRICS, list("BCDEFG"))
    with pytest.raises(ValueError, match="unknown strategy"):
        V.balanced_deal(df, "s", "unit", METRICS, {1: ["B"], 2: ["C"]}, 42, "other")
    assert V.balanced_deal(df.where(F.lit(False)), "s", "unit", METRICS, {1: ["B"]}, 42).count() == 0
