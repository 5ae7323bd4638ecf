"""The quality model against a plain forward pass, text by text, and finite differences."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.quality import N_INPUTS, PASSAGE_BYTES, GatedAttention, fit_quality, passages, quality_scores, score_quality

from .conftest import prose


def plain_inputs(text):
    """A list of inputs for each passage of 600 bytes; words, A-Z lower-cased, belong to the passage in which they start."""
    data = text.encode() or b" "
    spans = [(m.start(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    parts = range(0, len(data), PASSAGE_BYTES)
    out = []
    for lo in parts:
        part = data[lo : lo + PASSAGE_BYTES]
        own = [(i, w) for i, (at, w) in enumerate(spans) if lo <= at < lo + PASSAGE_BYTES]
        some, n = max(len(own), 1), len(part)
        count = lambda low, high: sum(low <= b <= high for b in part)  # noqa: B023, E731
        upper, digits = count(65, 90), count(48, 57)
        letters = count(97, 122) + upper + count(128, 255)
        again = sum(i > 0 and spans[i - 1][1] == w for i, w in own)
        stats = [len({w for _, w in own}) / some, again / some, math.log1p(len(own)) / 5, n / some / 10, upper / max(letters, 1), digits / n, 1 - letters / n, math.log1p(len(parts)) / 5]
        out.append([math.sqrt(part.count(bytes([b])) / n) for b in range(256)] + stats)
    return out


def plain_score(model, text):
    p = {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    weights, encoded = [], []
    for x in plain_inputs(text):
        h = np.tanh((np.array(x) - model.mean) / model.scale @ p["E"] + p["e"])
        weights.append(math.exp(float(p["w"] @ (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])))))
        encoded.append(h)
    z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
    return float(sigmoid(z @ p["c"] + p["d"])[0])


def test_inputs():
    rng = random.Random(2)
    texts = ["", " ", "word", "word word", "word A1 word", "é" * 700, prose(rng, 400), "x" * 1300 + " x", "same " * 500, "\n\t ", "A" * 600, "A" * 601, prose(rng, 90) + " end", "end of"]
    got, first = passages([t.encode() for t in texts])
    assert got.shape[1] == N_INPUTS and len(first) == len(texts) + 1
    for i, t in enumerate(texts):
        assert np.allclose(got[first[i] : first[i + 1]], plain_inputs(t), atol=2e-6), t[:20]


def test_scores(spark, sf_dir, odd):
    """Every row's score, whatever rows stand beside it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels)
    for rows in (docs, odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, round(plain_score(model, r.text or ""), 3)) for r in rows.select("doc_id", "text").collect())
        for parts in (1, 7):
            got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in score_quality(rows.repartition(parts, F.xxhash64("text")), model).select("doc_id", "score").collect())
            assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 for a, b in zip(got, want, strict=True))
    first = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    again = {r.doc_id: r.score for r in quality_scores(docs.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(first[d] - again[d]) < 1e-5 for d in first)


def test_gradients():
    rng = np.random.default_rng(4)
    model = GatedAttention(inputs=5, hidden=4, gate=3, seed=1)
    model.p = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    x, first, y = rng.standard_normal((9, 5)), np.array([0, 2, 3, 7, 9]), np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        out = model.forward(x, first)[-1]
        return -float(np.mean(y * np.log(out) + (1 - y) * np.log(1 - out)))

    for k, g in model.step(x, first, y).items():
        for at in np.ndindex(model.p[k].shape):
            kept = model.p[k][at]
            model.p[k][at] = kept + 1e-5
            up = loss()
            model.p[k][at] = kept - 1e-5
            down = loss()
            model.p[k][at] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, (k, at)
