"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (byte histogram and a few word statistics, then a learned
layer), gated attention gives it a weight, and the weighted sum is scored. Encoder, attention and scorer are learned
together from document labels alone, on a bounded sample of labelled rows; scoring is one pass over all documents.

Null and empty texts are one empty passage and get a score like any other. Null or missing labels are not used;
several labels of one document are averaged. Repeated identifiers give one row per input row. If the sample holds
fewer than two labels, as with an empty table, every score is the sample's mean (0.5 without any). Identifier,
language, source and labels are never inputs of a score. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import chunks, word_hashes
from .common import spill, text_of, without

PASSAGE_BYTES = 600
N_INPUTS = 256 + 8


def held_out(doc_id):
    """Rows never used in fitting: crc32 of the identifier's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all passages, and each text's first passage (one more entry at the end)."""
    out, counts = [], []
    for a, b in chunks(texts, 1 << 20):
        part = [t if t else b" " for t in texts[a:b]]
        sizes = np.array([len(t) for t in part])
        n = -(-sizes // PASSAGE_BYTES)
        counts.append(n)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        which = np.repeat(np.arange(len(part)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo = starts[which] + nth * PASSAGE_BYTES
        hi = np.minimum(lo + PASSAGE_BYTES, (ends - 1)[which])
        data = np.frombuffer(b"\n".join([*part, b""]), dtype=np.uint8)
        row = np.repeat(np.arange(len(lo)), hi - lo)
        keep = np.ones(len(data), dtype=bool)
        keep[ends - 1] = False
        counted = np.bincount(row * 256 + data[keep], minlength=len(lo) * 256).reshape(-1, 256).astype(np.float32)
        length = (hi - lo).astype(np.float32)
        words, _ = word_hashes(part)
        blank = np.isin(data, (32, 9, 10, 11, 12, 13))
        first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        place = np.searchsorted(lo, first, "right") - 1
        total = np.bincount(place, minlength=len(lo)).astype(np.float32)
        distinct = np.bincount(_distinct(place, words), minlength=len(lo)).astype(np.float32)
        again = (words[1:] == words[:-1]) & (which[place[1:]] == which[place[:-1]])  # of the same text
        same = np.bincount(place[1:], weights=again, minlength=len(lo)).astype(np.float32) if len(words) > 1 else np.zeros(len(lo), np.float32)
        upper, digit = counted[:, 65:91].sum(axis=1), counted[:, 48:58].sum(axis=1)
        letters = counted[:, 97:123].sum(axis=1) + upper + counted[:, 128:].sum(axis=1)
        some = np.maximum(total, 1)
        stats = np.stack([distinct / some, same / some, np.log1p(total) / 5, length / some / 10, upper / np.maximum(letters, 1), digit / length, 1 - letters / length, np.log1p(np.repeat(n, n)) / 5], axis=1)
        out.append(np.concatenate([np.sqrt(counted / length[:, None]), stats], axis=1).astype(np.float32))
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, dtype=np.int64)
    return (np.concatenate(out) if out else np.zeros((0, N_INPUTS), np.float32)), first


def _distinct(place: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The passage of each distinct (passage, word)."""
    by = np.lexsort((words, place))
    p, w = place[by], words[by]
    return p[np.append(True, (p[1:] != p[:-1]) | (w[1:] != w[:-1]))[: len(p)]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """h = tanh(xE + e); attention = softmax(w . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum(attention h) + d)."""

    def __init__(self, inputs: int = N_INPUTS, hidden: int = 32, gate: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": draw(inputs, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(inputs, np.float32), np.ones(inputs, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, starts, sizes = self.p, first[:-1], np.diff(first)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        raw = (t * s) @ p["w"]
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, s, a, z, sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, first)[-1]

    def step(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of a batch of bags."""
        p, starts, sizes = self.p, first[:-1], np.diff(first)
        h, t, s, a, z, out = self.forward(x, first)
        dz = ((out - y) / len(y))[:, None]
        g = {"c": (z * dz).sum(axis=0), "d": dz.sum(axis=0)}
        dbag = np.repeat(dz * p["c"], sizes, axis=0)
        da = (dbag * h).sum(axis=1)
        draw = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        g["w"] = (t * s).T @ draw
        dg = draw[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dbag + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["E"], g["e"] = x.T @ dh, dh.sum(axis=0)
        return g

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> GatedAttention:
        """Adam on shuffled batches of bags."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + np.float32(0.02)
        x = (x - self.mean) / self.scale
        rng, n = np.random.default_rng(seed), len(y)
        m, v, k = {q: np.zeros_like(t) for q, t in self.p.items()}, {q: np.zeros_like(t) for q, t in self.p.items()}, 0
        for _ in range(max(epochs, min(400, 30_000 // max(n, 1)))):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                bags = order[at : at + batch]
                sizes = first[bags + 1] - first[bags]
                own = np.concatenate(([0], np.cumsum(sizes)))
                rows = np.arange(own[-1]) + np.repeat(first[bags] - own[:-1], sizes)
                k += 1
                for q, g in self.step(x[rows], own, y[bags]).items():
                    g = g + np.float32(decay) * self.p[q]
                    m[q], v[q] = 0.9 * m[q] + 0.1 * g, 0.999 * v[q] + 0.001 * g * g
                    self.p[q] = (self.p[q] - rate * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return self


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """doc_id, label, bag (float32 inputs, all passages) of at most ``sample`` labelled identifiers, drawn by hash.

    Rows that repeat an identifier give one bag, that of the smallest of their texts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))  # bounded by the sample
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a, b in chunks(texts := _bytes(x["text"]), 1 << 22):
                inputs, first = passages(texts[a:b])
                bags = [inputs[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
                yield pd.DataFrame({"doc_id": x["doc_id"][a:b], "label": x["label"][a:b], "bag": bags})

    return rows.mapInPandas(run, "doc_id long, label int, bag binary")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6_000):
    """A model, or a constant score where the labels do not allow one."""
    bags = spill(training_sample(docs, labels, id_col, text_col, label_col, sample), "quality-bags")
    x = bags.toPandas().sort_values(["doc_id", "label", "bag"])  # bounded by the sample: under two bytes for each byte of its texts
    if x["label"].nunique() < 2:
        return float(x["label"].mean()) if len(x) else 0.5
    each = [np.frombuffer(b, dtype=np.float32).reshape(-1, N_INPUTS) for b in x["bag"]]
    first = np.concatenate(([0], np.cumsum([len(b) for b in each])))
    return GatedAttention().fit(np.concatenate(each), first, x["label"].to_numpy().astype(np.float32))


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", also_text_hash: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (and th, a hash of the text): one row for each row of ``docs``."""
    names = ["doc_id", "held_out", "th"] if also_text_hash else ["doc_id", "held_out"]

    def scores_of(texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), model) if isinstance(model, float) else model.score(*passages(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = x.column(len(names)).cast(pa.binary())
            for k in range(0, x.num_rows, 500):  # few texts at once as Python objects
                texts = [t.as_py() for t in text[k : k + 500]]
                scores = np.concatenate([scores_of(texts[a:b]) for a, b in chunks(texts, 1 << 21)]).astype(np.float64)
                own = [x.column(i)[k : k + 500] for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    own = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.xxhash64(own).alias("th"), own.alias("text")).select(*names, "text")
    hashed = "th long, " if also_text_hash else ""
    return texts.mapInArrow(run, f"doc_id long, held_out boolean, {hashed}score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, id_col, text_col, label_col), id_col, text_col)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    Rows that go are named by identifier and text, so that rows that share an identifier are judged one by one.
    """
    model = fit_quality(docs, labels, id_col, text_col)
    own = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), own.alias("text"))
    scored = score_quality(keyed, model, also_text_hash=True).where("predicted = 0")
    bad = spill(scored.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct(), "quality-rejects")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(own) == F.col("__th"))
    return without(docs, bad, F.col(id_col).cast("long"), "__id", same)
