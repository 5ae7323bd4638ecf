"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap. Each candidate is labelled by a check of its kind that is
no input of the model: check digits of cards and bank accounts, valid ranges of addresses, phone and identity numbers,
known top-level domains. Boosted trees, fitted on a bounded sample stratified by kind, learn from format and context
which candidates pass. Candidates of added kinds that overlap a base span are left out. All others are scored; a histogram of all scores of the added kinds gives each kind's
threshold, the lowest score above which the share that passes reaches ``precision``. A kind's share is smoothed by that
of all added kinds at the same score, so that a rare kind follows the others instead of being dropped.
Base spans always stay. Candidates of base kinds that are no base spans failed their check; they serve in fitting and are
never added. Of added spans that overlap a base span or each other, base spans and then higher scores win.

Null and empty texts have no spans. Repeated identifiers give one row per input row. With too few candidates of either
label, as in an empty table, no model is fitted and only base spans are returned. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill, text_of

#: Kinds of the contract in their order, then the kinds that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("spelled_email", "local_phone", "iban", "id_number", "ip6", "card_like")
KINDS = (*BASE_KINDS, *MORE_KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind and possessive repeat keep a long run of digits linear; no match can start inside such a run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GENERATORS = {
    "spelled_email": re.compile(r"\b\w{1,64}\s?[\[(]?\s?(?:at|AT)\s?[\])]?\s?\w{1,64}\s?[\[(]?\s?(?:dot|DOT)\s?[\])]?\s?[a-z]{2,10}\b"),
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    "id_number": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "ip6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card_like": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])"),
}
CUES = {
    "email": ("mail", "contact"), "spelled_email": ("mail", "contact", "write"), "phone": ("tel", "phone", "call", "fax", "mobile"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile"), "card": ("card", "visa", "credit", "payment"), "card_like": ("card", "visa", "credit", "payment"),
    "iban": ("iban", "account", "bank"), "id_number": ("ssn", "social", "security", "id"), "ip": ("ip", "host", "server", "address"), "ip6": ("ip", "host", "server", "address"),
}
#: Top-level domains that a spelled address may end in.
DOMAINS = frozenset("com org net edu gov info io de fr es it nl uk eu ch at be pl se us ca au co".split())
BINS = 200


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, by the places of ``@``, which a local part never holds: linear in any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def mod97(code: str) -> bool:
    code = re.sub(r"\s", "", code)
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def passes(kind: str, span: str) -> bool:
    """The check of a candidate of an added kind; its result is never an input of the model."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "card_like":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "iban":
        return mod97(span)
    if kind == "id_number":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "local_phone":
        return digits[0] > "1" and digits[3] > "1"
    if kind == "ip6":
        return span.count(":") == 7
    return span.split()[-1].lower() in DOMAINS or re.split("(?i)dot", span)[-1].strip(" )]").lower() in DOMAINS


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, whether it passes) of all matches of the base formats."""
    out = []
    if "@" in text:
        out += [(a, b, 0, True) for a, b in emails(text)]
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            out.append((m.start(), m.end(), 1, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if len(digits) >= 9:
                out.append((m.start(), m.end(), 2, 14 <= len(digits) <= 19 and luhn(digits)))
        for m in PHONE.finditer(text):
            out.append((m.start(), m.end(), 3, 10 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    """Format and context of a candidate; never the result of a check."""
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    runs = re.findall("[0-9]+", span)
    out = [float(kind == k) for k in range(len(KINDS))]
    out += [
        float(end - start), float(sum(map(len, runs))), float(sum(c.isalpha() for c in span)), float(len(re.findall(r"[\x20.-]", span))), float(len(set(span))),
        float(any(cue in before for cue in CUES[KINDS[kind]])), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ":=\"'<("),
        float(ord(span[0])), float(sum(c.isdigit() for c in before + after)), float(max(map(len, runs), default=0)), float(len(runs)),
    ]
    return out


class Taken:
    """Disjoint intervals; tells in logarithmic time whether another one is free."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):  # base spans of different kinds may overlap: joined
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return not at or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> bool:
        if not self.free(a, b):
            return False
        at = bisect_left(self.starts, b)
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Base spans (start, kind number, end), and candidates (start, kind number, end, label, features)."""
    matches = base_matches(text)
    base = sorted((a, k, b) for a, b, k, ok in matches if ok)
    candidates = [(a, k, b, int(ok), features(text, a, b, k)) for a, b, k, ok in matches]
    taken = Taken([(a, b) for a, _, b in base])  # what overlaps a base span cannot be added, so it is no candidate
    digit = bool(re.search("[0-9]", text))
    for number, kind in enumerate(MORE_KINDS, len(BASE_KINDS)):
        if not (digit if kind != "spelled_email" else re.search("(?i)dot", text)):
            continue
        for m in GENERATORS[kind].finditer(text):
            if taken.free(m.start(), m.end()):
                candidates.append((m.start(), number, m.end(), int(passes(kind, m[0])), features(text, m.start(), m.end(), number)))
    return base, candidates


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


COUNTS = tuple(f"n_{k}" for k in BASE_KINDS)
RESULT = f"doc_id string, {', '.join(f'{c} long' for c in COUNTS)}, base_sha256 string, spans string"
FOUND = "array<struct<start: int, kind: int, end: int, label: int, features: array<float>>>"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, counts, base_sha256, spans (base only), base (spans), found (candidates): one row for each row of ``docs``.

    base is only given where candidates of added kinds need it.
    """

    def one(doc_id: str, text: str) -> tuple:
        base, found = scan(text)
        spans = written(base)
        counts = [sum(k == kind for _, k, _ in base) for kind in range(len(BASE_KINDS))]
        more = any(k >= len(BASE_KINDS) for _, k, _, _, _ in found)
        return (
            doc_id, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans, [{"start": a, "kind": k, "end": b} for a, k, b in base] if more else [],
            [{"start": a, "kind": k, "end": b, "label": y, "features": f} for a, k, b, y, f in found], more,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [one(d, t) for d, t in zip(x["doc_id"], x["text"], strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", *COUNTS, "base_sha256", "spans", "base", "found", "more"])

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))  # as text, null and large ids stay exact in pandas
    return texts.mapInPandas(run, f"{RESULT}, base array<struct<start: int, kind: int, end: int>>, found {FOUND}, more boolean")


def tree_arrays(node) -> list[tuple[int, float, int, int, float]]:
    """(feature, threshold, left, right, value) of a fitted tree's nodes; feature -1 marks a leaf."""
    out: list[list] = []

    def add(n) -> int:
        at = len(out)
        out.append([-1, 0.0, 0, 0, n.prediction()])
        if n.subtreeDepth() > 0:
            out[at][:4] = n.split().featureIndex(), n.split().threshold(), add(n.leftChild()), add(n.rightChild())
        return at

    add(node)
    return [tuple(x) for x in out]


class Boosted:
    """Fitted trees as plain arrays."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        self.trees, self.weights = [np.array(t) for t in trees], weights

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := tree[at, 0] >= 0).any():
                rows = np.flatnonzero(inner)
                n = tree[at[rows]]
                at[rows] = np.where(x[rows, n[:, 0].astype(np.int64)] <= n[:, 1], n[:, 2], n[:, 3]).astype(np.int64)
            margin += weight * tree[at, 4]
        return 1 / (1 + np.exp(-2 * margin))


def thresholds(histogram: np.ndarray, precision: float, strength: float = 10.0) -> np.ndarray:
    """Least bin of each kind above which the share that passes reaches ``precision``; BINS where none does.

    histogram: kinds x bins x (failed, passed) of all candidates. Shares are smoothed by ``strength`` candidates at the
    share of all kinds together above the same bin.
    """
    above = histogram[:, ::-1].cumsum(axis=1)[:, ::-1].astype(np.float64)
    n, good = above.sum(axis=2), above[:, :, 1]
    pooled = good.sum(axis=0) / np.maximum(n.sum(axis=0), 1)
    share = (good + strength * pooled) / (n + strength)
    ok = share >= precision
    return np.where(ok.any(axis=1), ok.argmax(axis=1), BINS)


def fit(found: DataFrame, sample: int, rounds: int, depth: int) -> Boosted | None:
    """Trees on about ``sample`` candidates at most, drawn by hash, as many of each kind as there are up to an equal part."""
    each = found.select("doc_id", F.explode("found").alias("x"))
    each = each.select(F.pmod(F.xxhash64("doc_id", "x.start", "x.kind"), F.lit(1 << 30)).alias("h"), F.col("x.kind").alias("kind"), F.col("x.label").cast("double").alias("label"), F.col("x.features").alias("features"))
    sizes = {r["kind"]: r["n"] for r in each.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a kind
    part = sample / len(KINDS)
    drawn_share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, part / n)))) if sizes else F.create_map(F.lit(0), F.lit(1.0))
    drawn = spill(each.where(F.col("h") < drawn_share[F.col("kind")] * (1 << 30)), "pii-sample")
    counts = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 10:
        return None
    model = GBTClassifier(labelCol="label", featuresCol="v", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(drawn.withColumn("v", array_to_vector(F.col("features").cast("array<double>"))))
    return Boosted([tree_arrays(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def scored(found: DataFrame, model: Boosted) -> DataFrame:
    """Rows with candidates of added kinds: doc_id, counts, base_sha256, spans, base, more (start, kind, end, label, score)."""
    names = ["doc_id", *COUNTS, "base_sha256", "spans", "base"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own = [[s for s in found if s["kind"] >= len(BASE_KINDS)] for found in x["found"]]
            flat = [s["features"] for found in own for s in found]
            scores = iter(model.score(np.array(flat, dtype=np.float64)) if flat else ())
            yield x[names].assign(more=[[{"start": s["start"], "kind": s["kind"], "end": s["end"], "label": s["label"], "score": float(next(scores))} for s in found] for found in own])

    schema = f"{RESULT}, base array<struct<start: int, kind: int, end: int>>, more array<struct<start: int, kind: int, end: int, label: int, score: double>>"
    return found.where("more").select(*names, "found").mapInPandas(run, schema)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, precision: float = 0.9, rounds: int = 8, depth: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row for each row of ``docs``."""
    found = spill(candidates(docs, id_col, text_col), "pii-candidates")
    model = fit(found, sample, rounds, depth)
    names = ["doc_id", *COUNTS, "base_sha256", "spans"]
    plain = found.select(*names, F.lit(0).cast("long").alias("n_added"), "more")
    if model is None:
        return plain.drop("more").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = spill(scored(found, model), "pii-scores")
    bin_ = F.least(F.floor(F.col("x.score") * BINS), F.lit(BINS - 1)).cast("int")
    each = rows.select(F.explode("more").alias("x")).groupBy(F.col("x.kind").alias("kind"), bin_.alias("bin"), F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros((len(KINDS), BINS, 2), dtype=np.int64)
    for r in each.collect():  # at most kinds x bins x 2 rows
        histogram[r["kind"], r["bin"], r["label"]] = r["n"]
    least = thresholds(histogram, precision)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            spans, added = [], []
            for base, more in zip(x["base"], x["more"], strict=True):
                kept = [(s["start"], s["kind"], s["end"]) for s in base]
                taken, n = Taken([(a, b) for a, _, b in kept]), len(kept)
                for s in sorted(more, key=lambda s: (-s["score"], s["start"], s["kind"], s["end"])):
                    if min(int(s["score"] * BINS), BINS - 1) >= least[s["kind"]] and taken.add(s["start"], s["end"]):
                        kept.append((s["start"], s["kind"], s["end"]))
                spans.append(written(kept))
                added.append(len(kept) - n)
            yield x[["doc_id", *COUNTS, "base_sha256"]].assign(spans=spans, n_added=added)[[*names, "n_added"]]

    more = rows.mapInPandas(run, f"{RESULT}, n_added long")
    return plain.where("not more").drop("more").unionByName(more).withColumn("doc_id", F.col("doc_id").cast("long"))
