"""SentencePiece encoding and decoding over a lattice of pieces.

A text is escaped, cut into units that no piece can cross (before each run of spaces, around line ends), and each
distinct unit is encoded once per task. Two ways share the same piece table and give the same ids:

* ``unit_ids``: inside a task; a unit's substrings up to the longest piece are looked up, which gives its lattice, and
  a fold over the lattice gives the ids. Unigram models fold by Viterbi (best sum of scores); BPE models fold by
  merging the best-scored neighbouring edges, because the best sum is not what such a model means by its scores.
* ``lattice_ids``: the same as a relation: substrings are exploded, equi-joined to the piece table, grouped by word,
  and folded with ``aggregate``. It needs a row per substring of every distinct word, and a join back to documents;
  see the README for its figures.

Null and empty texts have no ids. A literal U+2581 is read back as a space, as the format has it. Very long units use
a heap, so time stays near linear. Repeated identifiers give one row per input row. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNITS = re.compile(f"[\n\t]|{SPACE}*[^{SPACE}\n\t]+|{SPACE}+")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass(frozen=True)
class Pieces:
    """The piece table: (piece, score) of each id, and how the model folds."""

    kind: int
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    unknown: int
    written: tuple[bytes, ...]
    longest: int
    prefix: bool
    name: str


def read_pieces(model_path: str = DEFAULT_MODEL) -> Pieces:
    """Read a model file on the driver; its size is the vocabulary's, whatever the corpus."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    table = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
    if any(SPACE in p.lstrip(SPACE) or (len(p) > 1 and ("\n" in p or "\t" in p)) for p in table):
        raise ValueError("a piece crosses the units this codec cuts")
    bytes_ = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
    written = tuple(
        bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" for p in model.pieces
    )
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
    byte_ids = tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else ()
    scores, ids = {t: s for t, (s, _) in table.items()}, {t: i for t, (_, i) in table.items()}
    name = hashlib.sha256(model.SerializeToString()).hexdigest()
    return Pieces(model.trainer_spec.model_type, scores, ids, byte_ids, unknown, written, max(map(len, table)), model.normalizer_spec.add_dummy_prefix, name)


def piece_or_bytes(symbol: str, p: Pieces) -> list[int]:
    known = p.ids.get(symbol)
    if known is not None:
        return [known]
    return [p.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")] if p.byte_ids else [p.unknown]


NONE = float("-inf")


def merged(unit: str, p: Pieces) -> list[int]:
    """BPE fold: merge the neighbouring edges whose union has the best score, leftmost first, until none has one."""
    if len(unit) > 64:
        return heap_merged(unit, p)
    symbols, score = list(unit), p.scores.get
    scores = [score(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
    while scores and (best := max(scores)) != NONE:
        at = scores.index(best)
        symbols[at] += symbols.pop(at + 1)
        del scores[at]
        if at:
            scores[at - 1] = score(symbols[at - 1] + symbols[at], NONE)
        if at < len(scores):
            scores[at] = score(symbols[at] + symbols[at + 1], NONE)
    ids = list(map(p.ids.get, symbols))
    return [i for s in symbols for i in piece_or_bytes(s, p)] if None in ids else ids


def heap_merged(unit: str, p: Pieces) -> list[int]:
    """The same fold for long units, with a heap of candidate merges."""
    symbols: list[str | None] = list(unit)
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (known := p.scores.get(symbols[i] + symbols[j])) is not None:
            heapq.heappush(heap, (-known, i, j, symbols[i] + symbols[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, text = heapq.heappop(heap)
        if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != text:
            continue
        symbols[i], symbols[j] = text, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [i for s in symbols if s is not None for i in piece_or_bytes(s, p)]


def viterbi(unit: str, p: Pieces) -> list[int]:
    """Unigram fold: the path of edges with the best sum of scores; characters without a piece cost a fixed penalty."""
    penalty = min(p.scores.values()) - 10
    best: list[tuple[float, int]] = [(0.0, -1)]
    for end in range(1, len(unit) + 1):
        options = [(best[start][0] + p.scores[unit[start:end]], start) for start in range(max(0, end - p.longest), end) if unit[start:end] in p.scores]
        if unit[end - 1] not in p.scores:
            options.append((best[end - 1][0] + penalty, end - 1))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    cuts = [len(unit)]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    cuts.reverse()
    return [i for a, b in zip(cuts, cuts[1:]) for i in piece_or_bytes(unit[a:b], p)]


def unit_ids(unit: str, p: Pieces) -> list[int]:
    return merged(unit, p) if p.kind == BPE else viterbi(unit, p)


class Codec:
    """Encodes and decodes texts; remembers at most twice ``remembered`` units, the recent ones longest."""

    def __init__(self, pieces: Pieces, remembered: int = 1 << 18):
        self.pieces, self.remembered = pieces, remembered
        self.known: dict[str, array] = {}
        self.older: dict[str, array] = {}

    def of_unit(self, unit: str) -> array:
        ids = self.older.get(unit)
        if ids is None:
            ids = array("i", unit_ids(unit, self.pieces))
        if len(self.known) >= self.remembered:
            self.known, self.older = {}, self.known
        if len(unit) <= 64:
            self.known[unit] = ids
        return ids

    def encode(self, text: str) -> array:
        escaped = text.replace(" ", SPACE)
        out, known = array("i"), self.known
        for unit in UNITS.findall(SPACE + escaped if self.pieces.prefix and text else escaped):
            ids = known.get(unit)
            if ids is None:
                ids, known = self.of_unit(unit), self.known
            out += ids
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.pieces.written.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.pieces.prefix and raw.startswith(" ") else raw


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids (array<int>): one row for each row of ``docs``."""
    pieces = read_pieces(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(pieces)  # remembers units for this task only, so that an idle worker holds none
        for x in batches:
            for k in range(0, len(x), 500):
                y = x.iloc[k : k + 500]
                yield pd.DataFrame({"doc_id": y["doc_id"], "ids": [codec.encode(t).tolist() for t in y["text"]]})

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInPandas(run, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, text of a table with doc_id, ids; null ids give an empty text."""
    pieces = read_pieces(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(pieces)  # remembers units for this task only, so that an idle worker holds none
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "text": [codec.decode(i) if i is not None else "" for i in x["ids"]]})

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return rows.mapInPandas(run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, text_sha256, exact: each text encoded, decoded again and compared, in one pass.

    ids_sha256: of the ids as little-endian 32-bit integers; text_sha256: of the decoded text in UTF-8.
    """
    pieces = read_pieces(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(pieces)  # remembers units for this task only, so that an idle worker holds none
        for x in batches:
            out = []
            for text in x["text"]:
                ids = codec.encode(text)
                back = codec.decode(ids)
                out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "text_sha256", "exact"]).assign(doc_id=x["doc_id"].to_numpy())[["doc_id", "n_tokens", "ids_sha256", "text_sha256", "exact"]]

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    rows = texts.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, text_sha256 string, exact boolean")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(t, s, i) for t, s in pieces.scores.items() for i in (pieces.ids[t],)], "piece string, score double, id int")


def lattice_ids(words: DataFrame, pieces: DataFrame, longest: int, kind: int = BPE) -> DataFrame:
    """word, path (array of pieces): substrings exploded, equi-joined to the piece table, grouped and folded in Spark.

    words: distinct escaped units in ``word``. A character without a piece is an edge of its own.
    """
    n = F.length("word")
    spans = F.expr(f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(i, least(length(word), i + {longest - 1})), j -> struct(i as s, j + 1 as e))))")
    edges = words.repartition("word").where(n > 0).select("word", F.explode(spans).alias("x")).select("word", "x.s", "x.e", F.expr("substring(word, x.s, x.e - x.s)").alias("piece"))
    edges = edges.join(F.broadcast(pieces), "piece", "left").where("score is not null or e = s + 1")  # as large as the vocabulary
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "score")).alias("edges"))
    if kind == BPE:
        better = """
          aggregate(sequence(1, length(word)), sequence(1, length(word) + 1), (cut, k) -> coalesce(
            array_except(cut, array(
              aggregate(edges, struct(cast(null as double) as score, 0 as s, 0 as mid),
                (best, x) -> if(x.score is not null and (best.score is null or x.score > best.score or (x.score = best.score and x.s < best.s))
                    and array_contains(cut, x.s) and array_contains(cut, x.e) and size(filter(cut, c -> c > x.s and c < x.e)) = 1,
                  struct(x.score as score, x.s as s, filter(cut, c -> c > x.s and c < x.e)[0] as mid), best)).mid)), cut))"""
        cuts = F.expr(better)
    else:
        best = """
          aggregate(sequence(2, length(word) + 1), array(struct(cast(0.0 as double) as total, array(1) as cut)), (acc, e) -> array_append(acc,
            aggregate(filter(edges, x -> x.e = e), struct(cast(null as double) as total, array(1) as cut),
              (b, x) -> if(b.total is null or acc[x.s - 1].total + coalesce(x.score, -1000.0) > b.total,
                struct(acc[x.s - 1].total + coalesce(x.score, -1000.0) as total, array_append(acc[x.s - 1].cut, e) as cut), b))))"""
        cuts = F.element_at(F.expr(best), -1)["cut"]
    folded = grouped.withColumn("cut", cuts)
    return folded.select("word", F.expr("transform(sequence(1, size(cut) - 1), i -> substring(word, cut[i - 1], cut[i] - cut[i - 1]))").alias("path"))
