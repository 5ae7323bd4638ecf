"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), at least three periods
and ``least`` words long, that no neighbouring word extends. Factors of 1, 2, 4, ... words are named level by level; a
factor that stands only once in its document is dropped, so levels shrink fast. On the level of length L the next
occurrence of a factor, looked for within 2L words, proposes its distance as a period.

Why each run is proposed once and whole: take q with L/2 < q <= L. Inside the run, factors of L >= q words recur q words
on and not before, as q is the smallest period; so all starts from the run's first word to the last one whose
successor still fits propose q, a progression of step 1. A start before or after the run does not, because the
stretch would be periodic there too. Distances outside that interval belong to another level and are left to it.

Documents are rows of a map: no shuffle, and a task holds a slice of about ``SLICE`` words, or one longer document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = re.compile("[^\x20\x09-\x0d]+")
LEAST, SLICE = 24, 300_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def find_runs(codes: np.ndarray, sizes: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs of the documents that stand one after another in ``codes``; starts count over all."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at, key, factor = np.arange(len(codes)), doc * (int(codes.max(initial=0)) + 1) + codes, 1
    named = np.full(len(codes), -1)
    found = []
    while len(at):
        order = np.argsort(key, kind="stable")
        place, value = at[order], key[order]
        again = value[1:] == value[:-1]
        gap = place[1:] - place[:-1]
        near = again & (2 * gap > factor) & (gap <= factor)  # up to 2 * factor the next level proposes, up to factor / 2 the one before did
        found.append(progressions(place[:-1][near], gap[near], factor, least))
        twice = np.append(again, False) | np.append(False, again)
        held = place[twice]
        name = np.cumsum(np.append(True, ~again))[twice]
        named[held] = name
        held.sort()
        held = held[held + 2 * factor <= ends[held]]
        held = held[named[held + factor] >= 0]
        key = named[held] * (int(name.max(initial=0)) + 1) + named[held + factor]
        named[place] = -1
        at, factor = held, 2 * factor
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def progressions(at: np.ndarray, gap: np.ndarray, factor: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of the stretches that proposals of one distance at neighbouring words make, where long enough."""
    order = np.lexsort((at, gap))
    at, gap = at[order], gap[order]
    first = np.append(True, (gap[1:] != gap[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
    last = np.append(first[1:], True)[: len(at)]
    start, period = at[first], gap[first]
    length = at[last] - start + factor + period
    long = length >= np.maximum(least, 3 * period)
    return start[long], length[long], period[long]


def slices(words: list[list[str]]) -> Iterator[slice]:
    """Consecutive documents of about ``SLICE`` words together."""
    first = held = 0
    for i, w in enumerate(words):
        held += len(w)
        if held >= SLICE:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(words):
        yield slice(first, len(words))


def described(ids: pa.Array, words: list[list[str]], least: int) -> pa.RecordBatch:
    """A row of ``SCHEMA`` for each document."""
    sizes = [len(w) for w in words]
    codes = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0].astype(np.int64) if sum(sizes) else np.empty(0, np.int64)
    start, length, period = find_runs(codes, sizes, least)
    gone = np.zeros(len(codes) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone)[:-1] == 0
    firsts = np.append(0, np.cumsum(sizes))
    bounds = np.searchsorted(start, firsts)  # a run's document is where it starts
    begun = start - np.repeat(firsts[:-1], np.diff(bounds))
    runs = pa.StructArray.from_arrays([pa.array(begun, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
    texts = [" ".join(w if bounds[i] == bounds[i + 1] else np.array(w, dtype=object)[kept[firsts[i] : firsts[i + 1]]]) for i, w in enumerate(words)]
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text with one period of each run).

    A word is dropped if any run holds it after that run's first period; kept words are joined by one blank. One row for
    each row of ``docs``, repeated ones and null identifiers too; a null text counts as empty. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k in range(0, batch.num_rows, 500):
                part = slice(k, min(k + 500, batch.num_rows))
                words = [WORD.findall(t.as_py()) for t in batch.column(1)[part]]
                for s in slices(words):
                    yield described(ids[k + s.start : k + s.stop], words[s], least)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of every tenth identifier (by crc32) with their tail made periodic: word i >= a becomes word a + (i - a) % p.

    With h the crc32 of the decimal identifier, g = floor(h / 10) and n words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    Rows with a null identifier stay as they are.
    """
    x = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    x = x.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    x = x.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return x.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """Per document: the number of runs, the one with the greatest exact exponent (ties: smallest start, then period), and digests.

    runs_sha256: of every run's ``start,length,period`` and a line feed, by start, then period; collapsed_sha256: of the
    collapsed text in UTF-8.
    """
    best = F.expr("reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, x) -> if(b is null or x.length * b.period > b.length * x.period, x, b))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
