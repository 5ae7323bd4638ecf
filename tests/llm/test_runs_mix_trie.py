"""Periodic runs, source mixes and conversation tries against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.periodic_runs import find_runs, periodic_runs, run_digests, with_planted_runs
from tidemark.llm.prefix_trie import RangeMinimum, common_prefix, prefix_trie, sequences, with_shared_heads
from tidemark.llm.source_mix import fit_budget, mix_sources, reach, source_targets

WORDS = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(params=["table", "hard", "odd"])
def docs(request, spark, sf_dir):
    return table(spark, sf_dir, "documents") if request.param == "table" else request.getfixturevalue(request.param)


# periodic runs


def plain_runs(words, least=24):
    """Every period, every maximal stretch; a stretch inside one of a smaller period is not of smallest period."""
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0, int)
    found = []
    for q in range(1, len(codes) // 3 + 1):
        same = np.concatenate(([0], (codes[:-q] == codes[q:]).astype(int), [0]))
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        found += [(int(s), int(e - s) + q, q) for s, e in zip(starts, ends, strict=True) if e - s + q >= max(least, 3 * q)]
    return sorted(((s, n, q) for s, n, q in found if not any(p < q and a <= s and a + m >= s + n for a, m, p in found)), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs(docs):
    got = rows(run_digests(periodic_runs(with_planted_runs(docs))), *RUN_COLUMNS)
    assert got == sorted((plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)


def test_runs_of_planted_words():
    rng = random.Random(5)
    for _ in range(200):
        parts = []
        for _ in range(3):
            w = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 80))]
            for _ in range(rng.randint(0, 3)):
                s, q = rng.randint(0, max(len(w) - 1, 0)), rng.randint(1, 12)
                for i in range(s + q, min(len(w), s + rng.randint(10, 70))):
                    w[i] = w[i - q]
            parts.append(w)
        least = rng.choice([3, 6, 24])
        start, length, period = find_runs(np.array([x for w in parts for x in w], dtype=np.int64), [len(w) for w in parts], least)
        offsets = np.cumsum([0, *map(len, parts)])
        want = [(s + offsets[i], n, q) for i, w in enumerate(parts) for s, n, q in plain_runs(w, least)]
        assert list(zip(start, length, period, strict=True)) == want


def test_periodic_runs_empty(empty):
    assert run_digests(periodic_runs(with_planted_runs(empty))).count() == 0


def test_a_very_long_run(spark):
    """A million equal words; a period that a few words break, which stand at a longer period themselves."""
    text = " ".join(["a"] * 1_000_000)
    other = " ".join(f"w{i % 1000}" if i % 300_000 else "x" for i in range(1_000_000))
    got = rows(periodic_runs(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")), "doc_id", "n_words", "runs")
    assert [tuple(x) for x in got[0][2]] == [(0, 1_000_000, 1)]
    assert [tuple(x) for x in got[1][2]] == [(0, 1_000_000, 300_000), (1, 299_999, 1000), (300_001, 299_999, 1000), (600_001, 299_999, 1000), (900_001, 99_999, 1000)]


# source mixes


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        left, whole = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {s: float(capped.get(s, share.get(s))) for s in order}
        capped |= {s: Fraction(most * sizes[s]) for s in above}


def check_mix(docs, got):
    want = defaultdict(int)
    for r in docs.select("source", "text").collect():
        want[r.source] += len(WORDS.findall(r.text or ""))
    source = {}
    for r in docs.select("doc_id", "source").collect():
        source.setdefault(r.doc_id, set()).add(r.source)
    targets = plain_targets(want)
    assert len(got) == docs.count()
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        own = [s for s in source[r.doc_id] if want[s] == r.source_size and abs(targets[s] - r.target) < 1e-6]
        assert own and 0 <= r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[r.source_size, r.target] += r.taken
        longest[r.source_size, r.target] = max(longest[r.source_size, r.target], r.size)
    same = defaultdict(int)
    for s in targets:
        same[want[s], round(targets[s], 6)] += 1
    for (size, target), words in taken.items():
        assert abs(words - target * same[size, round(target, 6)]) <= longest[size, target] * same[size, round(target, 6)]


def test_mix(docs):
    got = mix_sources(docs).collect()
    check_mix(docs, got)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_is_close(spark):
    """Sources of many lengths come within a word of their target; one length a third of all rows holds."""
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * (40 if i % 3 == 0 else rng.randint(0, 300))), f"s{i % 7 % 4}") for i in range(3000)]
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) <= 1 for r in got)


def test_targets_stop_at_the_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 5000, None: 7, "Z": 0, "\U0001f600": 30, "￮": 40}
    totals = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size long")
    got = {None if r.no_source else r.source: r.target for r in source_targets(totals).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(want[s], 1) for s in want)


def test_budgets_against_all_subsets():
    rng = random.Random(2)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        left = rng.randint(0, int((lengths * counts).sum()))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = reach(lengths, counts, left)
        assert (0 <= taken).all() and (taken <= counts).all()
        assert int((taken * lengths).sum()) == min(sums, key=lambda s: (abs(s - left), s))
        copies, more = fit_budget(lengths, counts, left, 3, 1, window=rng.choice([0, 10, 1000]))
        assert copies == (1 if left == (lengths * counts).sum() else 0) and (more <= counts).all()


def test_mix_empty(empty):
    assert mix_sources(empty).count() == 0


# conversation tries


def plain_sequences(turns):
    by = defaultdict(list)
    for r in turns:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            token = sha(f"{len(role.encode())}:{role}{text}")
            by[r.conv_id].append(((r.turn is not None, r.turn or 0, role, token), role, text))
    return {c: [(role, text) for _, role, text in sorted(x)] for c, x in by.items()}


def plain_trie(convs):
    """Rows of the trie, from a dictionary of all prefixes."""
    members = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children, own = defaultdict(int), {}
    for p, cs in members.items():
        if p:
            children[p[:-1]] += 1
        own[p] = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own[p]
    ended = {p: ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p)) for p, cs in members.items()}
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha(ended[p])) for p, cs in members.items()), key=repr)


def plain_shared(convs):
    out = {}
    for c, x in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + x[h:]
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, key string, part int, own string, size long"


@pytest.fixture(scope="session")
def hard_turns(spark):
    """Null turns, roles, texts and conversations, ties, repeated rows, equal conversations, prefixes of one another, a long one."""
    rng = random.Random(8)
    data = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, None, None), (2, 3, "bot", "é" * 5), (2, 3, "us", "er:x"), (2, 3, "user", ":x")]
    for c in range(3, 160):
        base = [("user", f"q{c % 4}"), ("bot", f"r{c % 3}"), ("user", "common"), ("bot", "x" * (c % 5))]
        data += [(c, t, *base[t % 4]) for t in range(rng.choice([1, 2, 4, 4, 7]))]
    data += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(12)]
    data += [(c, t, "user", f"same {t}") for c in (300, 301) for t in range(700)] + [(302, t, "user", f"same {t}" if t < 500 else "new") for t in range(620)]
    return spark.createDataFrame([(*r, "k", 1, "o", 2) for r in data], TURNS)


@pytest.mark.parametrize("parts", [None, 1, 23])
def test_trie(hard_turns, parts):
    convs = plain_sequences(hard_turns.collect())
    built = sequences(hard_turns)
    assert rows(prefix_trie(built, parts), *TRIE) == plain_trie(convs)
    assert rows(prefix_trie(with_shared_heads(built), parts), *TRIE) == plain_trie(plain_shared(convs))


def test_trie_of_the_table(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    got = rows(prefix_trie(with_shared_heads(sequences(turns))), *TRIE)
    assert got == plain_trie(plain_shared(plain_sequences(turns.collect())))


def test_trie_of_conversations_without_turns(spark):
    """A conversation whose turns are all replaced by those of an absent one has none: the empty prefix holds it."""
    alone = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:3]
    turns = spark.createDataFrame([(c, 0, "user", "x", "k", 1, "o", 2) for c in alone], TURNS)
    ids = sorted(alone)
    assert rows(prefix_trie(with_shared_heads(sequences(turns))), *TRIE) == [(ids[0], 0, None, 3, 0, 1, 0, sha(",".join(map(str, ids))))]


def test_trie_empty(spark):
    assert prefix_trie(with_shared_heads(sequences(spark.createDataFrame([], TURNS)))).count() == 0


def test_range_minimum():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33):
        values = rng.integers(0, 4, n)
        table_ = RangeMinimum(values)
        first = rng.integers(0, n, 50)
        last = np.minimum(first + rng.integers(0, n, 50), n - 1)
        assert table_.of(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]
        for least in range(5):
            wide = np.full(n, least)
            for at, right, left in zip(range(n), table_.last_from(np.arange(n), wide), table_.first_to(np.arange(n), wide), strict=True):
                assert all(values[at + 1 : right + 1] >= least) and (right == n - 1 or values[right + 1] < least)
                assert all(values[left + 1 : at + 1] >= least) and (left == 0 or values[left] < least)


def test_common_prefix():
    token = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
    for a, b, n in ([(0, 1, 2), (0, 1, 3), 2], [(0, 1), (0, 1, 2), 2], [(), (1,), 0], [(1, 2), (1, 2), 2], [(0,) * 40, (0,) * 39 + (1,), 39]):
        assert common_prefix(b"".join(token[i] for i in a), b"".join(token[i] for i in b)) == n
