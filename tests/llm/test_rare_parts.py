"""Candidates of the similarity join: parts that unlike texts share by chance join no clusters, and no link is lost."""

import random

import tidemark.llm.jaccard_join as module

from . import brute


def common_and_own_words(rng, groups, copies, own=50, common=10, pool=30):
    """Near copies in groups; texts of different groups share only words of a common pool."""
    rows = []
    for g in range(groups):
        base = [f"own{g}x{i}" for i in range(own)] + [f"all{i}" for i in rng.sample(range(pool), common)]
        for k in range(copies):
            words = list(base)
            for i in rng.sample(range(own), k):
                words[i] = f"new{g}x{k}x{i}"
            rows.append((len(rows), " ".join(words)))
    return rows


def components_and_clusters(spark, monkeypatch, rows, width, percent):
    seen, units = [], module.units

    def held(texts, ids, clusters, width):
        seen.append(clusters.groupBy("root").count().collect())
        return units(texts, ids, clusters, width)

    monkeypatch.setattr(module, "units", held)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in module.similarity_components(docs, width=width, percent=percent).collect()), key=repr)
    return got, [r["count"] for r in seen[0]]


def test_chance_parts_join_no_clusters(spark, monkeypatch):
    rows = common_and_own_words(random.Random(5), groups=150, copies=3)
    got, clusters = components_and_clusters(spark, monkeypatch, rows, 1, 80)
    assert got == brute.components(rows, 1, 80) and len({r[2] for r in got}) == 150
    assert max(clusters) <= 6 and sum(clusters) == 450


def test_links_at_the_bound(spark, monkeypatch):
    """Copies that differ by about as much as a link allows, on both sides, beside common words."""
    rng = random.Random(6)
    rows = common_and_own_words(rng, groups=40, copies=9, own=30, common=12, pool=24) + common_and_own_words(rng, groups=20, copies=4, own=4, common=5, pool=9)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    for percent in (80, 90):
        got, _ = components_and_clusters(spark, monkeypatch, rows, 1, percent)
        assert got == brute.components(rows, 1, percent)
        assert len({r[2] for r in got}) < len(rows)


def test_a_set_in_two_slices(spark):
    """First-pass members are numbers in their slice; equal sets of two tasks are still one set."""
    rows = common_and_own_words(random.Random(7), groups=30, copies=2)
    docs = [(i, t) for i, (_, t) in enumerate(rows + [(0, t + " ") for _, t in rows[::3]])]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(docs, 7), "doc_id long, text string")
    got = sorted((tuple(r) for r in module.similarity_components(frame, width=2, percent=70).collect()), key=repr)
    assert got == brute.components(docs, 2, 70)
