"""Shared helpers: joins with hot keys, hash filters, the scratch folder."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import connected_components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_join_is_a_join(spark, how):
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500)).cast("long").alias("k"), "id")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = counts.where("k % 2 = 1").withColumn("v", F.col("k") * 10)
    want = sorted(map(tuple, big.join(small, "k", how).select("k", "id", "n", "v").collect()), key=repr)
    for total in (3000, 10**9):  # with hot keys, and with none
        got = common.heavy_join(big, small, ["k"], "n", total, how)
        assert sorted(map(tuple, got.select("k", "id", "n", "v").collect()), key=repr) == want


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_filters_never_drop_a_key(spark, bits):
    held = spark.range(0, 4000, 2).withColumnRenamed("id", "k").union(spark.sql("select cast(null as bigint)"))
    rows = spark.range(8000).withColumnRenamed("id", "k").union(spark.sql("select cast(null as bigint)"))
    got = {r.k: r.maybe for r in common.maybe_in(rows, [F.col("k")], common.slot_filter(held, ["k"], bits), bits=bits).collect()}
    assert len(got) == 8001 and got[None] and all(got[k] for k in range(0, 4000, 2))
    wrong = sum(got[k] for k in range(8000) if k >= 4000 or k % 2)
    assert wrong < 6000 * (0.2 if bits == 1 << 15 else 0.02)
    none = common.maybe_in(rows, [F.col("k")], common.slot_filter(held.where("k < 0"), ["k"]))
    assert none.where("maybe").count() == 0


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (2, "d")], "id long, text string")
    gone = spark.createDataFrame([(1, "b"), (None, "c"), (9, "z")], "g long, t string")
    left = common.without(docs, gone, F.col("id"), "g", F.col("id").eqNullSafe(F.col("g")) & (F.col("text") == F.col("t")))
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(1, "a"), (2, "d"), (2, "d")]


def test_scratch_folder():
    from types import SimpleNamespace as Fake

    session = lambda base, master: Fake(conf=Fake(get=lambda *a: base), sparkContext=Fake(master=master, applicationId="app-1"))
    assert common.shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y/tidemark-app-1"
    assert common.shared_dir(session(None, "local[4]")).endswith("/tidemark-app-1")
    with pytest.raises(ValueError):
        common.shared_dir(session(None, "spark://host:7077"))


def test_components_with_a_hub(spark):
    """A node with most links, a long chain, repeated and null links."""
    pairs = [(5, i) for i in range(1000, 3000)] + [(i, i + 1) for i in range(10, 60)] + [(60, 10)] * 5 + [(None, 3), (3, None), (8, 8)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {5: 5, **dict.fromkeys(range(1000, 3000), 5), **dict.fromkeys(range(10, 61), 10)}
