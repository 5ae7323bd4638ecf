"""Groupings whose tasks hold a bounded number of rows, hot keys among them."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions.dealing import dealt
from tidemark.operators import features as X
from tidemark.plans import load


def rows(spark):
    """10,000 rows: key 'hot' has half of them, without a key are 1,000, the others have 2 each."""
    k = F.when(F.col("id") < 5000, "hot").when(F.col("id") >= 6000, F.concat(F.lit("k"), (F.col("id") % 2000).cast("string")))
    return spark.range(0, 10_000, 1, 8).select(k.alias("k"), (F.col("id") % 7).alias("v"), "id")


def test_dealt_loses_no_row_and_parts_grow(spark):
    df = rows(spark)
    rest, hot = dealt(df, ["k"], 500)
    assert rest.rdd.getNumPartitions() == 20 and dealt(df, ["k"], 250)[0].rdd.getNumPartitions() == 40
    assert {r.k: r["count"] for r in hot.groupBy("k").count().collect()} == {"hot": 5000, None: 1000}
    assert Counter(r.id for r in rest.unionByName(hot).collect()) == Counter(range(10_000))
    assert dealt(df, ["k"])[1] is None and dealt(df.where("false"), ["k"], 1)[0].count() == 0


def test_grain_audit_with_hot_keys(spark):
    df = rows(spark).drop("id")
    want = Counter((r.k, r.v) for r in df.collect())
    several = Counter(k for k, _ in want)
    want = (10_000, len(several), 10_000 - len(want), sum(n > 1 for n in several.values()))
    for part in (250, 500, 100_000):
        assert tuple(X.grain_audit(df, ["k"], part).first()) == want
    assert tuple(X.grain_audit(df.where("false"), ["k"]).first()) == (None, 0, None, 0)


def test_grain_audit_deals_rows_once(spark, sf_dir):
    plan = load().QUERIES["f16_grain_audit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_activity_features_with_hot_keys(spark):
    day = F.timestamp_seconds(F.col("id") % 11 * 40_000)
    df = rows(spark).select("k", day.alias("t"), F.timestamp_seconds(F.lit(0)).alias("s"), F.when(F.col("v") > 0, F.col("v")).alias("v"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3 + 1.0).alias("w"))
    seen = df.withColumn("day", F.to_date("t").cast("string")).collect()
    want = {}
    for key in {r.k for r in seen}:
        own = [r for r in seen if r.k == key]
        real = sum(r.a / r.w for r in own) / len(own)
        want[key] = (len(own), len({r.v for r in own} - {None}), len({r.day for r in own}), round(real, 9))
    for part in (250, 500, 100_000):
        out = X.activity_features(df, ["k"], "t", "s", "v", "a", X.playback("a", "w"), part).collect()
        assert len(out) == len(want) and {r.k: (r.event_count, r.unique_items, r.active_days, round(r.mean_real_time, 9)) for r in out} == want


def test_activity_keeps_events_without_user(spark, tmp_path):
    lines = spark.sql("select l_orderkey, 5L l_suppkey, l_partkey, 1 l_linenumber, q l_quantity, 10D l_extendedprice, 0.05D l_discount, 'R' l_returnflag, 'O' l_linestatus, timestamp'2024-03-05' l_shipdate from values (1L, 7L, 3D), (1L, 7L, 4D), (2L, null, 5D), (3L, 8L, 6D) as x(l_orderkey, l_partkey, q)")
    orders = spark.sql("select o_orderkey, o_custkey, timestamp'2024-03-01' o_orderdate from values (1L, null), (2L, null), (3L, 9L) as x(o_orderkey, o_custkey)")
    for name, df in (("lineitem", lines), ("orders", orders)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.user_id: (r.event_count, r.unique_items, r.active_days) for r in load().QUERIES["f3_activity_features"](spark, str(tmp_path)).collect()}
    assert got == {None: (3, 1, 1), 9: (1, 1, 1)}


def test_activity_deals_rows_once(spark, sf_dir):
    plan = load().QUERIES["f3_activity_features"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan and "Join" not in plan
