"""Queries that read their rows once, and what a second pass had got wrong."""

from datetime import datetime

from tidemark.operators.schedule import interval_match
from tidemark.plans import load


def scans(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_interval_match_counts_points_without_identifier(spark):
    day = lambda n: datetime(2020, 1, n)
    points = spark.createDataFrame([(None, "a", day(5)), (1, "a", day(5)), (2, "a", day(20)), (3, "b", day(5)), (4, None, day(5))], "u int, k string, t timestamp")
    spans = spark.createDataFrame([("a", day(1), day(9)), ("a", day(1), day(9)), ("a", day(9), day(1)), ("a", day(4), datetime(2020, 3, 1))], "k string, s timestamp, e timestamp")
    out = {r.u: (r.matches, r.status) for r in interval_match(points, spans, "k", "t", "s", "e", ["u"]).collect()}
    assert out == {None: (3, "multiple"), 1: (3, "multiple"), 2: (1, "one"), 3: (0, "unmatched"), 4: (0, "unmatched")}


def test_population_joins_lines_once(spark, sf_dir):
    assert scans(load().QUERIES["l4_population"](spark, sf_dir), "l_orderkey") and scans(load().QUERIES["l4_population"](spark, sf_dir), "Join ") == 1


def test_template_needs_no_rows_for_months(spark, sf_dir):
    assert scans(load().QUERIES["t28_global_template"](spark, sf_dir), "Generate explode(sequence") == 0


def test_summary_reads_written_progress(spark, sf_dir):
    assert not any("lineitem" in f for f in load().QUERIES["l18_metric_summary"](spark, sf_dir).inputFiles())
