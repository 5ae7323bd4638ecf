"""Schedules, intervals and the assignment of events to them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import quantiles, running_total, top_by


def parse_dates(text: Column) -> Column:
    """Valid dates of a malformed list, in order."""
    tokens = F.regexp_extract_all(text, F.lit(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.lit(0))
    return F.filter(F.transform(tokens, lambda t: F.try_to_timestamp(t, F.lit("yyyy-M-d")).cast("date")), lambda x: x.isNotNull())


def parse_tokens(text: Column, repairs: dict[str, str]) -> Column:
    """Lower-case words of a malformed list; known misspellings are repaired."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")

    def repaired(w):
        out = w
        for wrong, right in repairs.items():
            out = F.when(w == wrong, F.lit(right)).otherwise(out)
        return out

    return F.transform(words, repaired)


def course_schedule(rows: DataFrame, key: str, start: str, end: str, attributes: list[str]) -> DataFrame:
    """First start, last end, and the smallest non-null of each attribute, by key."""
    return rows.groupBy(key).agg(F.min(start).alias("schedule_start"), F.max(end).alias("schedule_end"), *(F.min(a).alias(a) for a in attributes))


def array_alignment(rows: DataFrame, left: str, right: str) -> Column:
    a, b = F.size(left), F.size(right)
    return F.when((a <= 0) & (b <= 0), "both_empty").when(a == b, "aligned").when(a > b, "more_starts").otherwise("more_ends")


def schedule_runs(rows: DataFrame, key: str, starts: str, ends: str, tags: str) -> DataFrame:
    """Runs of parallel date arrays: paired by place, inverted pairs dropped, named by a hash."""
    zipped = rows.select(key, tags, F.posexplode(F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e"))).alias("i", "x"))
    out = zipped.select(key, F.col("i").alias("schedule_index"), F.get(tags, F.col("i")).alias("season"), F.col("x.s").alias("run_start"), F.col("x.e").alias("run_end"))
    out = out.where(F.col("run_start") <= F.col("run_end")).withColumn("run_days", F.date_diff("run_end", "run_start"))
    return out.withColumn("run_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), "schedule_index", "run_start", "run_end"), 256))


def expand_months(runs: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each month an interval touches, with its active days there."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    out = runs.withColumn("month", F.explode(months))
    first, last = F.greatest(F.col("month"), F.to_date(start)), F.least(F.last_day("month"), F.to_date(end))
    return out.withColumn("active_days", F.date_diff(last, first) + 1)


def month_templates(runs: DataFrame, start: str, span: Column, least_runs: int) -> DataFrame:
    """The most frequent span of runs by start month (ties to the shorter); reliable from ``least_runs`` on."""
    counts = runs.groupBy(F.month(start).alias("start_month"), span.alias("months_covered")).agg(F.count(F.lit(1)).alias("n"))
    best = top_by(counts, ["start_month"], [F.desc("n"), F.asc("months_covered")])
    return best.withColumn("reliable", F.col("n") >= least_runs)


def months_of(start: Column | str, end: Column | str) -> Column:
    """The first days of all months an interval touches."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))


def interval_match(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, ids: list[str]) -> DataFrame:
    """Points with the number of intervals of their key that contain them, and a status.

    A point meets only the intervals that touch its month, so a key with many points and intervals is spread over months.
    A key's different intervals of a month stand with their numbers in one row, so a point meets one row at most: points
    are read once and not grouped again. ``ids`` name the points.
    """
    spans = intervals.where(F.col(start) <= F.col(end)).select(key, F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(months_of(start, end)).alias("__m"))
    spans = spans.groupBy(key, "__m", "__s", "__e").agg(F.count(F.lit(1)).alias("__n"))
    spans = spans.groupBy(key, "__m").agg(F.collect_list(F.struct("__s", "__e", "__n")).alias("__spans"))
    inside = F.filter("__spans", lambda x: (F.col(time) >= x["__s"]) & (F.col(time) <= x["__e"]))
    matches = F.aggregate(inside, F.lit(0).cast("long"), lambda n, x: n + x["__n"])
    met = points.withColumn("__m", F.trunc(time, "month")).join(spans, [key, "__m"], "left")
    out = met.select(*points.columns, F.coalesce(matches, F.lit(0).cast("long")).alias("matches"))
    return out.withColumn("status", F.when(F.col("matches") == 0, "unmatched").when(F.col("matches") == 1, "one").otherwise("multiple"))


def calendar_distribution(df: DataFrame, unit: Column) -> DataFrame:
    """Rows by calendar unit with their share of all."""
    counts = df.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each calendar unit


def monthly_cohorts(df: DataFrame, key: str, time: str) -> DataFrame:
    month = F.date_format(time, "yyyy-MM")
    return df.groupBy(key, month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time")).withColumn(
        "cohort_id", F.concat_ws("__", F.col(key).cast("string"), "month")
    )


def block_of(fraction: Column, ratios: dict[str, float]) -> Column:
    """The block whose cumulative ratio first reaches the fraction."""
    bounds, total = [], 0.0
    for name, share in ratios.items():
        total += share
        bounds.append((name, round(total, 9)))
    block = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        block = F.when(fraction <= bound, F.lit(name)).otherwise(block)
    return block


def allocate_blocks(units: DataFrame, order: list[str], size: str, ratios: dict[str, float], out: str = "block") -> DataFrame:
    """Chronological blocks of indivisible units, by the fraction at which a unit's middle row stands."""
    placed = running_total(units, [F.col(c) for c in order], size, "__upto")
    total = units.agg(F.sum(size)).first()[0] or 1
    middle = (F.col("__upto") - F.col(size) / 2) / total
    return placed.withColumn(out, block_of(middle, ratios)).drop("__upto")


def block_summary(blocks: DataFrame, block: str, size: str, ratios: dict[str, float]) -> DataFrame:
    targets = F.create_map(*(F.lit(x) for pair in ratios.items() for x in pair))
    rows = blocks.groupBy(block).agg(F.count(F.lit(1)).alias("units"), F.sum(size).alias("n"))
    return rows.withColumn("realized", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("target", F.element_at(targets, F.col(block)))


def anchored_intervals(points: DataFrame, key: str, time: str, tie: str, months: dict[int, int], fallback_days: int) -> DataFrame:
    """Sequential intervals: the first unassigned point opens one, whose length depends on its month; points inside join it.

    An interval begins and ends at midnight, so all points of a key that stand at a day's midnight share their interval,
    and so do all later ones of that day. Each such half day is one row with its first point before anything is sequential:
    a key has two a day at most, however many points it has, and these stream in order through a task with one interval
    as state. Points then meet their half day, spread by key and day. Rows without key or time have no interval. Intervals
    last a day at least.
    """
    if fallback_days < 1 or any(m < 1 for m in months.values()):
        raise ValueError("an interval lasts a day at least")
    day = F.to_date(time)
    placed = points.withColumns({"__day": day, "__late": F.col(time) > day.cast("timestamp")})
    halves = placed.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, "__day", "__late").agg(F.min(F.struct(time, tie)).alias("__first"))
    opened = interval_fold(halves.select(key, "__day", "__late", "__first.*"), key, time, tie, months, fallback_days)
    return placed.join(opened.drop(time, tie), [key, "__day", "__late"], "left").select(*points.columns, "sequence", "start_date", "end_date", "anchor")


def interval_fold(points: DataFrame, key: str, time: str, tie: str, months: dict[int, int], fallback_days: int) -> DataFrame:
    """Adds sequence, start_date, end_date, anchor to points in order of time and tie; a step is an interval, whose points are found by binary search."""
    import numpy as np
    import pandas as pd

    def end_of(start: pd.Timestamp) -> pd.Timestamp:
        span = months.get(start.month)
        return start + pd.DateOffset(months=span) - pd.Timedelta(days=1) if span else start + pd.Timedelta(days=fallback_days)

    names = [f.name for f in points.schema]
    types = ", ".join(f"`{n}` {t}" for n, t in points.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, start, end, anchor = object(), 0, None, None, None
        for x in batches:
            x = x.reset_index(drop=True)
            times = pd.to_datetime(x[time])
            changes = np.flatnonzero((x[key] != x[key].shift()).to_numpy())
            cuts, opened = [], []  # first row of each stretch inside one interval, and that interval
            for lo, hi in zip(changes, [*changes[1:], len(x)], strict=True):
                k, at = x[key].iat[lo], lo
                while at < hi:
                    if k != current or times.iat[at] > end:
                        number = number + 1 if k == current else 1
                        current, start, anchor = k, times.iat[at].normalize(), x[tie].iat[at]
                        end = end_of(start)
                    cuts.append(at)
                    opened.append((number, start.date(), end.date(), anchor))
                    at += int(times.iloc[at:hi].searchsorted(end, "right"))
            each = pd.DataFrame(opened, columns=["sequence", "start_date", "end_date", "anchor"])
            out = each.iloc[np.repeat(np.arange(len(cuts)), np.diff([*cuts, len(x)]))].reset_index(drop=True)
            yield pd.concat([x, out], axis=1)[[*names, "sequence", "start_date", "end_date", "anchor"]]

    anchor_type = dict(points.dtypes)[tie]
    ordered = points.repartition(key).sortWithinPartitions(key, time, tie)
    return ordered.mapInPandas(run, f"{types}, sequence int, start_date date, end_date date, anchor {anchor_type}")


def interval_activity(intervals: DataFrame, events: DataFrame, key: str, ids: list[str], start: str, end: str, time: str) -> DataFrame:
    """Intervals flagged by whether any event of their key falls inside."""
    moments = events.select(key, F.to_date(time).alias("__t")).distinct().withColumn("__m", F.trunc("__t", "month"))
    spans = intervals.where(F.to_date(start) <= F.to_date(end)).withColumn("__m", F.explode(months_of(F.to_date(start), F.to_date(end))))
    active = spans.join(moments, [key, "__m"]).where(F.col("__t").between(F.to_date(start), F.to_date(end))).select(*ids).distinct().withColumn("active", F.lit(1))
    return intervals.join(active, ids, "left").withColumn("active", F.coalesce("active", F.lit(0)))


def quantile_profile(df: DataFrame, columns: list[str], population: str, steps: list[float]) -> DataFrame:
    """Long rows (metric, population, quantile, value) of exact quantiles."""
    values = quantiles(df, {c: F.col(c) for c in columns}, steps)
    out = values.select(F.col("feature").alias("metric"), F.posexplode("quantiles").alias("i", "value"))
    return out.select("metric", F.lit(population).alias("population"), F.get(F.array(*(F.lit(q) for q in steps)), F.col("i")).alias("quantile"), "value")


def name_match_audit(left: DataFrame, right: DataFrame, name: Column, key: str) -> DataFrame:
    """Left keys with the number of right rows of the same normalized name."""
    counts = right.groupBy(name.alias("__name")).agg(F.count(F.lit(1)).alias("matches"))
    out = left.select(key, name.alias("__name")).join(counts, "__name", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("multiple")).drop("__name")


def shifted_offerings(points: DataFrame, runs: DataFrame, key: str, time: str, start: str, end: str, years: list[int]) -> DataFrame:
    """Candidate runs of a point when runs recur each year: moved by whole years onto the point's year and the ones before.

    Moving keeps the months of the year that a run touches (one more for ends that slip over a short month), so points
    and runs meet by key and month of the year.
    """
    spans = runs.where(F.col(start) <= F.col(end)).withColumn("__m", F.explode(F.array_distinct(F.transform(months_of(start, F.date_add(end, 3)), F.month))))
    moved = points.withColumn("__m", F.month(time)).join(spans, [key, "__m"]).drop("__m").withColumn("__back", F.explode(F.array(*(F.lit(y) for y in years))))
    months = (F.year(time) - F.year(start) - F.col("__back")) * 12
    moved = moved.withColumn("offering_start", F.add_months(start, months)).withColumn("offering_end", F.add_months(end, months)).drop("__back")
    return moved.where(F.to_date(time).between(F.col("offering_start"), F.col("offering_end")))


def resolve_assignments(sources: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """One row a key, from the first source that has it (within a source, the smallest row)."""
    ranked = None
    for rank, (name, frame) in enumerate(sources):
        tagged = frame.withColumn("assignment_source", F.lit(name)).withColumn("__rank", F.lit(rank))
        ranked = tagged if ranked is None else ranked.unionByName(tagged)
    others = [c for c in ranked.columns if c not in key]
    best = ranked.groupBy(*key).agg(F.min(F.struct("__rank", *(c for c in others if c != "__rank"))).alias("x"))
    return best.select(*key, "x.*").drop("__rank")


def interval_month_profile(units: DataFrame, start: str, end: str) -> DataFrame:
    """Units active, starting and ending in each month."""
    flags = expand_months(units, start, end)
    same = lambda c: (F.trunc(c, "month") == F.col("month")).cast("int")
    return flags.groupBy("month").agg(F.count(F.lit(1)).alias("active"), F.sum(same(start)).alias("starting"), F.sum(same(end)).alias("ending"))


def duration_summary(units: DataFrame, start: str, end: str, long_days: int) -> DataFrame:
    days = F.date_diff(end, start)
    middle = quantiles(units, {"days": days}, [0.5]).first()  # one row
    return units.agg(
        F.count(F.lit(1)).alias("units"), F.avg(days).alias("mean_days"), F.lit(middle["quantiles"][0] if middle else None).cast("double").alias("median_days"), F.max(days).alias("max_days"),
        F.avg((days > long_days).cast("int")).alias("long_share"),
    )
