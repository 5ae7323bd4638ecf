"""Point-in-time features at cumulative cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dealing import PART_ROWS, dealt
from ..functions.ranking import top_by

#: Phases and the share of the window that each has seen.
PHASES = {"P1": 0.25, "P2": 0.5, "P3": 0.75, "P4": 0.9}


def phase_cutoffs(windows: DataFrame, start: str, end: str, phases: dict[str, float] = PHASES) -> DataFrame:
    """One row a window and phase with its cutoff (whole seconds); windows that end at or before their start are left out."""
    s, e = F.unix_timestamp(start), F.unix_timestamp(end)
    specs = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(r).alias("ratio")) for p, r in phases.items()))
    out = windows.where(F.col(end) > F.col(start)).withColumn("x", F.explode(specs)).withColumn("phase", F.col("x.phase"))
    out = out.withColumn("cutoff_time", F.timestamp_seconds(F.floor(s + (e - s) * F.col("x.ratio"))))
    return out.withColumn("window_duration_seconds", e - s).drop("x")


def until_cutoff(events: DataFrame, spine: DataFrame, keys: list[str], time: str, start: str) -> DataFrame:
    """Events of each key and phase in [start, cutoff]; an equi-join on the keys with a range condition."""
    bounds = spine.select(*keys, "phase", "cutoff_time", F.col(start).alias("__start"))
    return events.join(bounds, keys).where((F.col(time) >= F.col("__start")) & (F.col(time) <= F.col("cutoff_time"))).drop("__start")


def spread(column: str | Column, name: str, what: str = "sum mean std min max") -> list[Column]:
    """Usual aggregates of a numeric column."""
    how = {"sum": F.sum, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max}
    return [how[w](column).alias(f"{name}_{w}") for w in what.split()]


def activity_features(x: DataFrame, keys: list[str], time: str, start: str, item: str, amount: str, also: tuple[Column, ...] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """Volume, distinct items and days, repeats, and day offsets of one kind of event, with further aggregates in ``also``.

    Rows dealt by key mark the first one of each item and day by two sorts inside a task; rows of hot keys are left to
    Spark's distinct counts, which spread them. Reads ``x`` up to five times.
    """
    offset, day = F.date_diff(time, start).cast("double"), F.to_date(time)

    def by_key(rows: DataFrame, items: Column, days: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("event_count"), items.alias("unique_items"), days.alias("active_days"),
            *spread(amount, amount), *spread(offset, "day_offset", "mean std min max"), F.avg(F.dayofweek(time)).alias("mean_weekday"), *also,
        )

    first = lambda c: F.row_number().over(Window.partitionBy(*keys, c).orderBy(c)) == 1
    rows, hot = dealt(x, keys, part_rows)
    marked = rows.withColumn("__day", day).withColumn("__item", F.when(first(item), F.col(item))).withColumn("__day", F.when(first("__day"), F.col("__day")))
    out = by_key(marked, F.count("__item"), F.count("__day"))
    if hot is not None:
        out = out.unionByName(by_key(hot, F.count_distinct(item), F.count_distinct(day)))
    return out.withColumn("repeat_ratio", F.try_divide(F.col("event_count") - F.col("unique_items"), "event_count")).withColumn(
        "events_per_day", F.try_divide("event_count", "active_days")
    )


def playback(amount: str, speed: str) -> tuple[Column, ...]:
    """Aggregates of playback: real time and speed."""
    return (
        F.avg(F.try_divide(amount, speed)).alias("mean_real_time"), F.avg(speed).alias("mean_speed"), F.coalesce(F.variance(speed), F.lit(0.0)).alias("speed_variance"),
        F.avg((F.col(speed) > 0.95).cast("double")).alias("fast_ratio"),
    )


def playback_features(x: DataFrame, keys: list[str], amount: str, speed: str) -> DataFrame:
    return x.groupBy(*keys).agg(*playback(amount, speed))


def score_features(x: DataFrame, keys: list[str], score: str, full: str, correct: Column, attempts: Column) -> DataFrame:
    clean = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    right = F.coalesce(correct, F.lit(False)).cast("double")
    return x.groupBy(*keys).agg(
        *spread(clean, "score", "sum mean std"), *spread(F.try_divide(clean, F.col(full)), "score_fraction", "mean std"), F.sum(right).alias("correct_count"),
        F.sum(1 - right).alias("incorrect_count"), F.avg(right).alias("correct_ratio"), *spread(F.coalesce(attempts, F.lit(0)).cast("double"), "attempts", "sum mean"),
    )


def text_features(x: DataFrame, keys: list[str], text: str, mood: Column, moods: list[str]) -> DataFrame:
    length = F.length(F.trim(F.col(text))).cast("double")
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *spread(length, "length", "mean std min max"), *(F.count_if(mood == m).alias(f"{m}_count") for m in moods), *(F.avg((mood == m).cast("double")).alias(f"{m}_ratio") for m in moods)
    )


def mode_by(df: DataFrame, keys: list[str], column: Column, out: str) -> DataFrame:
    """The most frequent value by key; ties go to the smallest."""
    counts = df.groupBy(*keys, column.alias(out)).agg(F.count(F.lit(1)).alias("__n"))
    return top_by(counts, keys, [F.desc("__n"), F.asc(out)]).drop("__n")


def sessionize(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: int) -> DataFrame:
    """Adds session_id: a new session starts after a pause of more than ``gap_seconds``."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    pause = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(order))
    fresh = F.when(pause.isNull() | (pause > gap_seconds), 1).otherwise(0)
    return df.withColumn("__new", fresh).withColumn("session_id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def session_spread(sessions: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Sessions, and the deviation of their seconds (0 for a single one), by key."""
    seconds = F.unix_timestamp(F.max(time)) - F.unix_timestamp(F.min(time))
    each = sessions.groupBy(*keys, "session_id").agg(seconds.alias("__s"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.stddev("__s"), F.lit(0.0)).alias("session_seconds_std"))


def catalog_totals(catalog: DataFrame, key: str, item: str, full: str) -> DataFrame:
    return catalog.groupBy(key).agg(F.count_distinct(item).alias("items"), F.sum(full).alias("full_total"))


def merge_features(spine: DataFrame, blocks: dict[str, DataFrame], keys: list[str], marker: dict[str, str]) -> DataFrame:
    """Left-joins feature blocks to the spine; no event stays null, with a mask that says whether a block was observed."""
    out = spine
    for name, block in blocks.items():
        out = out.join(block, keys, "left").withColumn(f"{name}_observed_mask", F.col(marker[name]).isNotNull().cast("int"))
    return out


def window_exclusions(windows: DataFrame, ids: list[str], start: str, end: str) -> DataFrame:
    """Windows that repeat exactly (surplus copies) or do not end after their start, with a reason."""
    invalid = windows.where(~(F.col(end) > F.col(start)) | F.col(start).isNull() | F.col(end).isNull()).select(*ids, F.lit("invalid_window").alias("reason"), F.lit(1).cast("long").alias("n"))
    copies = windows.groupBy(*windows.columns).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    return invalid.unionByName(copies.select(*ids, F.lit("exact_duplicate").alias("reason"), "n"))


def conformance(spine: DataFrame, ids: list[str], start: str, end: str, phases: int) -> DataFrame:
    """Checks as rows: every id has every phase once, and cutoffs stand inside their window."""
    cardinality = spine.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("phase").alias("k")).agg(F.count_if((F.col("n") != phases) | (F.col("k") != phases)).alias("violations"))
    cutoffs = spine.agg(F.count_if((F.col("cutoff_time") < F.col(start)) | (F.col("cutoff_time") > F.col(end))).alias("violations"))
    both = cardinality.select(F.lit("phase_cardinality").alias("check"), "violations").unionByName(cutoffs.select(F.lit("cutoff_in_window").alias("check"), "violations"))
    return both.withColumn("passed", F.col("violations") == 0)


def widen_phases(long: DataFrame, keys: list[str], features: list[str], phases: list[str]) -> DataFrame:
    """One row a key with ``<feature>_<phase>`` columns."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("phase") == p, F.col(f))).alias(f"{f}_{p}") for p in phases for f in features))


def grain_audit(df: DataFrame, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Rows, exact copies and keys that keep several different rows: one audit row. Reads ``df`` up to four times."""

    def by_key(x: DataFrame) -> DataFrame:
        distinct = x.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
        return distinct.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("different"))

    rows, hot = dealt(df, keys, part_rows)
    per = by_key(rows) if hot is None else by_key(rows).unionByName(by_key(hot))
    return per.agg(F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("rows") - F.col("different")).alias("exact_copies"), F.count_if(F.col("different") > 1).alias("conflicting_keys"))


def require_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows; refuses keys with several different ones."""
    bad = grain_audit(df, keys).first()["conflicting_keys"]
    if bad:
        raise ValueError(f"{bad} keys of {keys} have different rows")
    return df.dropDuplicates()


def cyclic(column: Column, period: float) -> list[Column]:
    angle = column * (2 * 3.141592653589793 / period)
    return [F.sin(angle), F.cos(angle)]


def prefix_components(events: DataFrame, keys: list[str], time: str, start: str, end: str, value: str, ratios: dict[str, float]) -> DataFrame:
    """Share of a key's total value reached by each ratio of its window; FINAL must be 1."""
    at = (F.unix_timestamp(time) - F.unix_timestamp(start)) / (F.unix_timestamp(end) - F.unix_timestamp(start))
    return events.groupBy(*keys).agg(*(F.try_divide(F.sum(F.when(at <= r, F.col(value)).otherwise(0.0)), F.sum(value)).alias(n) for n, r in ratios.items()))
