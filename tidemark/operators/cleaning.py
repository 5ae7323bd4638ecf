"""Cleaning of raw logs into entity and event tables, with exclusion logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_parallel(df: DataFrame, ids: list[str], arrays: dict[str, str]) -> DataFrame:
    """One row for each place of parallel arrays (output name -> array column); shorter arrays give nulls."""
    zipped = F.arrays_zip(*(F.col(a).alias(n) for n, a in arrays.items()))
    return df.select(*ids, F.explode(zipped).alias("x")).select(*ids, *(f"x.{n}" for n in arrays))


def composite_key(*columns: str, sep: str = "::") -> Column:
    return F.concat_ws(sep, *(F.col(c).cast("string") for c in columns))


def typed_by_prefix(df: DataFrame, column: str, kinds: dict[str, str], out: str, other: str | None = None) -> DataFrame:
    """A type column from the identifier's prefix; the first fitting prefix counts."""
    kind = F.lit(other)
    for prefix, name in reversed(kinds.items()):
        kind = F.when(F.col(column).startswith(prefix), F.lit(name)).otherwise(kind)
    return df.withColumn(out, kind)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds names the reason; null if none does. A null condition does not hold."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reason") -> DataFrame:
    return df.withColumn(out, first_reason(rules))


def cleaned(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows no rule excludes."""
    return df.where(first_reason(rules).isNull())


def excluded(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows some rule excludes, with the first reason."""
    return with_reason(df, rules).where("reason is not null")


def flatten_nested(df: DataFrame, ids: list[str], outer: str, inner: str, fields: dict[str, str]) -> DataFrame:
    """Two levels of nested arrays of structs to rows."""
    first = df.select(*ids, F.explode(outer).alias("o"))
    second = first.select(*ids, "o", F.explode(f"o.{inner}").alias("i"))
    return second.select(*ids, *(F.col(path).alias(name) for name, path in fields.items()))


def wall_clock_to_utc(epoch_seconds: Column, zone: str) -> Column:
    """Seconds whose wall clock was that of ``zone``, as a UTC timestamp."""
    return F.to_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone)


def with_prefix(column: str, prefix: str) -> Column:
    """The identifier with its prefix, whether or not it came with one."""
    return F.when(F.col(column).startswith(prefix), F.col(column)).otherwise(F.concat(F.lit(prefix), column))


def preferred_mapping(events: DataFrame, explicit: DataFrame, fallback: DataFrame, key: str, resource: str, target: str) -> DataFrame:
    """Targets of events: explicit pairs on ``key`` and fallback pairs on ``resource``, each once, with their source."""
    a = events.join(explicit, key).withColumn("mapping_source", F.lit("explicit"))
    b = events.join(fallback, resource).withColumn("mapping_source", F.lit("resource"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(*events.columns, target).agg(F.min("mapping_source").alias("mapping_source"))


def split_exact_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of surplus copies each had."""
    return df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("surplus"))


def component_pivot(df: DataFrame, key: str, kind: str, value: str, kinds: dict[str, list[str]]) -> DataFrame:
    """One column for each component, summing the raw kinds mapped to it; kinds in no list are left out."""
    return df.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col(kind).isin(raw), F.col(value))), F.lit(0.0)).alias(name) for name, raw in kinds.items()))


def text_profile(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows, share with some text, and mean trimmed length for each text column, by key."""
    filled = {c: F.length(F.trim(F.col(c))) > 0 for c in columns}
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(F.coalesce(f, F.lit(False)).cast("int")).alias(f"{c}_coverage") for c, f in filled.items()),
        *(F.avg(F.when(f, F.length(F.trim(F.col(c))))).alias(f"{c}_mean_length") for c, f in filled.items()),
    )


def normalize_name(column: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def id_code(column: str, prefix: str) -> Column:
    """The number after an identifier's prefix; null for any other form."""
    return F.regexp_extract(column, f"^{prefix}([0-9]+)$", 1).try_cast("long")
