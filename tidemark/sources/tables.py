"""Readers and writers for raw logs, views, manifests and facts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the folder that all executors share (``spark.checkpoint.dir``).

    Where that is unset, a local session uses the machine's temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with an explicit schema: no pass over the data to infer one."""
    return spark.read.schema(schema).json(path)


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted CSV whose fields may hold line ends; bad rows give nulls."""
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE").schema(schema).csv(path)


def read_relation(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Distinct pairs of a tab-separated file without header."""
    return spark.read.option("sep", "\t").schema(f"{left} string, {right} string").csv(path).dropDuplicates([left, right])


def read_text_pairs(spark: SparkSession, path: str, left: str, right: str, left_prefix: str, right_prefix: str) -> DataFrame:
    """Pairs of white-space separated lines; a byte order mark is stripped, lines with other prefixes are dropped."""
    parts = F.split(F.trim(F.regexp_replace("value", "^﻿", "")), r"\s+")
    pairs = spark.read.text(path).select(F.get(parts, F.lit(0)).alias(left), F.get(parts, F.lit(1)).alias(right))
    return pairs.where(F.col(left).startswith(left_prefix) & F.col(right).startswith(right_prefix)).distinct()


def read_view(spark: SparkSession, path: str, columns: list[str], where: Column | str | None = None) -> DataFrame:
    """Chosen columns and rows; both reach the Parquet scan."""
    view = spark.read.parquet(path)
    return (view if where is None else view.where(where)).select(*columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_facts(df: DataFrame, path: str, keys: list[str]) -> None:
    """Facts in one folder for each key; rows of a key meet before the write, so a folder has few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def content_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def content_digest(manifest: DataFrame) -> DataFrame:
    """One hash of a manifest, whatever the order of its files."""
    lines = F.array_sort(F.collect_list(F.concat_ws("\t", "file", "sha256")))
    return manifest.agg(F.sha2(F.concat_ws("\n", lines), 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def profile_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct composite keys, null keys, and a hash of the schema."""
    key = F.concat_ws("\u0001", *(F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys))
    missing = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("n_null_keys")
    ).withColumn("schema_sha256", F.sha2(F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)), 256))


def union_exclusions(frames: dict[str, DataFrame]) -> DataFrame:
    """All exclusion logs as one table with their source; columns a log lacks are null."""
    out = None
    for source, frame in frames.items():
        tagged = frame.withColumn("source", F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
