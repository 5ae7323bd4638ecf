"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that all executors share, under the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) uses the machine's temporary folder; a cluster is refused, because
    each executor would write to its own disk. Deleting the folder after a run clears all scratch tables of the run.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def spill(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HEAVY_SHARE = 1000


def heavy_join(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key and, in ``weight``, the number of its rows in ``big``.

    Keys that hold a thousandth of all ``total`` rows or more, of which there can be a thousand at most, are looked up first
    and broadcast, so that no task gets all rows of a hot key; the others are shuffled. ``how``: inner or left. Keys must
    not be null.
    """
    hot = F.col(weight) * HEAVY_SHARE >= total
    rows = small.where(hot).collect()  # a thousand rows at most
    if not rows:
        return big.join(small, keys, how)
    heavy = F.broadcast(big.sparkSession.createDataFrame(rows, small.schema))
    rest = big.join(heavy.select(*keys), keys, "left_anti").join(small.where(~hot), keys, how)
    return big.join(heavy, keys).unionByName(rest)


def slots(keys: list[Column], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))


def slot_filter(rows: DataFrame, keys: list[str], bits: int = 1 << 24) -> DataFrame:
    """bucket, bitmap: the hash slots that the keys of ``rows`` take, as bitmaps of 4 KB.

    The size is fixed by ``bits`` (a power of two, 2 MB by default), so that it can be broadcast whatever the input; a
    fuller filter lets more rows through, but never drops one.
    """
    slot = slots([F.col(k) for k in keys], bits)
    taken = rows.select(F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit(32767)).alias("at")).distinct()
    return taken.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def maybe_in(rows: DataFrame, keys: list[Column], filter_: DataFrame, name: str = "maybe", bits: int = 1 << 24) -> DataFrame:
    """Adds ``name``: false where the row's key is in none of the filter's rows; true where it is, and now and then else."""
    slot = slots(keys, bits)
    held = filter_.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(shiftright(__slot & 32767, 3) as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(power(2, __slot & 7) as int)")
    joined = rows.withColumn("__slot", slot).join(F.broadcast(held), F.shiftright("__slot", 15) == F.col("__bucket"), "left")  # fixed size
    return joined.withColumn(name, F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False))).drop("__slot", "__bucket", "__bitmap")


def without(docs: DataFrame, gone: DataFrame, own: Column, name: str, same: Column) -> DataFrame:
    """The rows of ``docs`` for which no row of ``gone`` holds ``same``; only rows whose ``own`` key may be among the ``name`` of ``gone`` are shuffled."""
    tagged = maybe_in(docs, [own], slot_filter(gone, [name]), "__maybe")
    rest = tagged.where("__maybe").drop("__maybe").join(gone, same, "left_anti")
    return tagged.where("not __maybe").drop("__maybe").unionByName(rest)


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without_blanks(text: Column) -> Column:
    """Delete every character of [\\x20\\x09-\\x0D]; byte-wise replaces are cheaper than a pattern."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, sorted by start, then kind order, then end; comma-joined."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


BLOCK = 256


def match_spans(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, ord, end, kind, value>>, offsets in code points.

    The pieces between matches (``split``) and the matches themselves give the offsets by adding lengths, first over
    blocks of matches, then inside each: a fold that appends copies what it has, so none runs over all matches.
    ``least``: shorter values (of ``group``) are dropped after matching, without a retry.
    """
    rx = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, rx, F.lit(group)).alias("value"),
    )
    empty = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string>>)")
    long = lambda n: F.lit(n).cast("long")

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            start.cast("long").alias("start"), F.lit(order).alias("ord"), end.cast("long").alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")
        )
        return F.struct(
            end.cast("long").alias("pos"),
            F.when(F.length(x["value"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    hits = F.filter(zipped, lambda x: x["hit"].isNotNull())
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.slice(hits, b * BLOCK + 1, BLOCK))
    lengths = F.transform(blocks, lambda h: F.aggregate(h, long(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
    starts = F.aggregate(lengths, F.array(long(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    spans = F.transform(F.arrays_zip(blocks.alias("hits"), starts.alias("pos")), lambda z: F.when(z["hits"].isNotNull(), F.aggregate(z["hits"], F.struct(z["pos"].alias("pos"), empty.alias("out")), step)["out"]).otherwise(empty))
    return F.when(text.rlike(pattern), F.flatten(spans)).otherwise(empty)
