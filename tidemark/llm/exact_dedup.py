"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Rows come in batches. Each batch is folded in memory (a memtable), then flushed as a run of (digest, best entry, number
of rows), sorted in each file, with a filter. Runs merge by level, as in a log-structured tree: entries that the other
run's filter does not know move over as they are; only the others are grouped by digest, where the entry with the most
code points, then the smallest identifier, stays. A digest that stands for more than one row is a hit: the rows that
the hits' filter lets through are verified on their bytes, and a digest of several texts is split into its texts. All
other rows are known to be alone, so their texts are never shuffled.

Nulls: a null text counts as empty, so all null and blank texts are one group. A null identifier ranks after all
others. Rows that repeat an identifier count as rows and share one decision if their texts are equal. An empty table
gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, maybe_in, slot_filter, spill, text_of, without, without_blanks

BATCHES = 4


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points, norm, digest of every row."""
    text = text_of(text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_points"), without_blanks(text).alias("norm"))
    return out.withColumn("digest", F.unhex(F.sha2("norm", 256)))


def rank() -> Column:
    """Orders the rows of a group: the longest original, then the smallest identifier, null last."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


def flush(entries: DataFrame) -> DataFrame:
    """A run: digest, best, n; sorted in each file, with Parquet's own Bloom filter for lookups of single digests."""
    options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"}
    return spill(entries.sortWithinPartitions("digest"), "digest-run", **options)


def memtable(rows: DataFrame) -> DataFrame:
    """One entry for each digest of a batch."""
    return rows.groupBy("digest").agg(F.min(rank()).alias("best"), F.count(F.lit(1)).alias("n"))


def probe(entries: DataFrame, run: DataFrame, bits: int) -> DataFrame:
    """``entries`` with ``maybe``: false where the filter of ``run`` tells that it does not hold the digest."""
    return maybe_in(entries, [F.col("digest")], slot_filter(run, ["digest"], bits), bits=bits)


def merge(a: DataFrame, b: DataFrame, bits: int) -> DataFrame:
    """One run of two. Entries that the other run's filter misses need no grouping."""
    both = probe(a, b, bits).unionByName(probe(b, a, bits))
    met = both.where("maybe").groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return flush(both.where("not maybe").select("digest", "best", "n").unionByName(met))


def build_index(rows: DataFrame, batches: int, bits: int) -> DataFrame:
    """digest, best, n: one entry for each digest of ``rows`` (digest, doc_id, n_points, batch)."""
    levels: dict[int, DataFrame] = {}
    for batch in range(batches):
        level, run = 0, flush(memtable(rows.where(F.col("batch") == batch)))
        while level in levels:
            run, level = merge(levels.pop(level), run, bits), level + 1
        levels[level] = run
    runs = [levels[k] for k in sorted(levels)]
    index = runs[0]
    for run in runs[1:]:
        index = merge(run, index, bits)
    return index


def hit_texts(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """digest, norm, best, group_size of the texts of all rows that the filter of ``hits`` lets through; copies fold in each task."""
    rows = maybe_in(keyed(docs, id_col, text_col), [F.col("digest")], slot_filter(hits, ["digest"], bits), bits=bits).where("maybe")
    return rows.groupBy("digest", "norm").agg(F.min(rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, filter_bits: int = 1 << 24) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Texts are equal when identical without blanks; the row with the most code points, then the smallest id, stays.
    ``filter_bits``: size of a run's filter; raise it with the number of rows (8 bits a row pass about an eighth of the misses).
    """
    keys = keyed(docs, id_col, text_col).select("digest", "doc_id", "n_points", F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    rows = spill(keys.sortWithinPartitions("digest"), "digests")
    hits = spill(build_index(rows, batches, filter_bits).where("n > 1").select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size")), "digest-hits")
    texts = hit_texts(docs, hits, id_col, text_col, filter_bits)
    several = spill(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "digest-clashes")
    whole = hits.join(several, "digest", "left_anti")
    met = maybe_in(rows, [F.col("digest")], slot_filter(hits, ["digest"], filter_bits), bits=filter_bits).select("digest", "doc_id", "maybe")
    apart = None
    if several.limit(1).count():  # two texts with one digest: their rows are told apart by their texts
        split = texts.join(several, "digest", "left_semi").select("digest", "norm", F.col("best.id").alias("keep_id"), "group_size")
        apart = keyed(docs, id_col, text_col).join(split, ["digest", "norm"]).select("digest", "doc_id", "keep_id", "group_size")
        met = met.join(several, "digest", "left_anti")
    total = hits.agg(F.sum("group_size")).first()[0] or 0
    joined = heavy_join(met.where("maybe").drop("maybe"), whole, ["digest"], "group_size", total, "left")
    alone = met.where("not maybe").select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    one = F.col("group_size").isNull()
    both = joined.select("digest", "doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    both = both.unionByName(alone)
    both = both if apart is None else both.unionByName(apart)
    return both.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat identifier and text, all stay.

    Rows to drop are named by identifier and digest, so that another text under a dropped identifier stays.
    """
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(without_blanks(text_of(text_col)), 256)) == F.col("__digest"))
    return without(docs, spill(gone, "digests-gone"), F.col(id_col), "__id", same)
