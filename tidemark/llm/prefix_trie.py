"""The trie of conversation prefixes, from conversations in sorted order and the longest common prefixes of neighbours.

A conversation is the sequence of SHA-256 digests of its turns; sorted by those sequences, the members of a prefix stand
side by side. Conversations are range-partitioned and sorted, and each part is worked by itself: the common prefixes of
its neighbours go into a sparse table of range minima, and every candidate prefix finds the last conversation, every
first prefix of a row the first one, by a binary search over that table; no stack, no recursion. Prefixes of a part's
first or last conversation may go on in the next part: these open ones carry sums that add up over parts and are merged
by their digest, a row a part. All others are complete within their part.

Sums that add up, of a prefix of d turns: members; first children (rows whose common prefix with the row before has at most
d turns, and which go on); leaves (rows that the next row does not go on from); bytes of all members' turns from the
d-th on, less the bytes of each distinct prefix below, counted where it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import heavy_join, spill, text_of

WIDTH = 32
PART_BYTES = 8 << 20
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
PIECES = "own binary, above binary, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string"


def turn_token(role: Column, text: Column) -> Column:
    """Hex SHA-256 of role and text; the role's length keeps pairs apart that join to the same string."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (token, bytes of the text) in order of turn, null first; ties by role, then by the token.

    Null role or text becomes empty; rows with a null conversation belong to none and are left out.
    """
    role, text = text_of(F.col(role_col).cast("string")), text_of(F.col(text_col).cast("string"))
    one = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), turn_token(role, text).alias("token"), F.octet_length(text).alias("bytes"))
    grouped = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    return grouped.select("conv_id", F.expr("transform(turns, x -> struct(x.token as token, x.bytes as bytes))").alias("turns"))


def with_shared_heads(convs: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % ``group`` (all if fewer, none if absent), h = crc32(decimal c) % ``heads``; its own turns follow after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    x = convs.withColumn("h", h.cast("int")).withColumn("lead", F.col("conv_id") - F.col("conv_id") % group)
    leads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, heads - 1).alias("head"))
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    head = F.expr("slice(coalesce(head, cast(array() as array<struct<token:string,bytes:int>>)), 1, h)")
    return x.join(leads, "lead", "left").select("conv_id", F.concat(head, own).alias("turns"))


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of turns that two sequences start with in common, by halving."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[:WIDTH] != b[:WIDTH]:
        return 0
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid - 1)
    return low


class RangeMinimum:
    """Minima of any range of an array, from those of all ranges of 1, 2, 4, ... entries."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.levels[k][first[on]], self.levels[k][last[on] - (1 << k) + 1])
        return out

    def last_from(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all entries after ``at`` are ``least`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            fits = at + 1 < len(table)
            fits[fits] = table[at[fits] + 1] >= least[fits]
            at[fits] += 1 << k
        return at

    def first_to(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which all entries after it up to ``at`` are ``least`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) >= 0
            fits[fits] = self.levels[k][at[fits] - (1 << k) + 1] >= least[fits]
            at[fits] -= 1 << k
        return at


def prefix_digests(key: bytes) -> list[bytes]:
    """SHA-256 of each prefix of a sequence, the empty one first."""
    state = hashlib.sha256()
    out = [state.digest()]
    for i in range(0, len(key), WIDTH):
        state.update(key[i : i + WIDTH])
        out.append(state.digest())
    return out


def part_nodes(part: int, keys: list[bytes], convs: np.ndarray, sizes: np.ndarray, before: bytes | None, after: bytes | None) -> pa.Table:
    """All prefixes of a part's conversations, sorted by (key, conversation), as rows of ``PIECES``.

    sizes: bytes of all turns, one conversation after another. before, after: the sequences beside the part.
    """
    rows, length = len(keys), np.array([len(k) // WIDTH for k in keys])
    lcp = np.array([-1, *(common_prefix(a, b) for a, b in pairwise(keys))])
    left = -1 if before is None else common_prefix(before, keys[0])
    right = -1 if after is None else common_prefix(keys[-1], after)
    table, ids = RangeMinimum(lcp), RangeMinimum(convs)

    # candidates, in order of row and depth: each prefix at its first row
    count = length - lcp
    start = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(rows), count)
    depth = np.arange(start[-1]) - start[row] + lcp[row] + 1
    last = table.last_from(row, depth)
    lowest = ids.of(row, last)

    # the parent stands just before, or is the prefix that the first one of a row shares with the row before
    parent = np.arange(len(row)) - 1
    top = start[1:-1][count[1:] > 0]
    holder = table.first_to(row[top], lcp[row[top]])
    parent[top] = start[holder] + lcp[row[top]] - lcp[holder] - 1

    turns = np.append(0, np.cumsum(length))
    upto = np.append(0, np.cumsum(sizes))
    text = np.where(depth > 0, sizes[np.maximum(turns[row] + depth - 1, 0)] if len(sizes) else 0, 0)
    whole = np.append(0, np.cumsum(upto[turns[1:]] - upto[turns[:-1]]))
    earlier = np.where(depth > 0, upto[np.maximum(turns[row] + depth - 1, 0)] - upto[turns[row]], 0)
    n = last - row + 1
    starts_here = (row > 0) | (depth > left)
    distinct = np.append(0, np.cumsum(np.where(starts_here, text, 0)))
    saved = whole[last + 1] - whole[row] - n * earlier - (distinct[start[last + 1]] - distinct[: len(row)])
    ends_leaf = np.append(0, np.cumsum(np.append(lcp[1:], right) < length))
    leaves = ends_leaf[last + 1] - ends_leaf[row]
    children = np.bincount(parent[starts_here & (parent >= 0)], minlength=len(row))

    # conversations that end at a prefix are the first of its members, next to one another
    same = np.append(lcp[1:] == length[1:], False) & np.append(length[1:] == length[:-1], False)
    group_end = np.flatnonzero(~same)
    own_end = group_end[np.searchsorted(group_end, row)]
    ended = np.where(depth == length[row], own_end - row + 1, 0)
    open_ = ((row == 0) & (depth <= left)) | ((last == rows - 1) & (depth <= right))
    names = [str(c) for c in convs]
    ends = [",".join(names[r : r + k]) if k else "" for r, k in zip(row.tolist(), ended.tolist(), strict=True)]
    digests = {0: prefix_digests(keys[0]), rows - 1: prefix_digests(keys[-1])}
    name = lambda i: digests[0 if row[i] == 0 else rows - 1][depth[i]]  # noqa: E731  open ones are prefixes of the first or last key
    up_open = np.where(parent >= 0, open_[parent], False)
    nothing = hashlib.sha256(b"").hexdigest()
    return pa.table(
        {
            "own": pa.array([name(i) if o else None for i, o in enumerate(open_)], pa.binary()),
            "above": pa.array([name(p) if u else None for p, u in zip(parent, up_open, strict=True)], pa.binary()),
            "part": pa.array(np.full(len(row), part), pa.int32()),
            "conv_id": lowest,
            "depth": depth,
            "parent_conv_id": pa.array(lowest[parent], pa.int64(), mask=(parent < 0) | up_open),
            "n_convs": n,
            "n_children": children,
            "n_leaves": leaves,
            "saved_tokens": saved,
            "ends": pa.array(ends, pa.string(), mask=~open_),
            "ends_sha256": pa.array([None if o else hashlib.sha256(e.encode()).hexdigest() if e else nothing for o, e in zip(open_, ends, strict=True)], pa.string()),
        }
    ).cast(pa.schema([("own", pa.binary()), ("above", pa.binary()), ("part", pa.int32()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", *SUMS)), ("ends", pa.string()), ("ends_sha256", pa.string())]))


def merged(opened: DataFrame) -> DataFrame:
    """Open prefixes, one row each: sums over parts, the smallest conversation, the digest of all that end there.

    Rows are streamed by digest and part, with one prefix's sums and hash state at a time.
    """
    columns = ["own", "above", "conv_id", "depth", *SUMS, "ends"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, some = None, None, False

        def closed() -> pd.DataFrame:
            return pd.DataFrame([[*held, state.hexdigest()]], columns=[*columns[:-1], "ends_sha256"])

        for batch in batches:
            out = []
            for own, above, conv, depth, *sums, ends in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held is None or held[0] != own:
                    if held is not None:
                        out.append(closed())
                    held, state, some = [own, above, conv, depth, *sums], hashlib.sha256(), False
                else:
                    held[2] = min(held[2], conv)
                    held[4:] = [x + y for x, y in zip(held[4:], sums, strict=True)]
                if ends:
                    state.update(("," if some else "").encode() + ends.encode())
                    some = True
            yield from (pa.RecordBatch.from_pandas(x, schema=schema, preserve_index=False) for x in ([pd.concat(out)] if out else []))
        if held is not None:
            yield pa.RecordBatch.from_pandas(closed(), schema=schema, preserve_index=False)

    schema = pa.schema([("own", pa.binary()), ("above", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", *SUMS)), ("ends_sha256", pa.string())])
    rows = opened.select(*columns, "part").repartition("own").sortWithinPartitions("own", "part").drop("part")
    return rows.mapInArrow(fold, "own binary, above binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def edges(parts: DataFrame) -> DataFrame:
    """part, before, after: the last sequence of the part before and the first one of the next; a row a part."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            part = x.column("part").to_numpy()
            firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            lasts = np.append(firsts[1:], len(part)) - 1 if len(part) else []
            for i, j in zip(firsts, lasts, strict=True):
                yield pa.RecordBatch.from_arrays([x.column("part")[i : i + 1], x.column("key")[i : i + 1], x.column("key")[j : j + 1]], ["part", "low", "high"])

    seen = parts.select("part", "key").mapInArrow(ends, "part int, low binary, high binary")
    each = seen.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.orderBy("part")  # a row a part
    return each.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))


def prefix_trie(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each distinct prefix of the conversations (conv_id, turns as of ``sequences``), the empty one too.

    conv_id (smallest member), depth, parent_conv_id (null for the empty prefix), n_convs (members), n_children, n_leaves,
    saved_tokens (over all prefixes below and itself: members less one, times the bytes of the last text), ends_sha256 (of
    the comma-joined identifiers of members with no further turn, ascending). Conversations without turns are members of
    the empty prefix; equal conversations share all; without conversations there is no row. A conversation is one row
    of 32 bytes and one integer a turn. ``parts``: about so many sorted parts, by default as many as keep one near 8 MB.
    """
    keyed = convs.select(F.unhex(F.array_join(F.expr("transform(turns, x -> x.token)"), "")).alias("key"), "conv_id", F.expr("transform(turns, x -> x.bytes)").alias("sizes"))
    keyed = spill(keyed, "trie-keys")
    if parts is None:
        held = keyed.agg(F.sum(F.octet_length("key"))).first()[0] or 0  # one row
        parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // PART_BYTES + 1)
    ranged = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ranged = spill(ranged.withColumn("part", F.spark_partition_id()), "trie-parts")

    def build(rows: pa.Table, beside: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("conv_id", "ascending")]).combine_chunks()
        before, after = beside["before"][0].as_py(), beside["after"][0].as_py()
        sizes = rows["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return part_nodes(rows["part"][0].as_py(), rows["key"].to_pylist(), rows["conv_id"].to_numpy().astype(np.int64), sizes, before, after)

    nodes = spill(ranged.groupBy("part").cogroup(edges(ranged).groupBy("part")).applyInArrow(build, PIECES), "trie-nodes")
    opened = spill(merged(nodes.where("own is not null")), "trie-open")
    out = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    whole = nodes.where("own is null").select("above", *out)
    every = whole.unionByName(opened.select("above", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), *SUMS, "ends_sha256"))
    ups = opened.select(F.col("own").alias("above"), F.col("conv_id").alias("up"), F.col("n_children").alias("weight"))
    hung = heavy_join(every.where("above is not null"), ups, ["above"], "weight", nodes.count()).withColumn("parent_conv_id", F.col("up"))
    return every.where("above is null").select(*out).unionByName(hung.select(*out))
