"""Repeated-substring removal by threshold-bounded interval expansion.

Every string of ``length`` bytes holds an anchor that its own bytes choose: the smallest hashed ``seed``-byte string in
it. Equal strings choose equal anchors at equal places, so anchors are shuffled instead of positions. Places that share
an anchor form an interval. An interval whose surroundings (all bytes of any window over the anchor) are equal
throughout is settled by their hash. The others are expanded: places are sorted by the text that follows (a suffix
array of the interval, with its common prefixes); the column of preceding bytes is its Burrows-Wheeler transform, and
breadth-first backward extension by that column splits intervals byte by byte, by increasing depth. Single places are
dropped, and a place is repeated at a depth if the common prefix with a neighbour reaches ``length``, where it stops.

Null and empty texts have no bytes; texts under ``length`` bytes stay whole. Rows that repeat identifier and text are
documents of their own, which repeat each other. An empty table gives an empty result. Other columns of the input are
ignored, whatever their names. Very many places at one anchor (over ``HOT``) are settled with Spark aggregation instead
of in one task, and expanded so, window by window, if they have very many different surroundings (over ``EXPANDED``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import C1, C2, chunks, mix, prefix_sums, ranges
from .common import heavy_join, maybe_in, slot_filter, spill, text_of

LENGTH, SEED = 200, 32
#: Places of one anchor that one task may settle, and different surroundings of one that it may expand; anchors with more
#: are settled and expanded by Spark's aggregation. Both ways give the same result.
HOT, EXPANDED = 10_000, 50_000
KEY = "doc_id long, th long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc_id, th, text: a row is named by its identifier (0 for null) and a hash of its text and of being null."""
    text, own = text_of(text_col), F.col(id_col).cast("long")
    return docs.select(own.alias("id"), F.coalesce(own, F.lit(0)).alias("doc_id"), F.xxhash64(text, own.isNull()).alias("th"), text.alias("text"))


def anchors_of(texts: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, hash of the surroundings) of all anchors of some texts."""
    width = length - seed + 1
    out = []
    for a, b in chunks(texts, 1 << 20):
        sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
        if not (sizes >= length).any():
            continue
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
        n = len(data)
        prefix = prefix_sums(data)
        start = np.arange(n - seed + 1)
        h = ranges(prefix, start, start + seed)
        low = np.uint64((1 << max(20, int(n).bit_length())) - 1)
        value = (h & ~low) | start.astype(np.uint64)  # by hash, then leftmost
        pad = -len(value) % width
        blocks = np.concatenate((value, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
        left, right = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: n - length + 1], left[width - 1 : width - 1 + n - length + 1])
        row = np.repeat(np.arange(b - a), sizes)
        whole = row[: n - length + 1] == row[length - 1 :]
        place = np.unique(least[whole] & low).astype(np.int64)
        of = row[place]
        lo, hi = np.maximum(place - (width - 1), offsets[of]), np.minimum(place + length, offsets[of + 1])
        around = mix(ranges(prefix, lo, hi) + (place - lo).astype(np.uint64) * C1)
        out.append((of + a, place - offsets[of], h[place], around))
    return tuple(np.concatenate(x) if out else np.zeros(0, dtype=np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))


def anchor_table(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """h, c, n, doc_id, th, p: all anchors; c hashes the surroundings.

    Equal surroundings of one batch fold at once: the first stands for the others (n = 2), which are settled (n = 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            docs, th, text = x.column(0), x.column(1), x.column(2).cast(pa.binary())
            parts = []
            for k in range(0, x.num_rows, 1000):
                of, place, h, c = anchors_of([t.as_py() for t in text[k : k + 1000]], length, seed)
                parts.append((of + k, place, h, c))
            of, place, h, c = (np.concatenate(z) for z in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
            if not len(of):
                continue
            order = np.lexsort((c, h))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))
            size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            n = np.empty(len(of), dtype=np.int32)
            n[order] = np.where(new, np.minimum(size, 2), 0)
            at = pa.array(of)
            columns = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n), docs.take(at), th.take(at), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "n", "doc_id", "th", "p"])

    return texts.select("doc_id", "th", "text").mapInArrow(run, f"h long, c long, n int, {KEY}, p int")


def settle(anchors: DataFrame) -> DataFrame:
    """Anchors that several places share. kind 0: its surroundings are repeated; 1: that, and one of them to compare with; 2: to be expanded."""
    hot = anchors.groupBy("h").agg(F.sum("n").alias("places")).where(F.col("places") > HOT).select("h")
    hot = spill(hot, "hot-anchors")
    normal = settled_in_tasks(anchors.join(hot, "h", "left_anti"))
    return normal.unionByName(settled_by_counts(anchors.join(hot, "h", "left_semi")))


def settled_by_counts(anchors: DataFrame) -> DataFrame:
    """``settle`` for anchors with very many places: surroundings are counted, then told to the places."""
    place = F.struct("doc_id", "th", "p")
    contexts = anchors.groupBy("h", "c").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("rows"), F.min(place).alias("first"))
    contexts = spill(contexts, "hot-contexts")
    different = F.count(F.lit(1))
    per = contexts.groupBy("h").agg((different > 1).alias("several"), (different > EXPANDED).alias("hot"))  # one row for each hot anchor
    contexts = spill(contexts.join(F.broadcast(per), "h"), "hot-kinds")
    total = contexts.agg(F.sum("rows")).first()[0] or 0
    told = heavy_join(anchors, contexts, ["h", "c"], "rows", total)
    repeated, first = F.col("places") > 1, F.struct("doc_id", "th", "p") == F.col("first")
    kind = F.when(repeated & first & F.col("several"), 1).when(repeated, 0).when(F.col("several"), 2).otherwise(-1)
    return told.select("h", "doc_id", "th", "p", kind.alias("kind"), "hot").where("kind >= 0")


def settled_in_tasks(anchors: DataFrame) -> DataFrame:
    """``settle`` for anchors with ``HOT`` places at most, sorted by anchor and surroundings in each task."""

    def decide(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        group, context = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        size_c = np.bincount(context, weights=n)[context]
        contexts = np.bincount(group, weights=new_c)[group]
        size_h = np.bincount(group, weights=n)[group]
        kind = np.where(size_c > 1, np.where(new_c & (contexts > 1), 1, 0), np.where(contexts > 1, 2, -1))
        return np.where(size_h > 1, kind, -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)  # the rest has HOT rows at most
            cut = int(np.searchsorted(x["h"].to_numpy(), x["h"].iloc[-1]))
            rest, x = x.iloc[cut:], x.iloc[:cut]
            if len(x):
                yield judged(x)
        if rest is not None and len(rest):
            yield judged(rest)

    def judged(x: pd.DataFrame) -> pd.DataFrame:
        kind = decide(x["h"].to_numpy(), x["c"].to_numpy(), x["n"].to_numpy())
        return x.assign(kind=kind.astype(np.int32), hot=False)[kind >= 0][["h", "doc_id", "th", "p", "kind", "hot"]]

    return anchors.repartition("h").sortWithinPartitions("h", "c").mapInPandas(run, f"h long, {KEY}, p int, kind int, hot boolean")


def common_prefixes(rows: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before; 0 first."""
    out = np.zeros(len(rows), dtype=np.int64)
    if len(rows) < 2:
        return out
    width = max(map(len, rows))
    table = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width)
    size = np.array([len(r) for r in rows])
    differs = table[1:] != table[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def expand(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, depth) of all windows rights-with-``depth``-preceding-bytes that another place of the group has as well.

    group: number of each row's interval; lefts: the bytes before the anchor; rights: those from it on.
    """
    order = np.array(sorted(range(len(group)), key=lambda i: (group[i], rights[i])), dtype=np.int64)
    common = common_prefixes([rights[i] for i in order])
    reach = np.array([len(lefts[i]) for i in order])
    width = max(reach.max(initial=0), 1)
    before = np.frombuffer(b"".join(lefts[i].rjust(width, b"\0") for i in order), dtype=np.uint8).reshape(len(order), width)
    label = np.asarray(group)[order].astype(np.int64)
    live = np.arange(len(order))  # in suffix order inside each interval
    common[np.append(True, label[1:] != label[:-1])] = 0
    rows, depths = [], []
    for depth in range(length):
        new = np.append(True, label[1:] != label[:-1])
        common = np.where(new, 0, common)
        met = common >= length - depth
        met |= np.append(met[1:], False)
        rows.append(order[live[met]])
        depths.append(np.full(int(met.sum()), depth))
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        keep = (reach[live] > depth) & (size > 1)
        if depth + 1 >= length or keep.sum() < 2:
            break
        number = np.cumsum(new) - 1  # extend each interval by the preceding byte
        live, kept = live[keep], np.flatnonzero(keep)
        byte = before[live, width - 1 - depth].astype(np.int64)
        by = np.argsort(number[keep] * 256 + byte, kind="stable")
        label = (number[keep] * 256 + byte)[by]
        common = range_minima(common, kept[by], label)
        live = live[by]
    return np.concatenate(rows), np.concatenate(depths)


def range_minima(common: np.ndarray, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Common prefix of each place with the one before it in its new interval: the minimum over the old places between."""
    out = np.zeros(len(at), dtype=np.int64)
    if len(at) < 2:
        return out
    lo, hi = at[:-1] + 1, at[1:]
    ok = (label[1:] == label[:-1]) & (hi >= lo)
    near = ok & (hi == lo)
    out[1:][near] = common[hi[near]]
    far = np.flatnonzero(ok & (hi > lo))
    if len(far):
        a, b = lo[far], hi[far] + 1
        level = np.floor(np.log2(b - a)).astype(np.int64)
        result = np.empty(len(far), dtype=np.int64)
        table = common
        for k in range(int(level.max()) + 1):
            pick = level == k
            if pick.any():
                result[pick] = np.minimum(table[a[pick]], table[b[pick] - (1 << k)])
            table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
        out[1:][far] = result
    return out


def surroundings(texts: DataFrame, places: DataFrame, length: int, seed: int) -> DataFrame:
    """h, doc_id, th, p, kind, back, around: the bytes of all windows over an anchor; ``back`` of them precede it."""
    need = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "p", "kind")).alias("at"))  # once, however many rows repeat the text
    joined = texts.join(need, ["doc_id", "th"]).select("id", "doc_id", "th", "text", "at")  # with id, so that the last join reuses this exchange of texts
    back = length - seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for _, d, th, text, at in x.itertuples(index=False):
                data = text.encode("utf-8", "surrogatepass")
                out += [(a["h"], d, th, a["p"], a["kind"], min(back, a["p"]), data[max(0, a["p"] - back) : a["p"] + length]) for a in at]
                if len(out) > 5000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["h", "doc_id", "th", "p", "kind", "back", "around"])

    return joined.mapInPandas(run, f"h long, {KEY}, p int, kind int, back int, around binary")


def expanded(contexts: DataFrame, length: int, most: int = 40_000) -> DataFrame:
    """doc_id, th, start, end: repeated runs found by expansion; ``most`` places are expanded at once."""

    def work(x: pd.DataFrame) -> pd.DataFrame:
        rows, depths = expand(np.unique(x["h"].to_numpy(), return_inverse=True)[1], [a[:b] for a, b in zip(x["around"], x["back"], strict=True)], [a[b:] for a, b in zip(x["around"], x["back"], strict=True)], length)
        by = np.lexsort((depths, rows))
        rows, depths = rows[by], depths[by]
        first = np.append(True, (rows[1:] != rows[:-1]) | (depths[1:] != depths[:-1] + 1))[: len(rows)]
        last = np.append(first[1:], True)[: len(rows)]
        y = x.iloc[rows[first]]
        out = pd.DataFrame({"doc_id": y["doc_id"].to_numpy(), "th": y["th"].to_numpy(), "start": y["p"].to_numpy() - depths[last], "end": y["p"].to_numpy() - depths[first] + length})
        return out[(y["kind"] == 2).to_numpy()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for x in batches:
            held.append(x)
            count += len(x)
            if count >= most:
                all_ = pd.concat(held, ignore_index=True)
                cut = int((all_["h"] == all_["h"].iloc[-1]).to_numpy().argmax())  # the last group may go on
                if cut:
                    yield work(all_.iloc[:cut].reset_index(drop=True))
                held, count = [all_.iloc[cut:]], len(all_) - cut
        if count:
            yield work(pd.concat(held, ignore_index=True))

    return contexts.select("h", "doc_id", "th", "p", "kind", "back", "around").repartition("h").sortWithinPartitions("h").mapInPandas(run, f"{KEY}, start int, end int")


def hot_windows(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, th, start, end for anchors with very many places: each window is a row, and equal ones fold in each task."""
    last = F.least(F.col("back"), F.lit(length))
    depths = F.filter(F.sequence(F.lit(0), last), lambda d: F.octet_length("around") - F.col("back") + d >= length)
    each = contexts.select("h", "doc_id", "th", "p", "kind", "back", "around", F.explode(depths).alias("depth"))
    window = F.sha2(F.expr(f"substring(around, back - depth + 1, {length})"), 256)
    each = each.select("h", "depth", "doc_id", "th", "kind", (F.col("p") - F.col("depth")).alias("start"), F.unhex(window).alias("w"))
    same = ["h", "depth", "w"]  # one window can hold several anchors: only equal depths at equal anchors are two places
    often = spill(each.groupBy(same).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == 2).alias("n")).where("rows > 1 and n > 0"), "hot-windows")
    total = often.agg(F.sum("n")).first()[0] or 0
    return heavy_join(each.where("kind = 2"), often, same, "n", total).select("doc_id", "th", "start", (F.col("start") + length).alias("end"))


def repeated_runs(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, th, start, end: byte ranges (ends may pass the text's) that together cover all repeated strings."""
    anchors = spill(anchor_table(texts, length, seed), "anchors")
    shared = spill(settle(anchors.where("n > 0")), "shared-anchors")
    runs = expanded(surroundings(texts, shared.where("kind > 0 and not hot"), length, seed), length)
    hot = shared.where("kind > 0 and hot")
    if hot.limit(1).count():
        some = maybe_in(texts, [F.col("doc_id"), F.col("th")], slot_filter(hot, ["doc_id", "th"])).where("maybe").drop("maybe")
        runs = runs.unionByName(hot_windows(spill(surroundings(some, hot, length, seed), "surroundings"), length))
    folded = anchors.where("n = 0").select("doc_id", "th", "p").unionByName(shared.where("kind < 2").select("doc_id", "th", "p"))
    same = folded.select("doc_id", "th", (F.col("p") - (length - seed)).alias("start"), (F.col("p") + length).alias("end"))
    return same.unionByName(runs)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes): one row for each row of ``docs``."""
    texts = keyed(docs, id_col, text_col)
    runs = repeated_runs(texts, length, seed)
    per = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("runs"))  # rows that repeat a text find the same runs
    joined = texts.join(per, ["doc_id", "th"], "left").select(
        F.col("id").alias("doc_id"), "text", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for text, starts, ends in zip(x.column(1).cast(pa.binary()), x.column(2), x.column(3), strict=True):
                data = text.as_py()
                n = len(data)
                if not starts.is_valid:
                    out.append((n, 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                lo = np.clip(starts.values.to_numpy(zero_copy_only=False), 0, n)
                hi = np.clip(ends.values.to_numpy(zero_copy_only=False), 0, n)
                steps = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
                gone = np.cumsum(steps)[:n] > 0
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
