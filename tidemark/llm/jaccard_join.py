"""N-gram Jaccard self-join with signature trees, and the groups its links form.

A node is a distinct shingle set, so exact copies are one node. Sets that can reach the similarity differ in at most
``bound`` shingles; cut into more non-empty parts than that, they share a whole part. A first pass only counts the
parts that a set shares with any other; sets that share fewer than a link takes have none, and a second pass leaves them
out. In the second pass each set leaves out its most frequent shared parts, one fewer than a link takes: linked sets
still share one of the others, while the parts that unlike texts share by chance are frequent ones and no longer join
them. Sets that share one of these rarer parts form candidate clusters. In each cluster, signature trees (nodes with OR-combined token bitmaps and size ranges) are
traversed in pairs: a pair of tree nodes is dropped if the largest possible overlap cannot reach the similarity, or if
all below it is linked already; what remains is counted exactly. Large clusters are cut into blocks of bounded bytes,
and pairs of blocks are the units of work, so no task holds more than two blocks and their bitmaps, which are bounded too
(``MAP_BYTES``).

Null and empty texts have no shingles and link with nothing. Rows that repeat an identifier are one document, whether
their texts are equal or not: they share a component. Rows with null identifiers link others, and get a null component.
An empty table gives an empty result. Ties cannot matter: the component is the smallest identifier. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, shingle_sets
from .common import heavy_join, maybe_in, slot_filter, spill, text_of, without
from .components import connected_components

BLOCK_BYTES = 8 << 20
MAP_BYTES = 12 << 20
BUCKET_SIGNATURES = 150_000


def size_classes(percent: int, largest: int) -> np.ndarray:
    """Lower ends of size classes; linked sets are in one class or in neighbouring ones.

    Every end follows from the one before, so an index has the same end whatever the largest set; two ends more than
    needed to place ``largest`` give its next class both of its ends.
    """
    ends = [1]
    while len(ends) < 3 or ends[-3] <= largest:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 100 // percent)))
    return np.array(ends, dtype=np.int64)


def part_signatures(sets: list[np.ndarray], percent: int) -> list[list[tuple[np.ndarray, int]]]:
    """Each set's signatures, for its own size class and for the next, with the number it must share to have a link.

    Linked sets differ in at most ``bound`` shingles, so of a set's non-empty parts all but ``bound`` are whole in any
    partner. A quarter more parts than needed makes that number telling. Only a set with too few non-empty parts also
    sends its empty ones.
    """
    ends = size_classes(percent, max((len(s) for s in sets), default=1))
    out = []
    for s in sets:
        own = int(np.searchsorted(ends, len(s), "right")) - 1
        both = []
        for j in (own, own + 1) if len(s) else ():
            bound = int(2 * (ends[j + 1] - 1) * (100 - percent) // (100 + percent))
            parts = bound + 1 + (bound + 4) // 4
            part = ((s >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, part, mix(s ^ np.uint64(0x5BD1E995)))
            full = np.unique(part)
            need = max(1, len(full) - bound)
            full = full if len(full) > bound else np.arange(parts)
            both.append((mix(mix(sums[full] + full.astype(np.uint64)) + np.uint64(ends[j])), need))
        out.append(both)
    return out


def set_node(s: np.ndarray) -> int | None:
    """A 64-bit, even name of a shingle set; None for the empty one."""
    if not len(s):
        return None
    salted = np.append(mix(s + np.uint64(7)), np.uint64(len(s)))
    name = mix(np.array([np.bitwise_xor.reduce(salted)]) * np.uint64(3) + np.array([salted.sum(dtype=np.uint64)]))
    return int(name.view(np.int64)[0]) & ~1


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches in slices with their texts (the last column), so that few texts and sets are Python objects at once."""
    for x in batches:
        for k in range(0, x.num_rows, rows):
            y = x.slice(k, rows)
            yield y, [t.as_py() for t in y.column(y.num_columns - 1).cast(pa.binary())]
        pa.default_memory_pool().release_unused()  # an idle worker keeps no buffers of a batch


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (a hash of identifier and text), n_shingles, node of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, texts in sliced(batches):
            sets = shingle_sets(texts, width)
            found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_node(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *found], ["doc_id", "th", "n_shingles", "node"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n_shingles long, node long")


LINK, SHARED, NEED, NODE, PART = range(5)


def fold(sig: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The smallest member of each distinct signature, and what the others tell: links, and how many each member shares.

    A member is a set in one of its two size classes (its name, plus 0 or 1).
    """
    order = np.lexsort((member, sig))
    sig, member = sig[order], member[order]
    if not len(sig):
        return sig, member, []
    new = np.append(True, sig[1:] != sig[:-1])
    heads = member[new][np.cumsum(new) - 1] & ~1
    other = (member & ~1) != heads
    links = np.unique(np.stack([member & ~1, heads])[:, other], axis=1)
    group = np.cumsum(new) - 1
    shared = np.bincount(group, weights=other) > 0
    who, count = np.unique(member[shared[group]], return_counts=True)
    return sig[new], member[new], [(LINK, links[0], links[1]), (SHARED, who, count)]


PACKED = "bucket int, sigs binary, owner binary, members binary, facts binary"


def packed_by_bucket(sig: np.ndarray, member: np.ndarray, facts: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, base: int | None = None) -> pa.RecordBatch:
    """Signatures with their members, a row for each bucket, and a row with facts.

    sigs: 40-bit (the bucket tells more); owner: 16-bit places in members (64-bit), or, with one member, what is to be added
    to it; facts: kind, a and b as 64-bit rows.
    """
    bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = order[lo:hi]
        own, owner = (np.array([base]), member[rows] - base) if base is not None else np.unique(member[rows], return_inverse=True)
        low = np.ascontiguousarray(sig[rows]).view(np.uint8).reshape(-1, 8)[:, :5]
        out.append((int(bucket[rows[0]]), low.tobytes(), owner.astype(np.uint16).tobytes(), own.tobytes(), b""))
    if facts:
        told = np.concatenate([np.stack([np.full(len(a), k), a, b]) for k, a, b in facts], axis=1).astype(np.int64)
        out.append((int(abs(told[1:].sum()) % buckets), b"", b"", b"", told.tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["bucket", "sigs", "owner", "members", "facts"])


def slice_name(nodes: np.ndarray) -> int:
    """A name of a slice of at most 2,048 sets; the next 4,095 numbers are those of its members."""
    salted = mix(nodes.view(np.uint64) + mix(np.arange(len(nodes), dtype=np.uint64)))
    return int(mix(salted.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) & ~4095


def signatures(docs: DataFrame, width: int, percent: int, buckets: int, folded: bool, remembered: int = 1 << 18) -> DataFrame:
    """Packed signatures, dealt out by their value, and what a link of each member takes.

    Sets that a task has just seen are skipped. ``folded``: it also folds what it holds, so that of the sets that share a
    signature only the smallest is sent on, and the shared parts of the others are counted at once; members are then numbers
    in their slice, of two bytes beside a signature (NODE tells the sets), and a set that several tasks hold counts as sharing its parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in sliced(batches, 2000):
            fresh = []
            for s in shingle_sets(texts, width):
                node = set_node(s)
                if node is not None and node not in seen:
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add(node)
                    fresh.append((node, s))
            if not fresh:
                continue
            sigs = part_signatures([s for _, s in fresh], percent)
            nodes = np.array([n for n, _ in fresh], dtype=np.int64)
            base = slice_name(nodes) if folded else None
            names = np.repeat(base + 2 * np.arange(len(nodes)) if folded else nodes, 2) + np.tile([0, 1], len(nodes))
            needs = np.array([need for both in sigs for _, need in both], dtype=np.int64)
            member = np.repeat(names, [len(s) for both in sigs for s, _ in both])
            sig, facts = np.concatenate([s for both in sigs for s, _ in both]), [(NEED, names, needs)]
            if folded:
                sig, member, more = fold(sig, member)
                facts += [(NODE, names, np.repeat(nodes, 2)), *(f for f in more if f[0] == SHARED)]
            yield packed_by_bucket(sig, member, facts, buckets, base)

    return docs.select("text").mapInArrow(run, PACKED)


def by_bucket(packed: DataFrame, buckets: int, told: Callable[[int, np.ndarray, np.ndarray], list[tuple[int, np.ndarray, np.ndarray, np.ndarray | int]]]) -> DataFrame:
    """kind, a, b, n: the facts that are packed already, and what ``told`` finds in each bucket's signatures and members."""

    def frame(facts: list[tuple]) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"kind": np.int32(k), "a": a, "b": b, "n": n}) for k, a, b, n in facts] or [pd.DataFrame({"kind": [], "a": [], "b": [], "n": []}, dtype=np.int64)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        bucket = None
        for x in batches:
            for key, sigs, owner, members, facts in x.itertuples(index=False):
                if facts:
                    kind, a, b = np.frombuffer(facts, dtype=np.int64).reshape(3, -1)
                    yield pd.DataFrame({"kind": kind.astype(np.int32), "a": a, "b": b, "n": 0})
                if not sigs:
                    continue
                if key != bucket and held:
                    yield frame(told(bucket, *map(np.concatenate, zip(*held, strict=True))))
                    held.clear()
                bucket = key
                wide = np.zeros((len(sigs) // 5, 8), dtype=np.uint8)
                wide[:, :5] = np.frombuffer(sigs, dtype=np.uint8).reshape(-1, 5)
                own, place = np.frombuffer(members, dtype=np.int64), np.frombuffer(owner, dtype=np.uint16)
                held.append((wide.view(np.uint64).ravel(), own[0] + place if len(own) == 1 else own[place]))
        if held:
            yield frame(told(bucket, *map(np.concatenate, zip(*held, strict=True))))

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "kind int, a long, b long, n int")


def shared_parts(packed: DataFrame, buckets: int, kind: int) -> DataFrame:
    """kind, a, b: links of sets that share a part, each with the smallest (LINK), or the number of parts a member shares (SHARED); and its need."""
    return by_bucket(packed, buckets, lambda _, sig, member: [(*f, 0) for f in fold(sig, member)[2] if f[0] == kind]).select("kind", "a", "b")


def every_shared_part(packed: DataFrame, buckets: int) -> DataFrame:
    """kind, a, b, n: a member, a part of it that another set has too, and the number of members with that part; and its need."""

    def told(bucket: int, sig: np.ndarray, member: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray | int]]:
        order = np.lexsort((member, sig))
        sig, member = sig[order], member[order]
        once = np.append(True, (sig[1:] != sig[:-1]) | (member[1:] != member[:-1]))
        sig, member = sig[once], member[once]
        new = np.append(True, sig[1:] != sig[:-1])
        n = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        part = (sig | np.uint64(bucket << 40)).view(np.int64)
        return [(PART, member[n > 1], part[n > 1], n[n > 1].astype(np.int32))]

    return by_bucket(packed, buckets, told)


def rare_parts(facts: DataFrame) -> DataFrame:
    """member, parts: of the members that share as many parts as a link takes (``need``), all shared parts but the ``need`` - 1 most frequent ones.

    Linked sets share ``need`` parts. Both order them alike, so the rarest part that they share is among those kept by both.
    """
    per = facts.groupBy(F.col("a").alias("member")).agg(
        F.collect_list(F.when(F.col("kind") == PART, F.struct("n", "b"))).alias("parts"), F.max(F.when(F.col("kind") == NEED, F.col("b"))).cast("int").alias("need")
    )
    rarest = F.slice(F.sort_array("parts"), F.lit(1), F.size("parts") - F.col("need") + 1)
    return per.where(F.size("parts") >= F.col("need")).select("member", F.transform(rarest, lambda x: x["b"]).alias("parts"))


def links_by_parts(rare: DataFrame, buckets: int) -> DataFrame:
    """a, b: sets that share a rare part, each with the smallest that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                x = batch.slice(k, 2000)
                parts = x.column(1)
                member = np.repeat(x.column(0).to_numpy(), parts.value_lengths().to_numpy())
                sig, member, facts = fold(parts.flatten().to_numpy().view(np.uint64), member)
                yield packed_by_bucket(sig, member, [f for f in facts if f[0] == LINK], buckets)

    return shared_parts(rare.select("member", "parts").mapInArrow(run, PACKED), buckets, LINK).select("a", "b")


def signature_buckets(shingles: int | None, percent: int) -> int:
    """So many buckets that the signatures of one fit in a task, whatever the input."""
    return int((shingles or 0) * 5 * (100 - percent) // (100 + percent) // BUCKET_SIGNATURES) + 8


def sets_with_enough_shared(facts: DataFrame) -> DataFrame:
    """node: sets that share as many parts, with all others together, as one link would take."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("b"))
    per = facts.groupBy("a").agg(F.sum(of(SHARED)).alias("shared"), F.max(of(NEED)).alias("need"), F.max(of(NODE)).alias("node"))
    return per.where("shared >= need").select("node").distinct()


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Sets ordered by size; leaves of ``leaf`` sets, inner nodes of ``fan`` children, each with bitmap and size range."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int, leaf: int = 64, fan: int = 8):
        self.order = order
        self.maps = np.zeros((len(order), bits), dtype=np.float32)
        for row, i in enumerate(order):
            self.maps[row, (sets[i] & np.uint64(bits - 1)).astype(np.int64)] = 1
        self.sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
        self.levels = [[(a, min(a + leaf, len(order)), ()) for a in range(0, len(order), leaf)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([(below[k][0], below[min(k + fan, len(below)) - 1][1], tuple(range(k, min(k + fan, len(below))))) for k in range(0, len(below), fan)])
        self.ors = [np.array([self.maps[a:b].max(axis=0) for a, b, _ in level]) for level in self.levels]

    def ranges(self, level: int, k: int) -> tuple[int, int]:
        a, b, _ = self.levels[level][k]
        return int(self.sizes[a]), int(self.sizes[b - 1])


def tree_links(x: SignatureTree, y: SignatureTree, sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Join in ``forest`` what is linked between two trees (or inside one), by dual traversal."""
    same = x is y
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, kx, ly, ky = stack.pop()
        if same and lx == ly and kx > ky:
            continue
        (x0, x1), (y0, y1) = x.ranges(lx, kx), y.ranges(ly, ky)
        if 100 * min(x1, y1) < percent * max(x0, y0):
            continue
        (xa, xb, xs), (ya, yb, ys) = x.levels[lx][kx], y.levels[ly][ky]
        if lx or ly:
            alone = x.maps[xa:xb] @ (1 - y.ors[ly][ky])
            overlap = np.minimum((x.sizes[xa:xb] - alone).max(), y1)
            if overlap * (100 + percent) < percent * (x0 + y0):
                continue
            roots = {forest.find(int(i)) for i in x.order[xa:xb]} if xb - xa <= 4096 else ()
            if len(roots) == 1 and {forest.find(int(i)) for i in y.order[ya:yb]} == roots:
                continue
            if lx >= ly:
                stack += [(lx - 1, k, ly, ky) for k in xs]
            else:
                stack += [(lx, kx, ly - 1, k) for k in ys]
            continue
        common = x.maps[xa:xb] @ y.maps[ya:yb].T
        nx, ny = x.maps[xa:xb].sum(axis=1), y.maps[ya:yb].sum(axis=1)
        sx, sy = x.sizes[xa:xb], y.sizes[ya:yb]
        most = np.minimum(sx[:, None] - (nx[:, None] - common), sy[None, :] - (ny[None, :] - common))
        for i, j in np.argwhere(most * (100 + percent) >= percent * (sx[:, None] + sy[None, :])):
            a, b = int(x.order[xa + i]), int(y.order[ya + j])
            if a != b and forest.find(a) != forest.find(b) and linked(sets[a], sets[b], percent):
                forest.join(a, b)


def block_links(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of one unit of work: a block with itself, or two blocks (``sides`` 0 and 1)."""
    forest = Forest(len(nodes))
    sizes = np.array([len(s) for s in sets])
    wanted = np.log2(2 * np.median(sizes) + 1)  # by the median, so that one large set does not widen all bitmaps
    bits = 1 << int(np.clip(min(np.ceil(wanted), np.floor(np.log2(MAP_BYTES / 4 / len(nodes)))), 6, 12))
    lows = np.array([s[0] if len(s) else 0 for s in sets])
    trees = [SignatureTree(sets, rows[np.lexsort((lows[rows], sizes[rows]))], bits) for rows in (np.flatnonzero(sides == k) for k in (0, 1)) if len(rows)]
    tree_links(trees[0], trees[-1], sets, percent, forest)
    return [(int(nodes[i]), int(nodes[forest.find(i)])) for i in range(len(nodes)) if forest.find(i) != i]


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links that hold, enough to span each component. members: unit string, side int, node long, shingles binary."""

    def work(part: list[pd.DataFrame]) -> list[tuple[int, int]]:
        x = pd.concat(part).drop_duplicates(["side", "node"])
        return block_links(x["node"].to_numpy(), x["side"].to_numpy(), [np.frombuffer(s, dtype=np.uint64) for s in x["shingles"]], percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        unit = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, x in batch.groupby("unit", sort=False):
                if key != unit:
                    if held:
                        out += work(held)
                    held, unit = [], key
                held.append(x)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if held and (out := work(held)):
            yield pd.DataFrame(out, columns=["a", "b"])

    return members.repartition("unit").sortWithinPartitions("unit", "side", "node").mapInPandas(run, "a long, b long")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("doc_id", "text"))
    known = spill(profile(texts, width), "shingle-profile")
    ids = known.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min("th").alias("th"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    ids = spill(ids, "shingle-sets")
    sums = known.agg(F.sum("n_shingles").alias("shingles"), F.count("node").alias("rows")).first()
    buckets = signature_buckets(sums["shingles"], percent)
    likely = sets_with_enough_shared(shared_parts(signatures(texts, width, percent, buckets, folded=True), buckets, SHARED))
    likely = spill(ids.join(likely, "node", "left_semi").select("th", "n"), "near-candidates")
    few = maybe_in(texts, [F.col("th")], slot_filter(likely, ["th"])).where("maybe").drop("maybe")
    buckets = signature_buckets(likely.agg(F.sum("n")).first()[0], percent)  # one row
    rare = rare_parts(every_shared_part(signatures(few, width, percent, buckets, folded=False), buckets))
    clusters = connected_components(links_by_parts(rare, buckets))
    links = verified_links(units(texts, ids, clusters, width), percent).unionByName(links_of_repeated_ids(known))
    reach = connected_components(spill(links, "near-links"))
    low = spill(ids.join(reach, "node", "left").select("node", "low", "rows", F.coalesce("root", "node").alias("root")), "near-roots")
    component = spill(low.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "near-components")
    named = heavy_join(low, component, ["root"], "nodes", ids.count()).select("node", "component_id", "rows")
    some = heavy_join(known.where("node is not null"), spill(named, "near-names"), ["node"], "rows", sums["rows"])
    none = known.where("node is null").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id")).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def links_of_repeated_ids(known: DataFrame) -> DataFrame:
    """a, b: links between the different texts of one identifier."""
    several = known.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most")
    return known.join(several.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def units(texts: DataFrame, ids: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """unit, side, node, shingles: candidate sets dealt out to units of work of bounded size.

    One row stands for each set, named by the hash of identifier and text; a filter of these keeps other texts out of the shuffle.
    """
    sized = spill(clusters.join(ids, "node").select("node", "th", "root", (F.col("n") * 8 + 64).alias("bytes")), "near-sets")
    total = sized.groupBy("root").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("nodes"))
    dealt = heavy_join(sized, spill(total, "near-sizes"), ["root"], "nodes", sized.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = spill(dealt.select("node", "th", "root", "block", "blocks"), "near-units")

    names = ["root", "block", "blocks", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, own in sliced(batches):
            sets = shingle_sets(own, width)
            same = [set_node(s) == n for s, n in zip(sets, x.column(3).to_pylist(), strict=True)]  # a hash shared by two texts brings both
            y = x.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(y.column(k) for k in range(4)), pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())], [*names, "shingles"])

    wanted = maybe_in(texts, [F.col("th")], slot_filter(dealt, ["th"])).where("maybe").select("th", "text")
    sets = wanted.join(dealt.hint("merge"), "th").select(*names, "text").mapInArrow(  # the same plan at every size
        run, "root long, block int, blocks int, node long, shingles binary"
    )
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    sets = sets.withColumn("other", F.explode(others))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return sets.select(
        F.concat_ws("-", F.col("root").cast("string"), lo.cast("string"), hi.cast("string")).alias("unit"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "shingles"
    )


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, with all their columns; null ones stay.

    Rows that share an identifier are one document here, and share its fate.
    """
    found = similarity_components(docs, id_col, text_col, width, percent)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return without(docs, spill(gone, "near-gone"), F.col(id_col).cast("long"), "__gone", F.col(id_col) == F.col("__gone"))
