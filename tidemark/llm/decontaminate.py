"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers (digits with signs, or spelled), names (capitalised words other than common ones, wherever they stand) and units
become typed placeholders; windows of five template words are hashed and equi-joined with those of the benchmark. A
second variant of each text keeps names as lower-case words, for copies in other case; an item and a document match in
either variant. An item with coverage ``least`` in a document shares one of its rarest windows with it, so only these
propose pairs of document and item: a window that many documents hold, such as five numbers in a row, proposes none unless
the item has no rarer ones. Then all windows of the pairs are counted. For pairs with enough windows, the values that
stand in aligned slots are compared: an item's value must map to one document value throughout (its most frequent one,
nearly always), which holds for verbatim copies and for re-parameterised questions, not for chance. One occurrence of the
item suffices: windows at one distance from their place in the item, or at distances no more than half an item apart
(words put in or left out), or all of the document's windows together. A template window that an item repeats, as a table
of numbers does, counts once there and has its first place.

Null and empty texts match nothing, on either side; an item with fewer words than a window is one window of all of
them. Rows that repeat identifier and text share one decision; repeated items count once each under their own id. Empty
tables give an empty result or no contamination. Ties for the best item go to the smallest id. Identifiers of documents
and items may be of any type that orders. Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_join, maybe_in, slot_filter, spill, text_of, without

#: Units of measure, as they stand after a number.
UNITS = (
    "mm cm m km in ft yd mi miles mg g kg t lb lbs oz ml cl l s sec seconds min minutes h hours day days week weeks month months year years "
    "hz khz mhz w kw kwh v a j kj cal kcal pa kpa bar k c f percent usd eur gbp dollars euros cents pounds"
).split()
#: Numbers as words, tens before the words that may follow them, and common words that open sentences.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
COMMON = (
    "The An In On At If How What When Which Who Whom Whose Where Why It He She They We You This That These Those There And Or But So As For From To Of With "
    "By Is Are Was Were Do Does Did Has Have Had Can Could Will Would Let Find Suppose Given Each Every All Some Any No Not Then After Before During While My His Her Their Our"
).split()
PUNCTUATION = r"""[.,;:!?()\[\]{}"'|#&$%*<>]"""
NUMBER, NAME, UNIT = "\u0001n", "\u0001p", "\u0001u"
WINDOW = 5
#: Benchmark windows up to this many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000



def by_letter(words: list[str]) -> str:
    """Alternatives in groups of one first letter, so that a word meets few of them."""
    return "|".join(f"{a}(?:{'|'.join(w[1:] for w in words if w[0] == a)})" for a in dict.fromkeys(w[0] for w in words))


# Each pattern first looks at one character, so most places of a text fail at once; texts begin with a blank (see ``templates``).
EDGES = rf"(?={PUNCTUATION})(?:(?<!\S){PUNCTUATION}++|(?<!{PUNCTUATION}){PUNCTUATION}++(?!\S))"
SIGNS = r"-+\u2212\u2013~\u20AC\u00A3"
SPELLED = rf"(?i:(?:{by_letter(TENS)})(?:-(?:{by_letter(ONES[1:10])}))?|{by_letter(ONES)})(?!\S)"
SPELLED_STARTS = "".join(a + a.upper() for a in dict.fromkeys(w[0] for w in ONES + TENS))
NUMBERS = rf"(\s)(?=[{SIGNS}0-9{SPELLED_STARTS}])(?:[{SIGNS}]{{0,2}}[0-9]\S*|{SPELLED})"
UNITS_AFTER = rf"(\x01n\s+)(?i:{by_letter(UNITS)})(?!\S)"
NAMES = rf"(\s)(?=[A-Z\u00C0-\u00DE])(?!(?:{by_letter(COMMON)})(?!\S))(?=\S*\p{{Ll}})\S+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+", -1), "")


def templates(table: DataFrame) -> DataFrame:
    """Adds bare (the text without punctuation at the edges of words) and two variants of its template words to a table with
    a text column: form, and plain, in which names are words.

    Whole texts are rewritten by a few patterns, which takes less time than any work on single words.
    """
    bare = F.regexp_replace(F.concat(F.lit(" "), "text"), EDGES, "")  # every word follows a blank
    shaped = F.regexp_replace(F.col("bare"), NUMBERS, f"$1{NUMBER}")
    out = table.withColumn("bare", bare).withColumn("__shaped", F.regexp_replace(shaped, UNITS_AFTER, f"$1{UNIT}"))
    out = out.withColumn("form", words_of(F.lower(F.regexp_replace("__shaped", NAMES, f"$1{NAME}"))))
    return out.withColumn("plain", words_of(F.lower("__shaped"))).drop("__shaped")


def with_windows(table: DataFrame, window: int) -> DataFrame:
    """Adds form_w and plain_w: the hash of each window of a variant's words, at its start; shorter texts are one window.

    Words are hashed once; a window's hash is that of its words' hashes (past the end there are none, which adds nothing).
    """

    def joined(hashes: str) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, window))))

    for variant in ("form", "plain"):
        table = table.withColumn(f"{variant}_1", F.transform(variant, lambda w: F.xxhash64(w)))
        table = table.withColumn(f"{variant}_w", F.slice(joined(f"{variant}_1"), 1, F.greatest(F.size(variant) - (window - 1), F.lit(1))))
    return table


def starts(window: int) -> Column:
    return F.when(F.size("form") > 0, F.sequence(F.lit(0), F.greatest(F.size("form") - window, F.lit(0))))


def slotted_windows(table: DataFrame, key: list[str], window: int) -> DataFrame:
    """key, variant, w, at, slots: each window of both variants with its place and the values in its slots (null for plain words)."""

    def windows(form: str, variant: int) -> Column:
        value = lambda at, k: F.when(F.get(form, at + k).isin(NUMBER, NAME, UNIT), F.lower(F.get("words", at + k)))
        slots = lambda at: F.array(*(value(at, k) for k in range(window)))
        return F.transform(starts(window), lambda at: F.struct(F.lit(variant).alias("variant"), F.get(f"{form}_w", at).alias("w"), at.alias("at"), slots(at).alias("slots")))

    each = F.explode(F.concat(windows("form", 0), windows("plain", 1))).alias("x")
    return with_windows(templates(table), window).withColumn("words", words_of(F.col("bare"))).select(*key, each).select(*key, "x.*")


def occurrences(own: DataFrame, pairs: DataFrame, slots: DataFrame) -> DataFrame:
    """th, item_id, variant, place, w, slots, own: matching windows of pairs by the occurrences they can belong to; slots: as of ``first_places``.

    place: (0, distance), (1 or 2, band of distances as wide as the item; the two kinds overlap by half), (3, null) for
    the whole document. An occurrence has one match for each place in the item, at the distance that most windows have.
    """
    met = own.join(pairs.select("th", "item_id", "variant"), ["th", "variant"]).join(slots.withColumnRenamed("at", "item_at"), ["item_id", "variant", "w"])
    met = met.withColumn("far", F.col("at") - F.col("item_at"))
    met = met.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("th", "item_id", "variant", "far")))
    place = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    places = F.array(
        place(0, F.col("far")), place(1, F.floor(F.col("far") / F.col("wide"))), place(2, F.floor(F.col("far") / F.col("wide") + 0.5)), place(3, F.lit(None))
    )
    met = met.withColumn("place", F.explode(places)).withColumn("alone", F.when(F.col("place.kind") == 3, F.col("at")))
    best = F.max_by(F.struct("w", "slots", "own"), F.struct("m", -F.col("far"))).alias("x")
    key = ["th", "item_id", "variant", "place"]
    return met.groupBy(*key, "item_at", "alone").agg(best).select(*key, "x.w", "x.slots", "x.own")


def first_places(windows: DataFrame) -> DataFrame:
    """item_id, variant, w, at, slots, wide: each different window of an item where it stands first, and the item's width in words.

    So a document's window meets one place of an item, and matches are no more than the windows of documents.
    """
    wide = windows.groupBy("item_id").agg((F.max("at") + F.lit(WINDOW)).alias("wide"))
    return windows.groupBy("item_id", "variant", "w").agg(F.min_by(F.struct("at", "slots"), "at").alias("x")).select("item_id", "variant", "w", "x.*").join(wide, "item_id")


def covered_items(texts: DataFrame, book: DataFrame, sizes: DataFrame, small: bool, window: int, least: float) -> DataFrame:
    """th, item_id, variant, coverage of all documents and items with coverage ``least`` or more in a variant."""
    item = ["item_id", "variant"]
    wanted = book.select(F.col("w").alias("bw")).distinct()
    wanted = F.broadcast(wanted) if small else wanted  # its size has been checked
    held = with_windows(templates(texts), window).select("th", F.explode(F.array_distinct(F.concat("form_w", "plain_w"))).alias("w"))
    held = spill(held.join(wanted, F.col("w") == F.col("bw"), "left_semi").distinct(), "benchmark-held")
    documents = held.groupBy("w").agg(F.count(F.lit(1)).alias("documents"))
    in_item = Window.partitionBy(*item).orderBy(F.coalesce("documents", F.lit(0)), "w")  # an item's windows, as many as it has words
    ranked = book.join(documents, "w", "left").withColumn("nth", F.row_number().over(in_item)).join(sizes, item)
    rare = ranked.where((F.col("nth") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1) & F.col("documents").isNotNull())
    rare = spill(rare.groupBy("w", "documents").agg(F.collect_set(F.struct(*item)).alias("items")), "benchmark-rare")
    total = rare.agg(F.sum("documents")).first()[0] or 0
    pairs = heavy_join(held, rare, ["w"], "documents", total).select("th", F.explode("items").alias("x")).select("th", "x.*").distinct()
    own = held.join(spill(pairs, "benchmark-pairs"), "th")
    both = own.join(F.broadcast(book) if small else book, [*item, "w"])
    share = both.groupBy("th", *item).agg(F.count(F.lit(1)).alias("n")).join(sizes, item).withColumn("coverage", F.col("n") / F.col("size"))
    return share.where(F.col("coverage") >= least).select("th", *item, "coverage")


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by identifier and text."""
    return F.xxhash64(F.col(id_col), text_of(text_col))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int, least: float, agree: float) -> DataFrame:
    """th, item_id, coverage, agreement of all documents that hold an item."""
    texts = docs.select(row_key(id_col, text_col).alias("th"), text_of(text_col).alias("text"))
    items = benchmark.select("item_id", text_of("text").alias("text"))
    slots = spill(slotted_windows(items, ["item_id"], window), "benchmark-windows")
    item = ["item_id", "variant"]
    book = slots.where("item_id is not null").select(*item, "w").distinct()
    sizes = book.groupBy(*item).agg(F.count(F.lit(1)).alias("size"))
    found = spill(covered_items(texts, book, sizes, slots.count() <= BROADCAST_WINDOWS, window, least), "benchmark-candidates")
    some = maybe_in(texts, [F.col("th")], slot_filter(found, ["th"])).where("maybe").join(found.select("th").distinct(), "th", "left_semi")
    own = slotted_windows(some.dropDuplicates(["th"]), ["th"], window).withColumnRenamed("slots", "own")
    met = spill(occurrences(own, found, first_places(slots)), "benchmark-occurrences")
    key = ["th", *item, "place"]
    whole = met.groupBy(*key).agg(F.count_distinct("w").alias("n")).join(sizes, item).where(F.col("n") / F.col("size") >= least).select(*key)
    votes = met.select(*key, F.explode(F.arrays_zip("slots", "own")).alias("x")).where("x.slots is not null")
    votes = votes.groupBy(*key, "x.slots", "x.own").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.groupBy(*key, "slots").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    votes = votes.groupBy(*key).agg((F.sum("most") / F.sum("all")).alias("agreement"))
    each = whole.join(votes, key, "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
    best = each.groupBy("th", *item).agg(F.max("agreement").alias("agreement")).where(F.col("agreement") >= agree)
    return found.join(best, ["th", *item]).groupBy("th", "item_id").agg(F.max("coverage").alias("coverage"), F.max("agreement").alias("agreement"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: float = 0.8, agree: float = 0.8
) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, best_item, coverage: one row for each row of ``docs``."""
    found = spill(benchmark_matches(docs, benchmark, id_col, text_col, window, least, agree), "benchmark-found")
    per = found.groupBy("th").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"),
        F.min(F.struct((-F.col("coverage")).alias("less"), F.col("item_id").alias("item"))).alias("best"),
    )
    keys = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("th"))
    joined = keys.join(per, "th", "left")
    return joined.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), F.lit("")).alias("item_ids"), F.col("best.item").alias("best_item"),
        F.round(F.coalesce(-F.col("best.less"), F.lit(0.0)), 6).alias("coverage"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    found = benchmark_matches(docs, benchmark, id_col, text_col, WINDOW, 0.8, 0.8).select(F.col("th").alias("__th")).distinct()
    own = row_key(id_col, text_col)
    return without(docs, spill(found, "benchmark-found"), own, "__th", own == F.col("__th"))
