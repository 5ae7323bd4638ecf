"""License detection with ordered signature rules, in DataFrame operations only.

Rules are hand-written regular expressions over lower-case words, in order of priority (``license_rules``). A keyword
prefilter skips documents without any rule's keyword; in the others, each keyword's place yields a word window, as wide
as the rule book needs, and an equi-join on the keyword picks the few rules to try there. Overlaps are resolved by
intervals of words, in order of priority: a detection that overlaps one that stays is suppressed, but a longer one takes
the place of those inside it. What is suppressed suppresses nothing. Base rules are always kept.

Null and empty texts have no words and no detections (score 0). Repeated identifiers give one row per input row.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, spill, text_of
from .license_rules import RULES

#: Phrases and labels of the contract; these are never suppressed.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules(text: str = RULES, base=BASE) -> list[tuple]:
    """(priority, label, keyword, words before the keyword, pattern, weight, base); low priority numbers win, base rules come last."""
    out = []
    for line in text.strip().splitlines():
        label, weight, pattern = line.split(" ", 2)
        lead, key, tail = re.fullmatch("([^<]*)<([^>]+)>(.*)", pattern).groups()
        if re.search(r"[?*+{(|]", lead):
            raise ValueError(f"the number of words before the keyword must be fixed: {pattern}")
        out.append((label, key, lead.count(" "), lead + key + tail, float(weight), False))
    out += [(label, phrase.split()[0], 0, phrase, 0.6, True) for phrase, label in base]
    return [(i, *r) for i, r in enumerate(out)]


def most_words(pattern: str) -> int:
    """An upper bound of the words in a match; patterns that may cross any number of words are refused."""
    if re.search(r"\)[*+{]|(?<!\\)\.|\\[sSWD]|\[\^(?! )", pattern):
        raise ValueError(f"a rule must bound the number of its words: {pattern}")
    return pattern.count(" ") + 1


#: Detections in order of priority; one that overlaps a kept one is dropped, unless the kept ones it overlaps lie inside it and are shorter.
KEPT = """aggregate(found, cast(array() as array<struct<priority:int,start:bigint,end:bigint>>), (kept, x) ->
  if(exists(kept, k -> k.start < x.end and k.end > x.start and not (k.start >= x.start and k.end <= x.end and k.end - k.start < x.end - x.start)), kept,
    array_append(filter(kept, k -> k.end <= x.start or k.start >= x.end), struct(x.priority as priority, x.start as start, x.end as end))))"""


def resolved(found: DataFrame) -> DataFrame:
    """rid, priority, start, end, label, weight, base, hidden: detections, and whether another one that stays suppresses them.

    Detections that overlap, directly or through others, are one row: what is far apart does not matter to each other.
    """
    before = Window.partitionBy("rid").orderBy("start", "end", "priority").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid").orderBy("start", "end", "priority").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = found.withColumn("apart", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")).withColumn("group", F.sum("apart").over(upto))
    each = F.struct("priority", "start", "end", "label", "weight", "base")
    groups = apart.groupBy("rid", "group").agg(F.array_sort(F.collect_list(each)).alias("found")).withColumn("kept", F.expr(KEPT))
    return groups.select("rid", "kept", F.explode("found").alias("x")).select("rid", "x.*", (~F.exists("kept", lambda k: (k["priority"] == F.col("x.priority")) & (k["start"] == F.col("x.start")))).alias("hidden"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signature_rules: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found: a row for each row of ``docs``."""
    spark = docs.sparkSession
    listed = signature_rules or rules()
    book = spark.createDataFrame(listed, "priority int, label string, key string, before int, pattern string, weight double, base boolean")
    keys = sorted({r[2] for r in listed})
    before, most = max(r[3] for r in listed), max(most_words(r[4]) for r in listed)  # word windows as wide as the book needs
    gate = "(?i)(?<![0-9a-z])(?:" + "|".join(keys) + ")(?![0-9a-z])"
    words = F.split(F.trim(ascii_lower(F.regexp_replace("text", NOT_WORD + "+", " "))), " ", -1)
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(keys), i)), lambda i: i.isNotNull())
    hits = F.transform(
        "places",
        lambda i: F.struct(
            i.alias("at"), F.get("words", i).alias("key"),
            F.slice("words", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))).alias("pre"), F.slice("words", i + 1, most).alias("post"),
        ),
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    scanned = (
        texts.withColumn("words", F.when(F.col("text").rlike(gate), words))
        .withColumn("places", places)
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), hits.alias("hits"))
    )
    scanned = spill(scanned, "license-hits")
    tried = scanned.select("rid", F.explode("hits").alias("h")).select("rid", "h.*").join(F.broadcast(book), "key")  # a fixed rule book
    tried = tried.where(F.size("pre") >= F.col("before"))
    lead = F.when(F.col("before") == 0, F.array().cast("array<string>")).otherwise(F.slice("pre", F.size("pre") - F.col("before") + 1, F.col("before")))
    window = F.concat_ws(" ", F.concat(lead, "post"))
    text = F.call_function("regexp_extract", window, F.concat(F.lit("^("), "pattern", F.lit(")(?: |$)")), F.lit(1))
    found = (
        tried.withColumn("hit", text)
        .where("hit <> ''")
        .select("rid", "priority", "label", "weight", "base", (F.col("at") - F.col("before")).cast("long").alias("start"), F.size(F.split("hit", " ")).cast("long").alias("len"))
        .withColumn("end", F.col("start") + F.col("len"))
    )
    kept = resolved(found).where("base or not hidden")
    per = kept.groupBy("rid").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("weight").alias("score"), F.count_if(~F.col("hidden")).alias("n_found"),
    )
    return scanned.join(per, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"),
    )
