"""URL filtering with per-host path-template trees, in DataFrame operations only.

Pages fold to distinct (host, path) with counts, so a hot host shrinks before any shuffle. Then, in passes over all
levels at once, whatever the depth:

1. Generalise. A segment that looks variable (digits, long hex) is a wildcard ``*``. Of the others, one stays a branch of
   its host's tree if it is stable: enough pages of the host have it at that level, or it stands at that level on enough
   hosts. All others, such as slugs, are variable too.
2. Merge. Branches below one parent that have enough labelled pages are put in bands of equal width on the arcsine scale
   of their block share, on which a share has the same error everywhere; those that do not differ from their band's
   pooled share by a z test merge into one wildcard, ``*0`` to ``*3`` after the band. Branches without labelled pages
   are no evidence and stay as they are.
3. Reject. A template is blocked if its smoothed purity reaches the threshold: by its own labelled pages if there are
   enough, else by those of its whole subtree, if at least half of the subtree's pages are labelled. Without either it
   has the corpus' share of blocked pages.

Labels come from the given rules, and from ``label_col`` where the input has one. Every test is by counts of pages, never
by the number of branches or the depth.

Null or malformed urls have empty host and path, no rule, and are judged like any other template. Empty segments are
ignored. Repeated and null identifiers give one row per input row. An empty table gives an empty result. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, heavy_join, spill, text_of

#: Rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BANDS = 4


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(text_of(url), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), "://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All path segments, those that look variable as ``*``."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+([._-][A-Za-z0-9]+)?$|^[0-9a-fA-F-]{16,}$|[0-9]{4,}"), F.lit("*")).otherwise(s))


def prefixes(segs: Column) -> Column:
    """A hash of every prefix of a path, from the empty one to the whole: one more entry than segments."""
    start = F.array(F.xxhash64(F.lit("/")))
    return F.aggregate(segs, start, lambda acc, s: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), s)))


def stable_segments(tree: DataFrame, min_pages: int, min_hosts: int) -> DataFrame:
    """pid, segs: each path with its variable segments as ``*``."""
    each = tree.select("pid", "host", "n", F.posexplode("segs").alias("level", "seg"))
    plain = F.col("seg") != "*"
    own = each.where(plain).groupBy("host", "level", "seg").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("paths"))
    own = spill(own, "url-segments")
    wide = own.groupBy("level", "seg").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= min_hosts)
    wide = spill(wide, "url-wide-segments")
    total = wide.agg(F.sum("hosts")).first()[0] or 0
    known = heavy_join(own, wide, ["level", "seg"], "hosts", total, "left")
    known = spill(known.select("host", "level", "seg", "paths", (F.col("hosts").isNotNull() | (F.col("pages") >= min_pages)).alias("stable")), "url-stable")
    total = known.agg(F.sum("paths")).first()[0] or 0
    shaped = heavy_join(each.where(plain).select("pid", "host", "level", "seg"), known, ["host", "level", "seg"], "paths", total)
    shaped = shaped.select("pid", "level", F.when(F.col("stable"), F.col("seg")).otherwise("*").alias("seg"))
    return rebuilt(shaped.unionByName(each.where(~plain).select("pid", "level", "seg")))


def rebuilt(each: DataFrame) -> DataFrame:
    """pid, segs from pid, level, seg."""
    return each.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "seg"))), lambda x: x["seg"]).alias("segs"))


def merged_branches(tree: DataFrame, z: float, min_labelled: int) -> DataFrame:
    """host, parent (hash of the prefix), seg, name: branches that merge with similar ones below the same parent, and their common name."""
    steps = F.transform("segs", lambda s, i: F.struct(F.get("chain", i).alias("parent"), s.alias("seg")))
    each = tree.where("n_block + n_allow > 0").withColumn("chain", prefixes(F.col("segs"))).select("host", "n_block", "n_allow", F.explode(steps).alias("x"))
    each = each.where("x.seg <> '*'").groupBy("host", "x.parent", "x.seg").agg(F.sum("n_block").alias("b"), F.sum(F.col("n_block") + F.col("n_allow")).alias("m"))
    share = F.col("b") / F.col("m")
    band = F.least(F.floor(F.asin(F.sqrt(share)) / (F.lit(3.141592653589793 / 2) / BANDS)), F.lit(BANDS - 1)).cast("int")
    each = spill(each.where(F.col("m") >= min_labelled).withColumn("band", band), "url-branches")
    pooled = each.groupBy("host", "parent", "band").agg(F.sum("b").alias("pb"), F.sum("m").alias("pm"), F.count(F.lit(1)).alias("branches"))
    pooled = spill(pooled.where("branches > 1"), "url-bands")
    total = pooled.agg(F.sum("branches")).first()[0] or 0
    p = F.col("pb") / F.col("pm")
    alike = F.abs(share - p) <= z * F.sqrt(p * (1 - p) / F.col("m"))
    joined = heavy_join(each, pooled, ["host", "parent", "band"], "branches", total).where(F.coalesce(alike, F.lit(False)))
    return joined.select("host", "parent", "seg", F.concat(F.lit("*"), F.col("band").cast("string")).alias("name"))


def template_tree(pages: DataFrame, z: float = 2.58, min_pages: int = 5, min_hosts: int = 3, min_labelled: int = 5) -> DataFrame:
    """host, path_segs, template (array), n, n_block, n_allow of each distinct path. ``pages``: host, segs, label."""
    tree = pages.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("n_block"), F.count_if(F.col("label") == "allow").alias("n_allow")
    )
    tree = spill(tree.withColumn("pid", F.monotonically_increasing_id()), "url-paths")
    shaped = stable_segments(tree, min_pages, min_hosts)
    counts = tree.select("pid", "host", F.col("segs").alias("path_segs"), "n", "n_block", "n_allow")
    shaped = counts.join(shaped, "pid", "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<string>")))
    shaped = spill(shaped, "url-shaped")
    names = spill(merged_branches(shaped, z, min_labelled), "url-merged")
    steps = F.transform("segs", lambda s, i: F.struct(F.get("chain", i).alias("parent"), s.alias("seg")))
    each = shaped.withColumn("chain", prefixes(F.col("segs"))).select("pid", "host", F.posexplode(steps).alias("level", "x")).select("pid", "host", "level", "x.parent", "x.seg")
    renamed = each.join(names, ["host", "parent", "seg"]).select("pid", "level", "name")  # only branches that merge
    final = rebuilt(each.join(renamed, ["pid", "level"], "left").select("pid", "level", F.coalesce("name", "seg").alias("seg"))).withColumnRenamed("segs", "template")
    out = shaped.drop("segs").join(final, "pid", "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))
    return spill(out, "url-templates")


def purity(tree: DataFrame, prior: float, strength: float, min_labelled: int) -> DataFrame:
    """host, node (hash of the template), purity of every template that has pages."""
    counts = [F.sum(c).alias(c) for c in ("n", "n_block", "n_allow")]
    own = tree.groupBy("host", "template").agg(*counts)
    own = spill(own.withColumn("chain", prefixes(F.col("template"))).drop("template"), "url-nodes")
    below = own.select("host", F.explode("chain").alias("node"), "n", "n_block", "n_allow").groupBy("host", "node").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "n_block", "n_allow")))
    nodes = own.select("host", F.element_at("chain", -1).alias("node"), "n", "n_block", "n_allow").join(below, ["host", "node"])
    smooth = lambda b, a: (F.col(b) + strength * prior) / (F.col(b) + F.col(a) + strength)
    enough = F.col("n_block") + F.col("n_allow") >= min_labelled
    most = (F.col("all_n_block") + F.col("all_n_allow")) * 2 >= F.col("all_n")
    judged = F.when(enough, smooth("n_block", "n_allow")).when(most, smooth("all_n_block", "all_n_allow")).otherwise(F.lit(prior))
    return nodes.select("host", "node", judged.alias("purity"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules=RULES, strength: float = 4.0, threshold: float = 0.5, min_labelled: int = 5
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row for each row of ``pages``.

    purity: block share of a template's labelled pages, smoothed by ``strength`` pages at the corpus' share of blocked
    pages. ``label_col``: optional column with "block" or "allow" for some pages, besides the rules, which win.
    """
    url = F.col(url_col)
    given = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), given.alias("given"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.coalesce(verdict, "given").alias("label"), segments(F.col("path")).alias("segs"))
    tree = template_tree(base, min_labelled=min_labelled)
    prior = tree.agg(F.try_divide(F.sum("n_block"), F.sum("n"))).first()[0] or 0.0  # one number
    judged = purity(tree, prior, strength, min_labelled)
    known = tree.withColumn("node", F.element_at(prefixes(F.col("template")), -1)).join(judged, ["host", "node"])
    known = spill(known.select("host", F.col("path_segs").alias("segs"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "n"), "url-judged")
    total = known.agg(F.sum("n")).first()[0] or 0
    own = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return heavy_join(base, known, ["host", "segs"], "n", total).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", F.round("purity", 6).alias("purity")
    )
