"""Secret detection with corpus-wide ownership frequency, in DataFrame operations only.

Every candidate value is hashed and counted over distinct repositories (here: documents) and owners (here: sources),
first per (value, owner), then per value, so that a widely copied example folds before the shuffle. A value seen with
few owners and in few repositories looks live; one that many share is an example. Base spans always stay; spans of the
further formats stay only if their value looks live. The value is what the secret is: of a private key its body, however
its lines are broken, never the header that all keys share.

Null and empty texts have no spans; a null owner counts as one owner of its own. Repeated identifiers give one row per
input row. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, joined_spans, match_spans, spill, text_of, without_blanks

#: Base formats of the contract as (kind, pattern, group that holds the value, least length of it).
BASE = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Further formats, same form.
MORE = (
    ("vendor", r"\b(?:gh[opsu]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*Proc-Type:[^\n]*\n\s*DEK-Info:[^\n]*)?\s*([A-Za-z0-9+/=\\][A-Za-z0-9+/=\\\s]*+)", 1, 1),
    ("login", r"://[^\s/:@]+:[^\s/:@]+@", 0, 1),
)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, max_repositories: int = 5
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example: one row for each row of ``docs``."""
    kinds = [*BASE, *MORE]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), text_of(text_col).alias("text"))
    found = F.concat(*(match_spans(F.col("text"), pattern, kind, i, group, least) for i, (kind, pattern, group, least) in enumerate(kinds)))
    hashed = F.transform("found", lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"], F.unhex(F.sha2(without_blanks(x["value"]), 256)).alias("hash")))
    scanned = texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", found.alias("found")).withColumn("found", hashed)
    scanned = spill(scanned, "secret-candidates")
    each = scanned.select("rid", "doc_id", "owner", F.explode("found").alias("x")).select("rid", "doc_id", "owner", "x.*")
    owners = each.groupBy("hash", "owner", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    owners = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    owners = spill(owners.select("hash", live.alias("live"), "n"), "secret-owners")
    judged = heavy_join(each, owners, ["hash"], "n", owners.agg(F.sum("n")).first()[0] or 0)
    judged = judged.where(F.col("live") | (F.col("ord") < len(BASE)))
    per = judged.groupBy("rid").agg(
        F.count_if("live").alias("n_live"), F.collect_list(F.when(F.col("live") | (F.col("ord") < len(BASE)), F.struct("start", "ord", "end", "kind"))).alias("all")
    )
    base = F.filter("found", lambda x: x["ord"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda x: x["ord"] == i)).cast("long")
    return scanned.join(per, "rid", "left").select(
        "doc_id", *(count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)), F.sha2(joined_spans(base), 256).alias("base_sha256"),
        F.coalesce(joined_spans(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        (F.size("found") - F.coalesce("n_live", F.lit(0))).cast("long").alias("n_example"),
    )
