"""Queries of splits, views and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import splits as V
from ..operators.features import PHASES
from ..sources.tables import read_table
from .base import EVENTS, LABELLED, events, labelled
from .registry import query

#: Rows: orders with three classes by status; units: customer nation x month would be fine too, here order months.
ROWS = """rows_ AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS unit, o_orderdate AS t, o_orderstatus AS label FROM orders),
  un AS (SELECT unit, count(DISTINCT id) AS n, count(*) FILTER (WHERE label = 'F') AS n_F, count(*) FILTER (WHERE label = 'O') AS n_O, count(*) FILTER (WHERE label = 'P') AS n_P, min(t) AS unit_start, max(t) AS unit_end FROM rows_ GROUP BY 1),
  ea AS (SELECT *, sum(n) OVER (ORDER BY unit_start, unit) AS upto, sum(n) OVER (ORDER BY unit_start, unit) <= 0.6 * sum(n) OVER () AS early FROM un),
  la AS (SELECT unit, least(ceil(sum(n) OVER (ORDER BY unit_start, unit) * 3 / sum(n) OVER ()), 3) AS temporal_slice FROM ea WHERE NOT early),
  bl AS (SELECT u.*, CASE WHEN e.early THEN 'A' ELSE CAST(CAST(l.temporal_slice AS INTEGER) AS VARCHAR) END AS block FROM un u JOIN ea e USING (unit) LEFT JOIN la l USING (unit))"""
CLASSES = ["F", "O", "P"]
WINDOWS = {"W1": {"train": ["A"], "validation": ["1"], "test": ["2"]}, "W2": {"train": ["A", "1"], "validation": ["2"], "test": ["3"]}}
MANIFEST = f"""{ROWS}, spec(window_id, split, block) AS (VALUES {", ".join(f"('{w}', '{s}', '{b}')" for w, p in WINDOWS.items() for s, bs in p.items() for b in bs)}), man AS (SELECT * FROM bl JOIN spec USING (block))"""


def rows(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("unit"), F.col("o_orderdate").alias("t"), F.col("o_orderstatus").alias("label"))


def units(spark, d):
    return V.unit_table(rows(spark, d), "unit", "t", "label", CLASSES, "id")


def early(spark, d):
    return V.early_block(units(spark, d), ["unit_start", "unit"], 0.6)


def slices(spark, d):
    return V.later_slices(early(spark, d).where("not early"), ["unit_start", "unit"])


def blocks(spark, d):
    e = early(spark, d)
    later = slices(spark, d).select("unit", F.col("temporal_slice").cast("string").alias("s"))
    return e.join(later, "unit", "left").withColumn("block", F.when(F.col("early"), "A").otherwise(F.col("s"))).drop("s", "early", "upto")


def manifest(spark, d):
    return V.rolling_manifest(blocks(spark, d), "block", WINDOWS)


@query("v1_unit_table", f"WITH {ROWS} SELECT unit, n, n_F, n_O, n_P, unit_start, unit_end FROM un")
def v1(spark, d):
    return units(spark, d)


@query("v2_early_block", f"WITH {ROWS} SELECT unit, early FROM ea")
def v2(spark, d):
    return early(spark, d).select("unit", "early")


@query("v3_later_slices", f"WITH {ROWS} SELECT unit, CAST(temporal_slice AS INTEGER) AS temporal_slice FROM la")
def v3(spark, d):
    return slices(spark, d).select("unit", "temporal_slice")


PAIR = {1: ["B", "C"], 2: ["D", "E"], 3: ["F", "G"]}


def deal_sql(source: str, group: str, order: str, metrics: dict[str, str], blocks: dict[int, list[str]]) -> str:
    """Greedy dealing as a recursion over ordered units; ``metrics``: column -> weight over the group's totals t_<column>.

    The state is a list of sums, block by block; scores add up in that order.
    """
    names, k = list(metrics), len(metrics)
    own = f"CASE {group} {' '.join(f'WHEN {g} THEN {b!r}' for g, b in blocks.items())} END"
    term = "w.ws[1 + j % {k}] * pow((w.st[j + 1] + CASE WHEN j // {k} = b THEN w.v[1 + j % {k}] ELSE 0 END - w.t[1 + j % {k}]) / greatest(w.t[1 + j % {k}], 1.0), 2)".format(k=k)
    best = f"list_min(list_transform(range(w.nb), lambda b: struct_pack(score := list_reduce(list_transform(range(w.nb * {k}), lambda j: {term}), lambda x, y: x + y), b := b))).b"
    after = f"list_transform(range(w.nb * {k}), lambda j: w.st[j + 1] + CASE WHEN j // {k} = {best} THEN w.v[1 + j % {k}] ELSE 0 END)"
    return f"""tt AS (SELECT {group}, {", ".join(f"sum({m})::DOUBLE AS t_{m}" for m in names)} FROM {source} GROUP BY 1),
      oo AS (SELECT s.*, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS pos, [{", ".join(f"s.{m}::DOUBLE" for m in names)}] AS v, {own} AS bs,
        [{", ".join(f"({w})::DOUBLE" for w in metrics.values())}] AS ws, [{", ".join(f"t_{m}" for m in names)}] AS ts FROM {source} s JOIN tt USING ({group})),
      ww AS (SELECT *, len(bs) AS nb, list_transform(ts, lambda x: x / len(bs)) AS t FROM oo),
      rr AS (SELECT {group}, 0::BIGINT AS pos, list_transform(range(nb * {k}), lambda x: 0.0::DOUBLE) AS st, -1::BIGINT AS b FROM ww WHERE pos = 1
        UNION ALL SELECT w.{group}, w.pos, {after}, {best} FROM (SELECT ww.*, rr.st FROM rr JOIN ww ON ww.{group} = rr.{group} AND ww.pos = rr.pos + 1) w)"""


PAIR = {1: ["B", "C"], 2: ["D", "E"], 3: ["F", "G"]}
SLICED = f"{ROWS}, sl AS (SELECT la.temporal_slice::INTEGER AS temporal_slice, un.* FROM la JOIN un USING (unit))"
BY_SIZE = "s.n DESC, sha256('42|' || s.unit)"
PAIRED = "SELECT ww.unit, ww.temporal_slice, n, n_F, n_O, n_P, bs[rr.b + 1] AS block FROM rr JOIN ww ON ww.temporal_slice = rr.temporal_slice AND ww.pos = rr.pos"


def pair_units(spark, d, strategy):
    x = slices(spark, d).select("unit", "temporal_slice", "n", "n_F", "n_O", "n_P")
    return V.balanced_deal(x, "temporal_slice", "unit", {"n": 1.0, "n_F": 2.0, "n_O": 2.0, "n_P": 2.0}, PAIR, 42, strategy)


@query("v4_pair_units", f"WITH RECURSIVE {SLICED}, {deal_sql('sl', 'temporal_slice', BY_SIZE, {'n': '1', 'n_F': '2', 'n_O': '2', 'n_P': '2'}, PAIR)} {PAIRED}")
def v4(spark, d):
    return pair_units(spark, d, "balanced")


RAREST = {"n": "1", **{m: f"2 * (t_n / greatest(t_{m}, 1))" for m in ("n_F", "n_O", "n_P")}}


@query("v4_pair_units_rarest_first", f"WITH RECURSIVE {SLICED}, {deal_sql('sl', 'temporal_slice', BY_SIZE, RAREST, PAIR)} {PAIRED}")
def v4_rarest(spark, d):
    return pair_units(spark, d, "rarest_first")


@query(
    "v5_allocate_units",
    f"""WITH RECURSIVE {SLICED}, al AS (SELECT 0 AS g, unit, n, n_F, n_P, n_F / greatest(sum(n_F) OVER (), 1) + n_P / greatest(sum(n_P) OVER (), 1) AS rarity FROM sl),
    {deal_sql("al", "g", "s.rarity DESC, s.n DESC, sha256(s.unit)", {"n": "1", "n_F": "2", "n_P": "2"}, {0: list("BCDEFG")})} SELECT ww.unit, n, n_F, n_P, bs[rr.b + 1] AS block FROM rr JOIN ww ON ww.pos = rr.pos""",
)
def v5(spark, d):
    x = slices(spark, d).select("unit", "n", "n_F", "n_P")
    return V.allocate_units(x, "unit", {"n": 1.0, "n_F": 2.0, "n_P": 2.0}, list("BCDEFG"))


@query("v6_rolling_manifest", f"WITH {MANIFEST} SELECT unit, window_id, split, n FROM man")
def v6(spark, d):
    return manifest(spark, d).select("unit", "window_id", "split", "n")


@query("v7_split_shares", f"WITH {MANIFEST} SELECT window_id, split, count(*) AS units, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (PARTITION BY window_id), 6) AS share FROM man GROUP BY 1, 2")
def v7(spark, d):
    return V.split_shares(manifest(spark, d)).withColumn("share", F.round("share", 6))


@query(
    "v8_split_gate",
    f"""WITH {MANIFEST}, sh AS (SELECT window_id, sum(n) / sum(sum(n)) OVER (PARTITION BY window_id) AS share FROM man GROUP BY window_id, split), dt AS (SELECT window_id, max(unit_end) FILTER (WHERE split = 'train') AS train_end, max(unit_end) FILTER (WHERE split <> 'train') AS eval_end FROM man GROUP BY 1)
    SELECT window_id, any_value(train_end) <= any_value(eval_end) AS chronological, min(share) >= 0.05 AS large_enough FROM sh JOIN dt USING (window_id) GROUP BY 1""",
)
def v8(spark, d):
    return V.split_gate(manifest(spark, d), "unit_start", "unit_end", 0.05).select("window_id", "chronological", "large_enough")


STRICT = f"""{MANIFEST}, tb AS (SELECT window_id, max(unit_end) AS train_end FROM man WHERE split = 'train' GROUP BY 1), st AS (SELECT m.window_id, m.split, {", ".join(
    f"make_timestamp(CAST(floor(epoch(unit_start) + (epoch(unit_end) - epoch(unit_start)) * {r}) AS BIGINT) * 1000000) > train_end AS strict_{p}" for p, r in PHASES.items())} FROM man m JOIN tb USING (window_id) WHERE split <> 'validation')"""


def strict(spark, d):
    m = manifest(spark, d)
    bounds = m.where("split = 'train'").groupBy("window_id").agg(F.max("unit_end").alias("train_end"))
    return V.strict_flags(m.where("split <> 'validation'"), bounds, "window_id", "unit_start", "unit_end", PHASES)


@query("v9_strict_flags", f"WITH {STRICT} SELECT window_id, split, strict_P1, strict_P4, count(*) AS n FROM st GROUP BY 1, 2, 3, 4")
def v9(spark, d):
    return strict(spark, d).groupBy("window_id", "split", "strict_P1", "strict_P4").agg(F.count("*").alias("n"))


@query(
    "v10_overlap_audit",
    f"WITH {STRICT} " + " UNION ALL ".join(f"SELECT window_id, split, 'strict_{p}' AS flag, count(*) AS n, count(*) FILTER (WHERE NOT strict_{p}) AS overlap FROM st GROUP BY 1, 2" for p in PHASES),
)
def v10(spark, d):
    return V.overlap_audit(strict(spark, d), ["window_id", "split"], [f"strict_{p}" for p in PHASES]).drop("overlap_share")


@query(
    "v11_label_drift",
    f"""WITH {MANIFEST}, ds AS (SELECT window_id || '-' || split AS w, sum(n_F) / sum(n) AS a, sum(n_O) / sum(n) AS b, sum(n_P) / sum(n) AS c FROM man GROUP BY 1), lg AS (SELECT *, lag(a) OVER (ORDER BY w) AS pa, lag(b) OVER (ORDER BY w) AS pb, lag(c) OVER (ORDER BY w) AS pc FROM ds)
    SELECT w, CASE WHEN pa IS NOT NULL THEN round(sqrt(greatest(({" + ".join(f"({x} * log2({x} / (({x} + p{x}) / 2)) + p{x} * log2(p{x} / (({x} + p{x}) / 2))) / 2" for x in "abc")}), 0)), 6) END AS drift FROM lg""",
)
def v11(spark, d):
    dist = manifest(spark, d).groupBy(F.concat_ws("-", "window_id", "split").alias("w")).agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in CLASSES))
    return V.label_drift(dist, "w", CLASSES).select("w", F.round("drift", 6).alias("drift"))


@query("v12_calendar_boundaries", f"WITH {ROWS} SELECT block, max(unit_end) AS boundary FROM bl GROUP BY 1")
def v12(spark, d):
    return blocks(spark, d).groupBy("block").agg(F.max("unit_end").alias("boundary"))


#: A manifest with faults: training units of W1 with n divisible by 3 stand in test too, some units are lost, some rows are of an old version.
FAULTY = f"""{MANIFEST}, fa AS (SELECT unit, window_id, split, n FROM man UNION ALL SELECT unit, window_id, 'test', n FROM man WHERE window_id = 'W1' AND split = 'train' AND n % 3 = 0),
  fb AS (SELECT CASE WHEN n % 11 > 0 THEN unit END AS unit, window_id, split, CASE WHEN n % 13 = 0 THEN 'v1' WHEN n % 17 > 0 THEN 'v2' END AS version FROM fa)"""


@query(
    "v13_manifest_validation",
    f"""WITH {FAULTY} SELECT 'required_columns' AS "check", CAST(1 AS BIGINT) AS violations UNION ALL SELECT 'one_split', count(*) FROM (SELECT 1 FROM fb WHERE unit IS NOT NULL GROUP BY window_id, unit HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'null_unit', count(*) FROM fb WHERE unit IS NULL UNION ALL SELECT 'other_version', count(*) FROM fb WHERE version IS DISTINCT FROM 'v2'""",
)
def v13(spark, d):
    """Of a manifest with faults, without one of the columns that it needs."""
    x = manifest(spark, d).select("unit", "window_id", "split", "n")
    x = x.unionByName(x.where("window_id = 'W1' and split = 'train' and n % 3 = 0").withColumn("split", F.lit("test")))
    version = F.when(F.col("n") % 13 == 0, "v1").when(F.col("n") % 17 > 0, "v2")
    x = x.withColumn("version", version).withColumn("unit", F.when(F.col("n") % 11 > 0, F.col("unit"))).drop("n")
    return V.validate_manifest(x, "unit", ["unit", "window_id", "split", "block"], {"version": "v2"})


VIEW = f"""{MANIFEST}, vw AS (SELECT r.id, r.unit, r.label, o_totalprice AS price_P1, CASE WHEN o_orderpriority < '3' THEN o_totalprice END AS price_P2, m.window_id, m.split FROM rows_ r JOIN orders ON o_orderkey = r.id JOIN man m ON m.unit = r.unit)"""


def view(spark, d):
    feats = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("unit"), F.col("o_totalprice").alias("price_P1"), F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice")).alias("price_P2"))
    m = manifest(spark, d).select("unit", "window_id", "split")
    return V.materialize_view(feats, rows(spark, d).select("id", "label"), m, "id", "unit", {"P1": "price_P1", "P2": "price_P2"})


@query("v14_view", f"WITH {VIEW} SELECT window_id, split, count(*) AS n, CAST(sum((price_P2 IS NOT NULL)::INT) AS BIGINT) AS available_P2 FROM vw GROUP BY 1, 2")
def v14(spark, d):
    return view(spark, d).groupBy("window_id", "split").agg(F.count("*").alias("n"), F.sum("phase_available_P2").alias("available_P2"))


@query("v15_attach_strict", f"WITH {VIEW} SELECT window_id, count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS strict FROM vw GROUP BY 1")
def v15(spark, d):
    flags = rows(spark, d).select("id", (F.col("id") % 2 == 0).alias("is_strict"))
    return V.attach_strict(view(spark, d), flags, ["id"]).groupBy("window_id").agg(F.count("*").alias("n"), F.count_if("is_strict").alias("strict"))


@query(
    "v16_prefix_view",
    f"WITH {VIEW} SELECT split, k, count(*) AS n, round(sum(price_P1), 2) AS p1, count(price_P2) FILTER (WHERE k = 2) AS known_p2, count(price_P2) FILTER (WHERE k = 2) AS available_p2 FROM vw, (VALUES (1), (2)) AS ks(k) GROUP BY 1, 2",
)
def v16(spark, d):
    """Both prefixes: the first knows nothing of the second phase."""
    whole = view(spark, d)
    x = reduce(lambda a, b: a.unionByName(b), [V.prefix_view(whole, ["P1", "P2"], k).withColumn("k", F.lit(k)) for k in (1, 2)])
    return x.groupBy("split", "k").agg(F.count("*").alias("n"), F.round(F.sum("price_P1"), 2).alias("p1"), F.count("price_P2").alias("known_p2"), F.sum("phase_available_P2").cast("long").alias("available_p2"))


@query("v17_view_audit", f"WITH {VIEW} SELECT window_id, split, count(*) AS n_rows, count(DISTINCT id) AS ids, count(DISTINCT unit) AS units FROM vw GROUP BY 1, 2")
def v17(spark, d):
    return V.view_audit(view(spark, d), ["window_id", "split"], "id", "unit")


@query("v19_staged_split", f"WITH {VIEW} SELECT id, unit, price_P1 FROM vw WHERE window_id = 'W1' AND split = 'train'")
def v19(spark, d):
    x = view(spark, d).where("window_id = 'W1' and split = 'train'")
    return x.select(*V.visible_columns(x.columns, ["P1", "P2"], 1, ("label", "window_id", "split", "phase_available_")))


@query(
    "v20_assignment_qa",
    f"WITH {ROWS}, x AS (SELECT id, CASE WHEN n % 5 > 0 THEN block END AS block FROM rows_ JOIN bl USING (unit) UNION ALL SELECT id, 'B' FROM rows_ WHERE id % 10 = 0), p AS (SELECT id, count(DISTINCT block) AS k FROM x GROUP BY 1) SELECT count(*) AS ids, count(*) FILTER (WHERE k > 1) AS several_blocks, count(*) FILTER (WHERE k = 0) AS unmapped FROM p",
)
def v20(spark, d):
    """Some units without a block, and every tenth row in a second one."""
    x = rows(spark, d).join(blocks(spark, d).select("unit", F.when(F.col("n") % 5 > 0, F.col("block")).alias("block")), "unit").select("id", "block")
    return V.assignment_qa(x.unionByName(rows(spark, d).where("id % 10 = 0").select("id", F.lit("B").alias("block"))), "id", "block")


@query("v21_unit_sizes", f"WITH {ROWS} SELECT block, count(*) AS units, quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, max(n) AS largest, count(*) FILTER (WHERE n <= 5) AS tiny FROM bl GROUP BY 1")
def v21(spark, d):
    return V.unit_sizes(blocks(spark, d), "block", "n").withColumn("p90", F.round("p90", 4))


@query("v22_lineage", """SELECT o_orderkey, o_orderstatus, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS lineage_sha256 FROM orders""")
def v22(spark, d):
    return V.lineage(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


@query(
    "a2_spearman",
    """WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) / 2.0) AS q, (rank() OVER (ORDER BY l_discount) + count(*) OVER (PARTITION BY l_discount) / 2.0) AS di, (rank() OVER (ORDER BY l_extendedprice) + count(*) OVER (PARTITION BY l_extendedprice) / 2.0) AS p FROM lineitem)
    SELECT 'l_quantity' AS feature, round(corr(q, p), 6) AS rho, count(*) AS n FROM r UNION ALL SELECT 'l_discount', round(corr(di, p), 6), count(*) FROM r""",
)
def a2(spark, d):
    return A.spearman(read_table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query(
    "a3_nmi",
    """WITH b AS (SELECT o_orderkey, o_orderpriority AS y, floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 20 / count(*) OVER ()) AS x FROM orders), c AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2),
    t AS (SELECT n, sum(n) OVER () AS s, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c), e AS (SELECT sum(n / s * ln(n * s / (nx * ny))) AS mi, sum(-n / s * ln(nx / s)) AS ha, sum(-n / s * ln(ny / s)) AS hb FROM t)
    SELECT round(mi, 8) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(mi / ((ha + hb) / 2), 8) AS nmi FROM e""",
)
def a3(spark, d):
    orders = read_table(spark, d, "orders")
    out = A.mutual_information(orders.join(A.rank_bins(orders, "o_orderkey", "o_totalprice", 20, "bin"), "o_orderkey"), "bin", "o_orderpriority")
    return out.select(F.round("mi", 8).alias("mi"), F.round("ha", 6).alias("ha"), F.round("hb", 6).alias("hb"), F.round("nmi", 8).alias("nmi"))


@query("a4_proxy_gate", "SELECT feature, CASE WHEN feature = 'l_tax' THEN 'proxy' WHEN abs(rho) >= 0.1 THEN 'needs_review' ELSE 'ok' END AS status FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS rho FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)")
def a4(spark, d):
    x = read_table(spark, d, "lineitem")
    roles = dict(A.column_roles(x.dtypes, [("key", "key$|number$"), ("label", "price$")]))
    features = [c for c, r in roles.items() if r == "feature" and c in ("l_quantity", "l_tax")]
    rho = x.agg(*(F.corr(c, "l_extendedprice").alias(c) for c in features)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("rho")) for c in features))).alias("x")).select("x.*")
    return A.proxy_gate(rho, 0.1, ["l_tax"], []).select("feature", "status")


@query("a5_transition", f"WITH {LABELLED}, x AS (SELECT CAST(quality AS INTEGER) AS label_before, CAST(CASE WHEN n_chars < 500 THEN 0 ELSE quality END AS INTEGER) AS label_after FROM lab) SELECT label_before, label_after, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label_before), 6) AS row_share FROM x GROUP BY 1, 2")
def a5(spark, d):
    x = labelled(spark, d)
    out = A.transition(x, F.col("quality").cast("int"), F.when(F.col("n_chars") < 500, 0).otherwise(F.col("quality")).cast("int"))
    return out.withColumn("row_share", F.round("row_share", 6))


@query("a6_reconcile", "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'open' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'done' ELSE 'missing' END AS category, count(*) AS n FROM customer GROUP BY 1")
def a6(spark, d):
    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return A.reconcile(read_table(spark, d, "customer"), {"open": orders.where("o_orderstatus = 'P'"), "done": orders}, "c_custkey")


@query(
    "a7_compare_ids",
    """WITH l AS (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1), r AS (SELECT doc_id, count(*) AS b FROM labels GROUP BY 1) SELECT CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS ids, CAST(coalesce(sum(a), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(b), 0) AS BIGINT) AS right_rows FROM l FULL JOIN r USING (doc_id) GROUP BY 1""",
)
def a7(spark, d):
    return A.compare_ids(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id")


@query("a8_catalog_denominator", f"WITH {EVENTS} SELECT p_brand, count(DISTINCT resource_id) AS active, count(DISTINCT p_partkey) AS items, round(count(DISTINCT resource_id) / count(DISTINCT p_partkey), 6) AS ratio FROM part LEFT JOIN ev ON resource_id = p_partkey AND flag = 'R' GROUP BY 1")
def a8(spark, d):
    used = events(spark, d).where("flag = 'R'").select(F.col("resource_id").alias("p_partkey")).distinct().withColumn("used", F.lit(1))
    return read_table(spark, d, "part").join(used, "p_partkey", "left").groupBy("p_brand").agg(F.count("used").alias("active"), F.count("*").alias("items"), F.round(F.count("used") / F.count("*"), 6).alias("ratio"))


@query("a9_score_ceiling", f"WITH {EVENTS} SELECT decision, count(*) AS n FROM (SELECT course_id, CASE WHEN max(score) > 95000 THEN 'overflow' WHEN max(score) >= 85500 THEN 'complete' ELSE 'partial' END AS decision FROM ev GROUP BY course_id) GROUP BY 1")
def a9(spark, d):
    return A.ceiling(events(spark, d), "course_id", "score", 95000.0).groupBy("decision").agg(F.count("*").alias("n"))


@query("a10_score_contract", f"WITH {EVENTS} SELECT concat_ws('+', CASE WHEN flag = 'R' THEN 'exam' END, CASE WHEN line > 3 THEN 'late' END) AS signature, count(*) AS n, round(quantile_cont(score, 0.5), 2) AS p50, round(quantile_cont(score, 0.99), 2) AS p99, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY 1")
def a10(spark, d):
    out = A.score_contract(events(spark, d), {"exam": F.col("flag") == "R", "late": F.col("line") > 3}, "score")
    return out.select("signature", "n", F.round("p50", 2).alias("p50"), F.round("p99", 2).alias("p99"), F.round("share", 6).alias("share"))


@query("a11_label_coverage", "SELECT source, count(*) AS n, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def a11(spark, d):
    return A.label_coverage(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id", "source").withColumn("coverage", F.round("coverage", 6))


@query("a12_class_support", f"WITH {LABELLED}, p AS (SELECT quality, offering_id, count(*) AS k FROM lab GROUP BY 1, 2) SELECT quality, count(*) AS units, CAST(sum(k) AS BIGINT) AS n, round(max(k) / sum(k), 6) AS top_share, max(k) / sum(k) > 0.08 AS dominated FROM p GROUP BY 1")
def a12(spark, d):
    return A.class_support(labelled(spark, d), "offering_id", "quality", 0.08).withColumn("top_share", F.round("top_share", 6))


@query("a13_strict_shares", f"WITH {STRICT} SELECT window_id, split, round(avg(strict_P1::INT), 6) AS p1, round(avg(strict_P4::INT), 6) AS p4 FROM st GROUP BY 1, 2")
def a13(spark, d):
    return strict(spark, d).groupBy("window_id", "split").agg(F.round(F.avg(F.col("strict_P1").cast("int")), 6).alias("p1"), F.round(F.avg(F.col("strict_P4").cast("int")), 6).alias("p4"))


@query("a14_grain_histogram", "SELECT rows_per_key, count(*) AS keys, count(*) FILTER (WHERE labels > 1) AS conflicting FROM (SELECT count(*) AS rows_per_key, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1")
def a14(spark, d):
    return A.grain_histogram(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")
