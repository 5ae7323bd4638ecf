"""Queries of quality facts, drift, imputation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import quality as D
from ..operators.audits import mutual_information
from ..sources.tables import read_table
from .base import LABELLED, labelled
from .registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def rounded(df, n=6):
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def lines(spark, d):
    return read_table(spark, d, "lineitem")


def holes(spark, d):
    """Order lines with derived nulls: discounts of returned lines are unknown."""
    return lines(spark, d).withColumn("l_discount", F.when(F.col("l_returnflag") != "R", F.col("l_discount"))).withColumn("mask", (F.col("l_linestatus") == "F").cast("int"))


HOLES = "h AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS l_discount, (l_linestatus = 'F')::INT AS mask, l_returnflag, l_shipdate, l_suppkey FROM lineitem)"
YEAR = "CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END"


@query(
    "d1_feature_quality",
    f"WITH {HOLES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(avg(({c} IS NULL)::INT), 6) AS null_rate, round(avg(coalesce({c} = 0, false)::INT), 6) AS zero_rate, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std FROM h" for c in NUM),
)
def d1(spark, d):
    x = D.feature_quality(holes(spark, d), NUM)
    return x.select("feature", "n", F.round("null_rate", 6).alias("null_rate"), F.round("zero_rate", 6).alias("zero_rate"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("d2_scope_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS rate FROM lineitem GROUP BY 1, 2")
def d2(spark, d):
    return D.scope_counts(lines(spark, d), ["l_returnflag", "l_linestatus"], "l_orderkey", ["l_returnflag"]).select("l_returnflag", "l_linestatus", "n", F.round("rate", 6).alias("rate"))


@query("d3_mask_quality", f"WITH {HOLES} SELECT 'mask' AS mask, round(avg(mask), 6) AS rate, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS outside FROM h")
def d3(spark, d):
    return D.mask_quality(holes(spark, d), ["mask"]).withColumn("rate", F.round("rate", 6))


@query(
    "d4_quality_gate",
    f"WITH {HOLES}, q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(({c} IS NULL)::INT) AS nr, avg(coalesce({c} = 0, false)::INT) AS zr FROM h" for c in NUM) + ") SELECT feature, 'many_nulls' AS rule, 'blocking' AS severity FROM q WHERE nr > 0.3 UNION ALL SELECT feature, 'zeros', 'warning' FROM q WHERE zr > 0.01",
)
def d4(spark, d):
    return D.quality_gate(D.feature_quality(holes(spark, d), NUM), [("many_nulls", "blocking", F.col("null_rate") > 0.3), ("zeros", "warning", F.col("zero_rate") > 0.01)])


@query(
    "d5_categorical_audit",
    "WITH u AS (SELECT 'p_brand' AS feature, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part) SELECT feature, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT feature, value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM u GROUP BY 1, 2) WHERE r <= 64",
)
def d5(spark, d):
    return D.categorical_audit(read_table(spark, d, "part"), ["p_brand", "p_type"])


@query(
    "d6_cell_states",
    f"WITH {HOLES} SELECT CASE WHEN l_linenumber > 5 THEN 'unavailable' WHEN mask = 0 THEN 'structural' WHEN l_discount IS NULL THEN 'missing' WHEN l_discount = 0 THEN 'zero' ELSE 'observed' END AS state, count(*) AS n FROM h GROUP BY 1",
)
def d6(spark, d):
    state = D.cell_state(F.col("l_discount"), F.col("l_linenumber") <= 5, F.col("mask") == 1)
    return holes(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("d7_structural_mask", f"WITH {HOLES} SELECT mask, CAST(sum((mask = 0)::INT) AS BIGINT) AS structural FROM h GROUP BY 1")
def d7(spark, d):
    return D.structural_mask(holes(spark, d), ["l_discount"], "mask").groupBy("mask").agg(F.sum("structural__l_discount").alias("structural"))


@query(
    "d8_quality_summary",
    f"WITH {HOLES} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS nonfinite_rows, CAST(0 AS BIGINT) AS negative_rows, CAST(0 AS BIGINT) AS bad_mask_rows, CAST(0 AS BIGINT) AS null_labels, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys FROM h",
)
def d8(spark, d):
    return D.quality_summary(holes(spark, d), NUM[:2], ["mask"], ["l_orderkey", "l_linenumber"], "l_returnflag")


def split(spark, d):
    return lines(spark, d).withColumn("part", F.when(F.col("l_shipdate") < "2000-01-01", "train").otherwise("test"))


#: Edges of ten bins over training values; an edge not above the one before is set just above it (here written out, not folded).
STRICT = "list_transform(range(1, 12), lambda i: list_max(list_transform(range(1, i + 1), lambda j: q[j] + CASE WHEN j < i AND q[i] <= q[j] THEN (i - j) * 1e-7 ELSE 0 END)))"
STEPS = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
SCHEME = f"""sp AS (SELECT CASE WHEN l_returnflag = 'R' THEN 7.0 * l_linenumber ELSE l_quantity END AS v, CASE WHEN l_returnflag = 'R' THEN 'imputed' ELSE 'observed' END AS status, {YEAR} AS part FROM lineitem),
  qu AS (SELECT quantile_cont(v, {STEPS}) AS q, count(*) AS n FROM sp WHERE part = 'train' AND status = 'observed'), ed AS (SELECT {STRICT} AS edges, n FROM qu),
  hb AS (SELECT part, status, v, len(list_filter(edges[2:10], lambda e: e <= v)) AS bin FROM sp, ed), hs AS (SELECT part, bin, count(*) AS n FROM hb GROUP BY 1, 2)"""


def filled_lines(spark, d):
    """Order lines whose quantity is imputed for returned ones."""
    gone = F.col("l_returnflag") == "R"
    return split(spark, d).withColumn("gone", gone).withColumn("l_quantity", F.when(gone, F.col("l_linenumber") * 7.0).otherwise(F.col("l_quantity"))).withColumn("one", F.lit(3.0))


def scheme(spark, d, columns=("l_quantity",)):
    return D.bin_scheme(filled_lines(spark, d).where("part = 'train' and not gone"), list(columns))


def sketches(spark, d):
    return D.hist_sketch(filled_lines(spark, d), scheme(spark, d), ["l_quantity"], ["part"], {"l_quantity": F.col("gone")})


def histograms(spark, d):
    """All values of both statuses by part and bin."""
    whole = D.hist_sketch(filled_lines(spark, d), scheme(spark, d), ["l_quantity"], ["part"])
    return D.histogram_rows(whole, ["part", "feature"])


@query(
    "d9_bin_scheme",
    f"""WITH {SCHEME}, al AS (SELECT 'l_quantity' AS feature, n, edges FROM ed UNION ALL SELECT 'one', n, list_transform(range(11), lambda i: 3.0 + i * 1e-7) FROM ed)
    SELECT feature, n, CAST(unnest(range(11)) AS INTEGER) AS place, round(unnest(edges), 9) AS edge FROM al""",
)
def d9(spark, d):
    """Eleven edges of each column, of a constant one too."""
    x = scheme(spark, d, ("l_quantity", "one"))
    return rounded(x.select("feature", "n", F.posexplode("edges").alias("place", "edge")), 9)


@query(
    "d10_hist_sketch",
    f"""WITH {SCHEME}, g AS (SELECT part, status, count(*) AS n, min(v) AS low, max(v) AS high, avg(v) AS mean, var_pop(v) * count(*) AS m2, stddev_pop(v) AS std, quantile_cont(v, [0.05, 0.5, 0.95]) AS p, list_transform(range(10), lambda b: len(list_filter(list(bin), lambda x: x = b))) AS counts FROM hb GROUP BY 1, 2),
    m AS (SELECT part, status, sum(pow(v - mean, 3)) AS m3 FROM hb JOIN g USING (part, status) GROUP BY 1, 2),
    k AS (SELECT part, status, unnest(range(1, 11)) AS b, unnest(list_transform(counts, lambda c: c / n)) AS s FROM g), j AS (SELECT part, b, max(s) FILTER (WHERE status = 'observed') AS p, max(s) FILTER (WHERE status = 'imputed') AS q FROM k GROUP BY 1, 2),
    d AS (SELECT part, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS jsd FROM j GROUP BY 1)
    SELECT part, 'l_quantity' AS feature, status, n, low, high, round(mean, 6) AS mean, round(std, 6) AS std, round(m2 / n, 4) AS m2, round(m3 / n, 3) AS m3, p[1] AS p05, p[2] AS p50, p[3] AS p95, array_to_string(counts, ',') AS counts, round(jsd, 8) AS jsd FROM g JOIN m USING (part, status) JOIN d USING (part)""",
)
def d10(spark, d):
    x = sketches(spark, d).withColumn("counts", F.array_join("counts", ",")).withColumn("m2", F.round(F.col("m2") / F.col("n"), 4)).withColumn("m3", F.round(F.col("m3") / F.col("n"), 3))
    return x.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), "jsd": F.round("jsd", 8)})


@query(
    "d10_merged_sketches",
    f"""WITH {SCHEME}, w AS (SELECT *, avg(v) OVER (PARTITION BY status) AS mean FROM hb)
    SELECT 'l_quantity' AS feature, status, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(pow(v - mean, 3)) / pow(var_pop(v), 1.5), 6) AS skew, array_to_string(list_transform(range(10), lambda b: len(list_filter(list(bin), lambda x: x = b))), ',') AS counts FROM w GROUP BY status""",
)
def d10_merged(spark, d):
    """The sketches of both parts merged, against the whole."""
    x = D.merge_sketches(sketches(spark, d), []).withColumn("counts", F.array_join("counts", ","))
    skew = F.sqrt("n") * F.col("m3") / F.pow("m2", F.lit(1.5))
    return rounded(x.select("feature", "status", "n", "low", "high", "mean", "std", skew.alias("skew"), "counts"))


@query(
    "d11_jsd",
    f"WITH {SCHEME}, pq AS (SELECT bin, sum(n) FILTER (WHERE part = 'train') / (SELECT sum(n) FROM hs WHERE part = 'train') AS p, sum(n) FILTER (WHERE part = 'test') / (SELECT sum(n) FROM hs WHERE part = 'test') AS q FROM hs GROUP BY 1) SELECT 'l_quantity' AS feature, round(sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2), 8) AS jsd FROM pq",
)
def d11(spark, d):
    h = histograms(spark, d)
    return D.histogram_jsd(h.where("part = 'train'"), h.where("part = 'test'"), ["feature"], 10).withColumn("jsd", F.round("jsd", 8))


@query(
    "d12_psi",
    f"WITH {SCHEME}, pq AS (SELECT bin, sum(n) FILTER (WHERE part = 'train') / (SELECT sum(n) FROM hs WHERE part = 'train') AS p, sum(n) FILTER (WHERE part = 'test') / (SELECT sum(n) FROM hs WHERE part = 'test') AS q FROM hs GROUP BY 1) SELECT 'l_quantity' AS feature, round(sum((q - p) * ln(q / p)), 8) AS psi FROM pq",
)
def d12(spark, d):
    h = histograms(spark, d)
    return D.psi(h.where("part = 'train'"), h.where("part = 'test'"), ["feature"]).withColumn("psi", F.round("psi", 8))


@query(
    "d13_class_distribution",
    f"WITH {LABELLED}, c AS (SELECT offering_id, y_raw, count(*) AS n FROM lab GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY offering_id) AS p FROM c) SELECT offering_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS classes, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS normalised_entropy, round(max(n) / min(n), 6) AS imbalance FROM p GROUP BY 1",
)
def d13(spark, d):
    x = D.class_distribution(labelled(spark, d), ["offering_id"], "y_raw")
    return x.withColumn("normalised_entropy", F.round("normalised_entropy", 6)).withColumn("imbalance", F.round("imbalance", 6))


WIDE = "w AS (SELECT user_id, " + ", ".join(f"nullif(count(*) FILTER (WHERE day(ts) <= {k * 7}), 0) AS n_P{k}" for k in (1, 2, 3, 4)) + " FROM events WHERE event_type = 'purchase' GROUP BY 1)"


def wide(spark, d):
    n = lambda k: F.count_if(F.dayofmonth("ts") <= k * 7)
    return read_table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(*(F.when(n(k) > 0, n(k)).alias(f"n_P{k}") for k in (1, 2, 3, 4)))


KINDS, PHASES = ["view", "purchase"], ["P1", "P2", "P3", "P4"]
#: Cumulative counts of two kinds of events by week, null where none; an enrollment lasts from the first event to the last.
ACTIVE = f"""en AS (SELECT user_id, min(ts) AS enroll, max(ts) AS last FROM events GROUP BY 1), ac AS (SELECT e.user_id, any_value(enroll) AS enroll, any_value(last) AS last, {", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{m}' AND ts <= enroll + INTERVAL {2 * k} DAY), 0) AS {m}_P{k}" for m in KINDS for k in (1, 2, 3, 4))},
  {", ".join(f"CASE WHEN e.user_id % 7 > 0 THEN least(any_value(enroll) + INTERVAL {2 * k} DAY, any_value(last)) END AS cut_P{k}" for k in (1, 2, 3, 4))} FROM events e JOIN en USING (user_id) GROUP BY 1)"""


def active(spark, d):
    e = read_table(spark, d, "events")
    span = e.groupBy("user_id").agg(F.min("ts").alias("enroll"), F.max("ts").alias("last"))
    upto = lambda k: F.col("enroll") + F.expr(f"make_dt_interval({2 * k})")
    n = lambda m, k: F.count_if((F.col("event_type") == m) & (F.col("ts") <= upto(k)))
    counts = e.join(span, "user_id").groupBy("user_id", "enroll", "last").agg(*(F.when(n(m, k) > 0, n(m, k)).alias(f"{m}_P{k}") for m in KINDS for k in (1, 2, 3, 4)))
    return counts.withColumns({f"cut_P{k}": F.when(F.col("user_id") % 7 > 0, F.least(upto(k), F.col("last"))) for k in (1, 2, 3, 4)})


def activity_sql(k):
    total = lambda i: " + ".join(f"coalesce({m}_P{i}, 0)" for m in KINDS) if i else "0"
    cells = [f"{m}_P{i}" for m in KINDS for i in range(1, k + 1)]
    timed, whole, seen = f"(epoch_us(last) - epoch_us(enroll)) // 86400000000 > 0 AND cut_P{k} IS NOT NULL", "((epoch_us(last) - epoch_us(enroll)) // 86400000000)", f"((epoch_us(cut_P{k}) - epoch_us(enroll)) // 86400000000)"
    return f"""SELECT 'P{k}' AS phase, count(*) AS n, round(avg(({total(k)} = 0)::INT), 6) AS zero_activity, round(avg(({total(k)} = {total(k - 1)})::INT), 6) AS inactive, round(avg({total(k)}), 6) AS mean_events,
      CAST(sum({" + ".join(f"coalesce(({c} = 0)::INT, 0)" for c in cells)}) AS BIGINT) AS zero_cells, CAST(sum({" + ".join(f"({c} IS NOT NULL)::INT" for c in cells)}) AS BIGINT) AS known_cells, count(*) FILTER (WHERE {timed}) AS timed,
      round(avg({seen}) FILTER (WHERE {timed}), 6) AS observed_length, round(avg({seen} / {whole}) FILTER (WHERE {timed}), 6) AS observed_fraction, count(*) FILTER (WHERE {total(k)} < {total(k - 1)}) AS monotone_violations FROM ac"""


@query("d14_activity_profile", f"WITH {ACTIVE} {' UNION ALL '.join(activity_sql(k) for k in (1, 2, 3, 4))}")
def d14(spark, d):
    cells = [f"{m}_{p}" for m in KINDS for p in PHASES]
    return rounded(D.activity_profile(active(spark, d), KINDS, PHASES, cells, "enroll", "last", {p: f"cut_{p}" for p in PHASES}))


@query(
    "d15_missing_information",
    f"WITH {HOLES}, c AS (SELECT (l_discount IS NULL) AS x, mask AS y, count(*) AS n FROM h GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER () AS s, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c) SELECT round(sum(n / s * ln(n * s / (nx * ny))), 8) AS mi FROM t",
)
def d15(spark, d):
    x = holes(spark, d).withColumn("gone", F.col("l_discount").isNull())
    return mutual_information(x, "gone", "mask").select(F.round("mi", 8).alias("mi"))


@query(
    "d16_static_audit",
    """WITH x AS (SELECT o_custkey AS g, o_totalprice, c_nationkey, 1 AS one FROM orders JOIN customer ON o_custkey = c_custkey), u AS (SELECT 'o_totalprice' AS feature, g, o_totalprice AS v FROM x UNION ALL SELECT 'c_nationkey', g, c_nationkey FROM x UNION ALL SELECT 'one', g, one FROM x),
    p AS (SELECT feature, g, count(DISTINCT v) AS k FROM u GROUP BY 1, 2), w AS (SELECT feature, max(k) AS k FROM p GROUP BY 1), t AS (SELECT feature, count(DISTINCT v) AS "values" FROM u GROUP BY 1)
    SELECT feature, "values", CASE WHEN "values" <= 1 THEN 'constant' WHEN k = 1 THEN 'group_constant' ELSE 'varies' END AS flag FROM w JOIN t USING (feature)""",
)
def d16(spark, d):
    x = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("one", F.lit(1))
    return D.static_audit(x, ["o_totalprice", "c_nationkey", "one"], "o_custkey").select("feature", "values", "flag")


@query("d17_prefix_scan", f"WITH {WIDE} SELECT 'n_P3' AS feature, count(n_P3) AS violations FROM w UNION ALL SELECT 'n_P4', count(n_P4) FROM w")
def d17(spark, d):
    return D.prefix_scan(wide(spark, d), ["n_P3", "n_P4"])


@query(
    "d17_static_parity",
    "WITH o AS (SELECT DISTINCT o_custkey FROM orders), x AS (SELECT c_custkey, o_custkey, c_acctbal FROM customer FULL JOIN o ON c_custkey = o_custkey) SELECT 'c_nationkey' AS feature, count(*) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NOT NULL) AS compared, CAST(0 AS BIGINT) AS mismatches, count(*) FILTER (WHERE o_custkey IS NULL OR c_custkey IS NULL) AS one_side FROM x UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE o_custkey IS NOT NULL AND c_custkey IS NOT NULL), count(*) FILTER (WHERE o_custkey IS NOT NULL AND c_acctbal < 0), count(*) FILTER (WHERE o_custkey IS NULL OR c_custkey IS NULL) FROM x",
)
def d17_parity(spark, d):
    """Customers against those that have orders, whose negative balances were lost on the way."""
    first = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    later = first.join(read_table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return D.static_parity(first, later, "c_custkey", ["c_nationkey", "c_acctbal"])


@query("d18_course_cohort", "WITH tr AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01') SELECT CASE WHEN t.l_partkey IS NULL THEN 'UNSEEN' ELSE 'SEEN' END AS cohort, l_returnflag, count(*) AS n FROM lineitem l LEFT JOIN tr t USING (l_partkey) WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY 1, 2")
def d18(spark, d):
    x = lines(spark, d)
    return D.cohort_flag(x.where("l_shipdate >= '2001-01-01'"), x.where("l_shipdate < '1996-06-01'"), "l_partkey").groupBy("cohort", "l_returnflag").agg(F.count("*").alias("n"))


FAMILIES = {"l_quantity": "amount", "l_extendedprice": "amount", "l_discount": "rate", "l_tax": "rate"}
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def probe(spark, d, chained):
    """Zero and the median of what stays visible; with ``chained``, trees over the other columns too. Discounts of late lines are structurally absent."""
    x = lines(spark, d).select(*KEY, *FAMILIES)
    late = {"l_discount": F.col("l_linenumber") > 5}
    seen = x.withColumns({c: F.when(late.get(c, F.lit(False)) | ~D.hidden_cells(c, KEY, 0.05, 7), F.col(c)) for c in FAMILIES})
    columns = list(FAMILIES)
    middle = I.fit_univariate(seen, columns)
    imputers = {"zero": lambda m: I.impute_constant(m, columns), "median": lambda m: I.apply_constants(m, middle)}
    if chained:
        imputers["trees"] = I.fit_chained(seen, columns, "tree")
    return rounded(D.fidelity_probe(x, FAMILIES, KEY, 0.05, 7, imputers, late))


def hidden_sql(c):
    digest = f"('0x' || substr(md5(concat_ws('|', '7', '{c}', {', '.join(KEY)})), 1, 8))::BIGINT / 4294967296.0 < 0.05"
    return f"({digest} AND l_linenumber <= 5)" if c == "l_discount" else f"({digest})"


@query(
    "d19_fidelity_probe",
    f"""WITH hd AS (SELECT *, {", ".join(f"{hidden_sql(c)} AS h_{c}" for c in FAMILIES)} FROM lineitem), md AS (SELECT {", ".join(f"median({c}) FILTER (WHERE NOT h_{c}) AS m_{c}" for c in FAMILIES)} FROM hd),
    er AS ({" UNION ALL ".join(f"SELECT '{f}' AS family, unnest(['zero', 'median']) AS imputer, unnest([abs({c}), abs({c} - m_{c})]) AS e FROM hd, md WHERE h_{c}" for c, f in FAMILIES.items())})
    SELECT imputer, family, count(*) AS n, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(median(e), 6) AS median_error FROM er GROUP BY 1, 2""",
)
def d19(spark, d):
    return probe(spark, d, chained=False)


@query("d19_fidelity_of_trees")
def d19_trees(spark, d):
    return probe(spark, d, chained=True)


@query("i2_melt_phases", f"WITH {WIDE} SELECT user_id, phase, n FROM w, (VALUES ('P1'), ('P2'), ('P3'), ('P4')) AS p(phase), LATERAL (SELECT CASE phase WHEN 'P1' THEN n_P1 WHEN 'P2' THEN n_P2 WHEN 'P3' THEN n_P3 ELSE n_P4 END AS n)")
def i2(spark, d):
    return I.melt_phases(wide(spark, d), ["user_id"], ["n"], ["P1", "P2", "P3", "P4"])


@query("i3_log_counts", "SELECT l_returnflag, round(sum(ln(1 + l_quantity)), 4) AS total FROM lineitem GROUP BY 1")
def i3(spark, d):
    return I.log_counts(lines(spark, d), ["l_quantity"]).groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("total"))


@query("i4_constant_fill", f"WITH {HOLES} SELECT l_returnflag, CAST(sum((l_discount IS NULL)::INT) AS BIGINT) AS missing, round(sum(coalesce(l_discount, 0)), 4) AS total FROM h GROUP BY 1")
def i4(spark, d):
    return I.impute_constant(holes(spark, d), ["l_discount"]).groupBy("l_returnflag").agg(F.sum("missing__l_discount").alias("missing"), F.round(F.sum("l_discount"), 4).alias("total"))


@query("i5_univariate", f"WITH {HOLES}, m AS (SELECT quantile_cont(l_discount, 0.5) AS med, avg(l_quantity) AS mean FROM h WHERE {YEAR} = 'train') SELECT l_returnflag, round(sum(coalesce(l_discount, med)), 4) AS filled, round(any_value(mean), 6) AS mean_quantity FROM h, m GROUP BY 1")
def i5(spark, d):
    x = holes(spark, d)
    train = x.where("l_shipdate < '2000-01-01'")
    mean = I.fit_univariate(train, ["l_quantity"], "mean")["l_quantity"]
    out = I.apply_constants(x, I.fit_univariate(train, ["l_discount"]))
    return out.groupBy("l_returnflag").agg(F.round(F.sum("l_discount"), 4).alias("filled"), F.round(F.lit(mean), 6).alias("mean_quantity"))


def gaps(spark, d):
    """Order lines without the discounts of returned lines and the quantities of each fourth line; prices are complete."""
    return holes(spark, d).withColumn("l_quantity", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")))


def _chained(spark, d, how, rounds):
    x = gaps(spark, d)
    out = I.fit_chained(x.where("l_shipdate < '2000-01-01'"), NUM, how, rounds, key="l_orderkey")(x)
    own = lambda c: F.count_if(F.col(c).isNull()).alias(f"{c}_null")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("missing__l_discount").alias("filled"), own("l_discount"), own("l_quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_quantity"), 4).alias("quantity"))


def _ridge_sql(rounds):
    """Chained least squares of quantity (fewer gaps) and discount on the other and the price, in closed form."""
    steps = [f"""WITH h0 AS (SELECT l_returnflag, ({YEAR}) = 'train' AS tr, l_extendedprice AS c, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS a0, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS b0 FROM lineitem),
    m0 AS (SELECT quantile_cont(a0, 0.5) AS ma, quantile_cont(b0, 0.5) AS mb, min(a0) AS alo, max(a0) AS ahi, min(b0) AS blo, max(b0) AS bhi FROM h0 WHERE tr), s0 AS (SELECT h0.*, m0.*, coalesce(a0, ma) AS a, coalesce(b0, mb) AS b FROM h0, m0)"""]
    at = 0
    for _ in range(rounds):
        for y, x in (("b", "a"), ("a", "b")):
            cov = f"covar_pop({x}, {x}) * covar_pop(c, c) - covar_pop({x}, c) ** 2"
            steps.append(f"""k{at} AS (SELECT (covar_pop({y}, {x}) * covar_pop(c, c) - covar_pop({y}, c) * covar_pop({x}, c)) / ({cov}) AS w1, (covar_pop({y}, c) * covar_pop({x}, {x}) - covar_pop({y}, {x}) * covar_pop({x}, c)) / ({cov}) AS w2, avg({y}) AS my, avg({x}) AS mx, avg(c) AS mc FROM s{at} WHERE tr AND {y}0 IS NOT NULL),
    s{at + 1} AS (SELECT * REPLACE (CASE WHEN {y}0 IS NULL THEN least(greatest(my + w1 * ({x} - mx) + w2 * (c - mc), {y}lo), {y}hi) ELSE {y} END AS {y}) FROM (SELECT s{at}.*, k{at}.* FROM s{at}, k{at}))""")
            steps[-1] = steps[-1].replace("SELECT * REPLACE", "SELECT * EXCLUDE (w1, w2, my, mx, mc) REPLACE")
            at += 1
    return ", ".join(steps) + f" SELECT l_returnflag, count(*) AS n, CAST(sum((a0 IS NULL)::INT) AS BIGINT) AS filled, CAST(0 AS BIGINT) AS l_discount_null, CAST(0 AS BIGINT) AS l_quantity_null, round(avg(a), 6) AS discount, round(avg(b), 4) AS quantity FROM s{at} GROUP BY 1"


@query("i6_chained_trees")
def i6(spark, d):
    return _chained(spark, d, "tree", 1)


@query("i7_chained_ridge", _ridge_sql(3))
def i7(spark, d):
    return _chained(spark, d, "ridge", 3)


@query("i8_robust_scaling", f"WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem WHERE {YEAR} = 'train') SELECT l_returnflag, round(avg((l_quantity - med) / iqr), 6) AS mean_scaled FROM lineitem, m GROUP BY 1")
def i8(spark, d):
    x = lines(spark, d)
    return I.scale(x, I.fit_robust(x.where("l_shipdate < '2000-01-01'"), ["l_quantity"])).groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_scaled"))


@query("i9_vocabulary", "WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3)) SELECT CAST(coalesce(code, 0) AS INTEGER) AS code, count(*) AS n FROM part LEFT JOIN v USING (p_brand) GROUP BY 1")
def i9(spark, d):
    part = read_table(spark, d, "part")
    return I.encode(part, "p_brand", I.fit_vocab(part.where("p_size < 3"), "p_brand"), "code").groupBy("code").agg(F.count("*").alias("n"))


@query("i10_prefix_transform", f"WITH {WIDE}, m AS (SELECT quantile_cont(n_P1, 0.5) AS a, quantile_cont(n_P2, 0.5) AS b FROM w) SELECT user_id, CAST(coalesce(n_P1, a) AS DOUBLE) AS n_P1, CAST(coalesce(n_P2, b) AS DOUBLE) AS n_P2, 0.0 AS n_P3, (n_P2 IS NULL)::INT AS missing_p2 FROM w, m")
def i10(spark, d):
    x = wide(spark, d)
    out = I.prefix_transform(x, I.fit_univariate(x, [f"n_P{k}" for k in (1, 2, 3, 4)]), ["P1", "P2", "P3", "P4"], 2)
    return out.select("user_id", "n_P1", "n_P2", "n_P3", F.col("missing__n_P2").alias("missing_p2"))


@query("i11_impute_audit", "SELECT CAST(0 AS BIGINT) AS l_discount, CAST(0 AS BIGINT) AS l_quantity")
def i11(spark, d):
    x = holes(spark, d)
    return I.impute_audit(I.apply_constants(x, I.fit_univariate(x, ["l_discount", "l_quantity"])), ["l_discount", "l_quantity"])
