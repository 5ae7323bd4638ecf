"""Queries of metrics, resampling, facts and balancing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.ranking import quantiles
from ..operators import balance as B
from ..operators import facts as X
from ..operators import inspected as Z
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import quality as D
from ..operators import resample as R
from ..sources.tables import read_table
from .base import PREDICTIONS, labelled, predictions
from .registry import query


def strict_slice():
    return F.when(F.col("strict") == 1, "STRICT").otherwise("OVERLAP")


CM = f"""{PREDICTIONS}, cl AS (SELECT course_id, k AS class_id, count(*) AS total, count(*) FILTER (WHERE y_true = k AND y_pred = k) AS tp, count(*) FILTER (WHERE y_true = k) AS support, count(*) FILTER (WHERE y_pred = k) AS predicted
  FROM pred, (VALUES (0), (1), (2)) AS ks(k) GROUP BY 1, 2),
  pc AS (SELECT *, CASE WHEN support > 0 THEN coalesce(tp / nullif(predicted, 0), 0) END AS precision, CASE WHEN support > 0 THEN tp / support END AS recall, CASE WHEN support > 0 THEN (total - support - predicted + tp) / nullif(total - support, 0) END AS specificity,
    CASE WHEN support > 0 THEN 2 * tp / (support + predicted) END AS f1 FROM cl)"""
OVERALL = "sum(tp) / sum(support) AS accuracy, avg(coalesce(recall,0)) AS balanced_accuracy, avg(coalesce(f1, 0)) AS macro_f1_fixed, sum(coalesce(f1, 0) * support) / sum(support) AS weighted_f1, pow(product(coalesce(recall,0)),1/3.0) AS gmean"


def rounded(df, n=6, skip=()):
    return df.select(*(F.round(c, n).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


def classes(spark, d, keys=("course_id",)):
    return M.per_class(M.confusion(predictions(spark, d), list(keys)), list(keys))


@query("m1_normalise_probs", f"WITH {PREDICTIONS} SELECT doc_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, y_pred AS argmax FROM pred")
def m1(spark, d):
    x = predictions(spark, d).withColumns({p: F.col(p) * 0.5 for p in M.PROBS})
    return rounded(M.normalise_probs(x).select("doc_id", *M.PROBS, "argmax"))


@query("m2_confusion", f"WITH {PREDICTIONS} SELECT course_id, y_true, y_pred, count(*) AS n FROM pred GROUP BY 1, 2, 3")
def m2(spark, d):
    return M.confusion(predictions(spark, d), ["course_id"])


@query("m3_per_class", f"WITH {CM} SELECT course_id, class_id, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1 FROM pc")
def m3(spark, d):
    return rounded(classes(spark, d).select("course_id", "class_id", "support", "precision", "recall", "specificity", "f1"))


@query("m4_overall", f"WITH {CM} SELECT course_id, " + ", ".join(f"round({p.split(' AS ')[0]}, 6) AS {p.split(' AS ')[1]}" for p in OVERALL.replace("coalesce(f1, 0)", "coalesce(f1,0)").split(", ")) + " FROM pc GROUP BY 1")
def m4(spark, d):
    return rounded(M.overall(classes(spark, d), ["course_id"]).select("course_id", "accuracy", "balanced_accuracy", "macro_f1_fixed", "weighted_f1", "gmean"))


MK = """s AS (SELECT course_id, max(total)::DOUBLE AS s, sum(tp) AS c, sum(support::DOUBLE * predicted) AS pt, sum(predicted::DOUBLE * predicted) AS pp, sum(support::DOUBLE * support) AS tt, sum((support > 0)::INT) AS present FROM cl GROUP BY 1),
  mk AS (SELECT course_id, CASE WHEN present > 1 THEN coalesce((c * s - pt) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0) ELSE 0 END AS mcc, CASE WHEN present > 1 THEN coalesce((c * s - pt) / nullif(s * s - pt, 0), 0) ELSE 0 END AS kappa FROM s)"""


@query("m5_mcc_kappa", f"WITH {CM}, {MK} SELECT course_id, round(mcc, 6) AS mcc, round(kappa, 6) AS kappa FROM mk")
def m5(spark, d):
    return rounded(M.mcc_kappa(classes(spark, d), ["course_id"]))


SCORES = f"""{PREDICTIONS}, sc AS (SELECT k AS class_id, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score, (y_true = k)::INT AS hit FROM pred, (VALUES (0), (1), (2)) AS ks(k)), gs AS (SELECT class_id, score, count(*) AS n, sum(hit) AS pos FROM sc GROUP BY 1, 2)"""


def scores(spark, d):
    return M.one_vs_rest(predictions(spark, d).withColumn("all", F.lit("all")), ["all"])


@query("m6_average_precision", f"WITH {SCORES}, c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM gs WINDOW w AS (PARTITION BY class_id ORDER BY score DESC)) SELECT class_id, round(sum(pos * tp / k) / sum(pos), 6) AS ap FROM c GROUP BY 1")
def m6(spark, d):
    return rounded(M.average_precision(scores(spark, d), ["all"]).drop("all"))


@query("m7_roc_auc", f"WITH {SCORES}, c AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY class_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gs) SELECT class_id, round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS auc FROM c GROUP BY 1")
def m7(spark, d):
    return rounded(M.roc_auc(scores(spark, d), ["all"]).drop("all"))


OWN = "CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"


@query("m8_losses", f"WITH {PREDICTIONS} SELECT course_id, round(avg(-ln({OWN})), 6) AS log_loss, round(avg(pow(p0 - (y_true = 0)::INT, 2) + pow(p1 - (y_true = 1)::INT, 2) + pow(p2 - (y_true = 2)::INT, 2)), 6) AS brier FROM pred GROUP BY 1")
def m8(spark, d):
    return rounded(M.losses(predictions(spark, d), ["course_id"]))


@query("m9_ece", f"WITH {PREDICTIONS}, b AS (SELECT course_id, greatest(p0, p1, p2) AS conf, (y_true = y_pred)::INT AS hit, least(floor(greatest(p0, p1, p2) * 15), 14) AS bin FROM pred), e AS (SELECT course_id, count(*) AS n, abs(avg(hit) - avg(conf)) AS gap FROM b GROUP BY course_id, bin) SELECT course_id, round(sum(n * gap) / sum(n), 6) AS ece FROM e GROUP BY 1")
def m9(spark, d):
    return rounded(M.ece(predictions(spark, d), ["course_id"]))


ENTROPY = "-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3)"


@query("m10_entropy", f"WITH {PREDICTIONS} SELECT course_id, round(quantile_cont({ENTROPY}, 0.5), 6) AS median_entropy, round(avg({ENTROPY}), 6) AS mean_entropy FROM pred GROUP BY 1")
def m10(spark, d):
    x = predictions(spark, d).withColumn("e", M.entropy())
    middle = quantiles(x, {"e": F.col("e")}, [0.5], ["course_id"]).select("course_id", F.get("quantiles", F.lit(0)).alias("median_entropy"))
    return rounded(x.groupBy("course_id").agg(F.avg("e").alias("mean_entropy")).join(middle, "course_id"))


def _jsd(p, q):
    return f"sum(({p} * log2({p} / (({p} + {q}) / 2)) + {q} * log2({q} / (({p} + {q}) / 2))) / 2)"


COMPOSITE = f"""WITH {CM}, {MK}, o AS (SELECT course_id, avg(coalesce(f1, 0)) AS macro, avg(coalesce(recall, 0)) AS balanced FROM pc GROUP BY 1),
  tr AS (SELECT class_id, sum(support) AS n, sum(sum(support)) OVER () AS t FROM cl GROUP BY 1),
  sh AS (SELECT course_id, (predicted + 1e-12) / (total + 3e-12) AS p, (support + 1e-12) / (total + 3e-12) AS q, (n + 1e-12) / (t + 3e-12) AS r FROM cl JOIN tr USING (class_id)),
  j AS (SELECT course_id, 1 - {_jsd('p', 'q')} AS majority, 1 - {_jsd('p', 'r')} AS drift FROM sh GROUP BY 1),
  e AS (SELECT course_id, 1 - least(abs(quantile_cont({ENTROPY}, 0.5) - 0.5) / 0.5, 1.0) AS ent, avg(strict) AS eff FROM pred GROUP BY 1),
  x AS (SELECT course_id, pow(greatest(macro, 0.001) * greatest(balanced, 0.001) * greatest((mcc + 1) / 2, 0.001) * greatest((kappa + 1) / 2, 0.001), 0.25) AS perf,
    pow(greatest(majority, 0.001) * greatest(ent, 0.001) * greatest(drift, 0.001) * greatest(eff, 0.001), 1 / 6.0) AS san FROM o JOIN mk USING (course_id) JOIN j USING (course_id) JOIN e USING (course_id))"""


@query("m11_composite", f"{COMPOSITE} SELECT course_id, round(perf, 6) AS s_perf, round(san, 6) AS s_san, round(pow(greatest(perf, 0.001), 0.6) * pow(greatest(san, 0.001), 0.4), 6) AS composite FROM x")
def m11(spark, d):
    x = predictions(spark, d)
    train = {r["y_true"]: r["n"] for r in x.groupBy("y_true").agg(F.count("*").alias("n")).collect()}  # one row a class
    return rounded(M.composite(x, ["course_id"], train, "strict").select("course_id", "s_perf", "s_san", "composite"))


@query("m12_effective_rate", f"WITH {PREDICTIONS} SELECT offering_id, round(avg(strict), 6) AS effective_rate FROM pred GROUP BY 1")
def m12(spark, d):
    return rounded(predictions(spark, d).groupBy("offering_id").agg(F.avg("strict").alias("effective_rate")))


FLAGS = {"no_video": 5, "no_comment": 7, "no_problem": 3}


def flagged(spark, d):
    """Labelled rows with missing flags, of which one goes with the classes, and static columns; a third of them are evaluated."""
    x = predictions(spark, d).join(labelled(spark, d).select("doc_id", "n_chars"), "doc_id")
    x = x.withColumns({f: (F.col("n_chars") % m == 0).cast("int") for f, m in FLAGS.items()}).withColumn("no_video", F.greatest("no_video", ((F.col("y_true") == 1) & (F.col("doc_id") % 2 == 0)).cast("int")))
    return x.withColumn("size", F.log1p("n_chars")).withColumn("foreign", (F.col("course_id") != "en").cast("int")).withColumn("train", F.col("doc_id") % 3 > 0)


def probe_rows(spark, d):
    x = flagged(spark, d)
    return x.where("train"), R.sliced(x.where("not train"), strict_slice())


@query("m13_missingness_probe")
def m13(spark, d):
    """Three classes, each slice of the rows that were held out."""
    return rounded(M.leak_probe(*probe_rows(spark, d), list(FLAGS), "y_true", ["slice"]))


@query("m14_static_probe")
def m14(spark, d):
    sets = {"static": ["foreign"], "missingness": [*FLAGS, "size"], "both": ["foreign", *FLAGS, "size"]}
    return rounded(M.static_probe(*probe_rows(spark, d), sets, "y_true", ["slice"]))


@query("m11_composite_with_probe")
def m11_probe(spark, d):
    """The composite of held-out slices, training counts from training rows, and the probe's part."""
    train, rows = probe_rows(spark, d)
    counts = {r["y_true"]: r["n"] for r in train.groupBy("y_true").agg(F.count("*").alias("n")).collect()}  # one row a class
    return rounded(M.composite(rows, ["slice"], counts, "strict", M.leak_probe(train, rows, list(FLAGS), "y_true", ["slice"])))


@query("m15_support_flags", f"WITH {CM} SELECT course_id, max(total) AS n, min(support) AS least_support, CASE WHEN max(total) < 30 THEN 'small_slice' WHEN min(support) = 0 THEN 'class_absent' WHEN min(support) < 5 THEN 'support_below_5' WHEN min(support) < 400 THEN 'support_below_400' ELSE 'ok' END AS flag FROM cl GROUP BY 1")
def m15(spark, d):
    return M.support_flags(classes(spark, d), ["course_id"]).drop("absent_classes")


@query("m16_rule_baseline", f"WITH {PREDICTIONS} SELECT y_true, guess, count(*) AS n FROM (SELECT y_true, CASE WHEN coalesce(p2, 0) > 0.5 THEN 2 WHEN p1 > 0.4 THEN 1 ELSE 0 END AS guess FROM pred) GROUP BY 1, 2")
def m16(spark, d):
    x = predictions(spark, d).withColumn("guess", F.when(F.coalesce("p2", F.lit(0.0)) > 0.5, 2).when(F.col("p1") > 0.4, 1).otherwise(0))
    return M.confusion(x, [], "y_true", "guess")


@query(
    "r1_slice_metrics",
    f"""WITH {PREDICTIONS}, sl AS (SELECT *, unnest(['ALL', CASE WHEN strict = 1 THEN 'STRICT' ELSE 'OVERLAP' END]) AS slice FROM pred) SELECT slice, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM sl GROUP BY 1""",
)
def r1(spark, d):
    return rounded(R.slice_metrics(predictions(spark, d), strict_slice(), []).select("slice", "accuracy"))


@query(
    "r2_slice_partition",
    f"WITH {PREDICTIONS} SELECT y_true, y_pred, count(*) AS n_all, count(*) FILTER (WHERE doc_id % 13 > 0) AS n_parts, count(*) FILTER (WHERE doc_id % 13 = 0) = 0 AS matches FROM pred GROUP BY 1, 2",
)
def r2(spark, d):
    """Some rows are in neither part, so some cells do not add up."""
    part = F.when(F.col("doc_id") % 13 == 0, "LOST").otherwise(strict_slice())
    return R.slice_partition(predictions(spark, d), part, ["STRICT", "OVERLAP"])


@query("r3_hash_join", f"WITH {PREDICTIONS} SELECT sha256('salt|' || doc_id) AS id_hash, doc_id, y_pred FROM pred")
def r3(spark, d):
    x = predictions(spark, d)
    stored = x.select(R.hashed_id(F.col("doc_id"), "salt").alias("id_hash"), "y_pred")
    return R.hash_join(stored, x.select("doc_id"), "id_hash", "doc_id", "salt")


@query("r4_cohort_metrics", f"WITH {PREDICTIONS}, c AS (SELECT *, CASE WHEN offering_id IN (SELECT offering_id FROM pred WHERE y_true = 2) THEN 'SEEN' ELSE 'UNSEEN' END AS cohort FROM pred) SELECT cohort, strict, count(*) AS n, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM c GROUP BY 1, 2")
def r4(spark, d):
    from ..operators.quality import cohort_flag

    x = predictions(spark, d)
    out = cohort_flag(x, x.where("y_true = 2"), "offering_id")
    return rounded(out.groupBy("cohort", "strict").agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy")))


@query("r5_stratified_ci")
def r5(spark, d):
    return R.stratified_ci(M.confusion(predictions(spark, d), ["course_id"]), ["course_id"], 3, 2000, 42)


@query("r6_paired_delta")
def r6(spark, d):
    x = predictions(spark, d)
    other = F.when(F.col("p2") > 0.5, 2).when(F.col("p1") > 0.4, 1).otherwise(0)
    return R.paired_delta(x.select("y_true", F.col("y_pred").alias("a"), other.alias("b")), 3, 2000, 42)


@query("r6_paired_delta_by_cluster")
def r6_cluster(spark, d):
    other = F.when(F.col("p2") > 0.5, 2).when(F.col("p1") > 0.4, 1).otherwise(0)
    return R.paired_delta_by_cluster(predictions(spark, d).select("offering_id", "y_true", F.col("y_pred").alias("a"), other.alias("b")), "offering_id", 3, 500, 42)


@query("r7_cluster_ci")
def r7(spark, d):
    return R.cluster_ci(predictions(spark, d), "offering_id", 3, 500, 42)


@query(
    "r7_cluster_support",
    f"""WITH {PREDICTIONS}, g AS (SELECT y_true, offering_id, count(*) AS n, count(*) FILTER (WHERE y_pred = y_true) AS hit FROM pred WHERE y_true < 2 OR offering_id = 'src1' GROUP BY 1, 2),
    c AS (SELECT y_true, CAST(sum(n) AS BIGINT) AS support, count(*) AS clusters, sum(hit) / sum(n) AS recall FROM g GROUP BY 1)
    SELECT k AS class_id, coalesce(support, 0) AS support, coalesce(clusters, 0) AS clusters, round(recall, 6) AS recall, CASE WHEN clusters > 1 THEN 'estimated' WHEN clusters = 1 THEN 'single_cluster' ELSE 'class_absent' END AS status FROM (VALUES (0), (1), (2), (3)) AS ks(k) LEFT JOIN c ON y_true = k""",
)
def r7_support(spark, d):
    """Class 2 in one cluster only, and a fourth class that no row has."""
    x = predictions(spark, d).where("y_true < 2 or offering_id = 'src1'")
    return rounded(R.cluster_support(x, "offering_id", 4))


@query(
    "r8_compare_runs",
    f"""WITH {PREDICTIONS} SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 17 = 0 AND y_true <> 2) AS label_changes, count(*) FILTER (WHERE doc_id % 10 = 0 AND y_pred <> 1) AS prediction_changes,
      round(max(greatest(doc_id % 4 / 8.0, abs(p1 - p2))), 6) AS max_gap FROM (SELECT doc_id, y_true, y_pred, p1, CASE WHEN doc_id % 19 = 0 THEN p1 * 0.5 ELSE p1 END AS p2 FROM pred) AS x WHERE doc_id % 23 > 0""",
)
def r8(spark, d):
    """Against a run that lacks some rows and has other labels, guesses and probabilities in others."""
    a = predictions(spark, d)
    b = a.where("doc_id % 23 > 0").withColumn("y_true", F.when(F.col("doc_id") % 17 == 0, 2).otherwise(F.col("y_true"))).withColumn("y_pred", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(F.col("y_pred")))
    b = b.withColumn("p0", F.col("p0") + F.col("doc_id") % 4 / 8.0).withColumn("p1", F.when(F.col("doc_id") % 19 == 0, F.col("p1") * 0.5).otherwise(F.col("p1")))
    return rounded(R.compare_runs(a, b, "doc_id", ["p0", "p1", "p2"]))


@query("r9_flag_cells", f"WITH {PREDICTIONS}, a AS (SELECT course_id, y_pred AS k, count(*) AS n FROM pred WHERE y_pred < 2 GROUP BY 1, 2), b AS (SELECT course_id, y_true AS k, count(*) AS support FROM pred WHERE y_true > 0 GROUP BY 1, 2) SELECT course_id, k, n, support, CASE WHEN support IS NULL THEN 'facts_only' WHEN n IS NULL THEN 'support_only' ELSE 'both' END AS found FROM a FULL JOIN b USING (course_id, k)")
def r9(spark, d):
    x = predictions(spark, d)
    a = x.where("y_pred < 2").groupBy("course_id", F.col("y_pred").alias("k")).agg(F.count("*").alias("n"))
    return R.flag_cells(a, x.where("y_true > 0").groupBy("course_id", F.col("y_true").alias("k")).agg(F.count("*").alias("support")), ["course_id", "k"])


#: Facts of the next queries: mean price by order month (phase P1..P4 by quarter), priority and status.
FACTS = "fa AS (SELECT 'W' || (year(o_orderdate) - 1994) AS window_id, 'P' || quarter(o_orderdate) AS phase, o_orderstatus AS pipeline, round(avg(o_totalprice), 4) AS score, count(*) AS n FROM orders GROUP BY 1, 2, 3)"


def facts(spark, d):
    x = read_table(spark, d, "orders")
    keys = [F.concat(F.lit("W"), F.year("o_orderdate") - 1994).alias("window_id"), F.concat(F.lit("P"), F.quarter("o_orderdate")).alias("phase"), F.col("o_orderstatus").alias("pipeline")]
    return x.groupBy(*keys).agg(F.round(F.avg("o_totalprice"), 4).alias("score"), F.count("*").alias("n"))


KEYS = ["window_id", "phase", "pipeline"]


@query("x1_merge_facts", f"WITH {FACTS}, a AS (SELECT * FROM fa WHERE pipeline <> 'P'), b AS (SELECT window_id, phase, pipeline, n AS m FROM fa WHERE pipeline <> 'F') SELECT coverage, count(*) AS cells FROM (SELECT CASE WHEN m IS NULL THEN 'left_only' WHEN score IS NULL THEN 'right_only' ELSE 'both' END AS coverage FROM a FULL JOIN b USING (window_id, phase, pipeline)) GROUP BY 1")
def x1(spark, d):
    f = facts(spark, d)
    return X.merge_facts(f.where("pipeline <> 'P'"), f.where("pipeline <> 'F'").select(*KEYS, F.col("n").alias("m")), KEYS).groupBy("coverage").agg(F.count("*").alias("cells"))


@query("x2_window_phase_table", f"WITH {FACTS} SELECT pipeline, window_id, " + ", ".join(f"max(score) FILTER (WHERE phase = 'P{k}') AS P{k}" for k in (1, 2, 3, 4)) + " FROM fa GROUP BY 1, 2")
def x2(spark, d):
    return X.wide_table(facts(spark, d), ["pipeline", "window_id"], F.col("phase"), ["P1", "P2", "P3", "P4"], "score")


@query("x3_group_summary", f"WITH {FACTS} SELECT pipeline, count(*) AS runs, round(avg(score), 4) AS score FROM fa GROUP BY 1")
def x3(spark, d):
    return rounded(X.group_summary(facts(spark, d), ["pipeline"], ["score"]), 4)


@query("x4_phase_trend", f"WITH {FACTS} SELECT pipeline, window_id, round(max(score) FILTER (WHERE phase = 'P4') - max(score) FILTER (WHERE phase = 'P1'), 4) AS trend FROM fa GROUP BY 1, 2")
def x4(spark, d):
    return rounded(X.phase_trend(facts(spark, d), ["pipeline", "window_id"], "phase", "score", "P1", "P4").select("pipeline", "window_id", "trend"), 4)


@query("x5_resource_summary", f"WITH {FACTS} SELECT pipeline, round(avg(n), 4) AS mean, CAST(sum(n) AS BIGINT) AS total, min(n) AS low, max(n) AS high, string_agg(DISTINCT phase, '|' ORDER BY phase) AS names FROM fa GROUP BY 1")
def x5(spark, d):
    return rounded(X.resource_summary(facts(spark, d), ["pipeline"], "n", "phase"), 4)


@query("x6_grid_coverage", f"WITH {FACTS} SELECT w AS window_id, p AS phase FROM (SELECT 'W' || unnest(range(1, 9)) AS w), (SELECT 'P' || unnest(range(1, 5)) AS p) WHERE (w, p) NOT IN (SELECT (window_id, phase) FROM fa)")
def x6(spark, d):
    return X.grid_coverage(facts(spark, d), {"window_id": [f"W{k}" for k in range(1, 9)], "phase": [f"P{k}" for k in range(1, 5)]})


@query("x7_combine_facts", f"WITH {FACTS} SELECT window_id, phase, pipeline, score, CASE WHEN pipeline = 'P' THEN n END AS extra FROM fa")
def x7(spark, d):
    f = facts(spark, d)
    return X.combine_facts(f.where("pipeline <> 'P'").drop("n"), f.where("pipeline = 'P'").withColumnRenamed("n", "extra"), KEYS)


@query("x8_acceptance", f"WITH {FACTS} SELECT 'positive' AS rule, count(*) FILTER (WHERE score > 0) AS passing, count(*) AS n, count(*) FILTER (WHERE score > 0) = count(*) AS accepted FROM fa UNION ALL SELECT 'large', count(*) FILTER (WHERE n >= 150), count(*), count(*) FILTER (WHERE n >= 150) = count(*) FROM fa")
def x8(spark, d):
    return X.acceptance(facts(spark, d), {"positive": F.col("score") > 0, "large": F.col("n") >= 150})


@query("x9_sequences", f"WITH {FACTS} SELECT pipeline, window_id, count(*) AS steps, CAST(count(*) FILTER (WHERE n > 160) AS INTEGER) AS observed_length FROM fa GROUP BY 1, 2")
def x9(spark, d):
    long = facts(spark, d).withColumn("score", F.when(F.col("n") > 160, F.col("score")))
    out = X.assemble_sequences(long, ["pipeline", "window_id"], "phase", ["score"])
    return out.select("pipeline", "window_id", F.size("steps").cast("long").alias("steps"), "observed_length")


@query("x10_channel_pca")
def x10(spark, d):
    parts, shares = X.channel_pca(read_table(spark, d, "embeddings"), "embedding", 4)
    return spark.createDataFrame([(i, round(float(s), 6), int(abs(p).argmax())) for i, (p, s) in enumerate(zip(parts, shares, strict=True))], "component int, explained double, main_channel int")


@query("x11_parent_delta", f"WITH {FACTS} SELECT c.window_id, c.phase, c.pipeline, round(c.score - p.score, 4) AS delta FROM fa c JOIN fa p ON p.pipeline = 'F' AND p.window_id = c.window_id AND p.phase = c.phase")
def x11(spark, d):
    f = facts(spark, d).withColumn("parent", F.lit("F"))
    return rounded(X.parent_delta(f, "pipeline", "parent", ["window_id", "phase"], "score").select(*KEYS, "delta"), 4)


@query(
    "x12_selection_facts",
    f"WITH {FACTS}, h AS (SELECT pipeline, window_id, CAST(substr(phase, 2) AS INTEGER) AS step, score FROM fa), r AS (SELECT *, row_number() OVER (PARTITION BY pipeline, window_id ORDER BY score DESC, step) AS k, max(score) OVER (PARTITION BY pipeline, window_id) AS top FROM h) SELECT pipeline || window_id AS run, max(step) FILTER (WHERE k = 1) AS best_step, max(score) FILTER (WHERE k = 1) AS best, round(max(top) - max(score) FILTER (WHERE k = 2), 4) AS margin, count(*) FILTER (WHERE score >= top - 5000) AS \"within\" FROM r GROUP BY 1",
)
def x12(spark, d):
    h = facts(spark, d).select(F.concat("pipeline", "window_id").alias("run"), F.substring("phase", 2, 1).cast("int").alias("step"), "score")
    return rounded(X.selection_facts(h, "run", "step", "score", 5000.0).select("run", "best_step", "best", "margin", "within"), 4)


@query("x13_overlay_reference", f"WITH {FACTS} SELECT window_id, phase, pipeline, CASE WHEN pipeline = 'P' THEN 1.0 ELSE score END AS score, score AS score_refit FROM fa")
def x13(spark, d):
    f = facts(spark, d)
    ref = f.where("pipeline = 'P'").select(*KEYS, F.lit(1.0).alias("score"))
    return X.overlay_reference(f, ref, KEYS, "score").select(*KEYS, "score", "score_refit")


@query(
    "x14_recompute_slices",
    f"WITH {PREDICTIONS}, p AS (SELECT course_id, avg((y_true = y_pred)::INT) AS parent FROM pred GROUP BY 1) SELECT course_id, CAST(strict AS INTEGER) AS strict, round(any_value(parent), 6) AS parent, round(avg((y_true = y_pred)::INT), 6) AS recomputed FROM pred JOIN p USING (course_id) GROUP BY 1, 2",
)
def x14(spark, d):
    """Accuracy of each slice from the cells of the confusion matrix, beside that of all rows."""
    x = predictions(spark, d)
    parent = M.overall(classes(spark, d), ["course_id"]).select("course_id", F.col("accuracy").alias("parent"))
    cells = M.confusion(x, ["course_id", "strict"])
    again = cells.groupBy("course_id", "strict").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recomputed"))
    return rounded(parent.join(again, "course_id"))


@query(
    "x15_reconcile_totals",
    "SELECT o_orderstatus, count(*) AS left_total, count(*) FILTER (WHERE o_orderkey % 50 > 0 OR o_orderstatus <> 'F') AS right_total, count(*) FILTER (WHERE o_orderkey % 50 = 0 AND o_orderstatus = 'F') = 0 AS equal FROM orders GROUP BY 1",
)
def x15(spark, d):
    """One status has lost some rows on the way to its parts."""
    a = read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("t"))
    parts = read_table(spark, d, "orders").where("o_orderkey % 50 > 0 or o_orderstatus <> 'F'").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("t"))
    return X.reconcile_totals(a, parts.groupBy("o_orderstatus").agg(F.sum("t").alias("t")), ["o_orderstatus"], "t")


@query("x16_uniformity", """SELECT 'r' AS "column", count(DISTINCT l_returnflag) AS distinct_values, count(DISTINCT l_returnflag) = 1 AS uniform FROM lineitem""")
def x16(spark, d):
    return X.uniformity(read_table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "r"), ["r"])


def vectors(spark, d):
    """All embeddings; the rare class are those of label 0 whose first component is positive, with two masks from the vector."""
    rare = (F.col("label") == 0) & (F.get("embedding", F.lit(0)) > 0)
    x = read_table(spark, d, "embeddings").withColumn("topic", F.col("label")).withColumn("label", rare.cast("int"))
    return x.withColumn("available", (F.get("embedding", F.lit(1)) > 0).cast("int")).withColumn("missing__x", (F.get("embedding", F.lit(2)) > 0).cast("int"))


RARE = """v AS (SELECT vec_id, (label = 0 AND embedding[1] > 0)::INT AS label FROM embeddings), c AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
  tg AS (SELECT label, n, CAST(least(greatest(n, ceil(max(n) OVER () / 10)), n * 10) AS BIGINT) AS target, ceil(max(n) OVER () / 10) > n * 10 AS cap_bound FROM c)"""


@query("b1_sampling_targets", f"WITH {RARE} SELECT label, n, target, cap_bound FROM tg")
def b1(spark, d):
    return B.sampling_targets(vectors(spark, d), "label").select("label", "n", F.col("target").cast("long").alias("target"), "cap_bound")


@query(
    "b2_largest_remainder",
    "WITH c AS (SELECT p_type, p_brand, count(*) AS w, 1000 AS total FROM part GROUP BY 1, 2), e AS (SELECT *, total * w / sum(w) OVER (PARTITION BY p_type) AS x FROM c), f AS (SELECT *, floor(x) AS q, row_number() OVER (PARTITION BY p_type ORDER BY x - floor(x) DESC, p_brand) AS r FROM e) SELECT p_type, p_brand, CAST(q + (r <= 1000 - sum(q) OVER (PARTITION BY p_type))::INT AS BIGINT) AS quota FROM f",
)
def b2(spark, d):
    x = read_table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("w")).withColumn("total", F.lit(1000))
    return B.largest_remainder(x, ["p_type"], "p_brand", "w", "total").select("p_type", "p_brand", "quota")


def quotas(x):
    return B.sampling_targets(x, "label").select("label", F.col("synthetic").cast("long").alias("quota"))


def _pairs(spark, d):
    """Rows of the classes that need synthetic ones, with their cluster, and parent pairs as many as each class needs."""
    x, parts = vectors(spark, d), []
    for r in quotas(x).where("quota > 0").collect():  # one row a class
        own = B.clusters(x, "embedding", "label", r["label"], 4, 7).withColumn("total", F.lit(r["quota"]))
        parts.append(own.select("vec_id", "label", "embedding", "available", "missing__x", "cluster", "total"))
    members = reduce(lambda a, b: a.unionByName(b), parts) if parts else x.withColumn("cluster", F.lit(0)).withColumn("total", F.lit(0).cast("long")).where("false")
    sizes = members.groupBy("label", "cluster").agg(F.count("*").alias("w"), F.max("total").alias("total")).where("w > 1")
    each = B.largest_remainder(sizes, ["label"], "cluster", "w", "total").select("label", "cluster", "quota")
    return members, B.interpolated_pairs(members, each, ["label", "cluster"], "vec_id", 11)


@query("b3_cluster_oversampling", f"WITH {RARE} SELECT label, target - n AS n, CAST(0 AS BIGINT) AS self_pairs FROM tg WHERE target > n")
def b3(spark, d):
    _, pairs = _pairs(spark, d)
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("self_pairs"))


RADIUS = 1.1
NEAR = """p AS (SELECT a.vec_id AS id, b.vec_id AS nb, list_sum(list_transform(range(1, {0}), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i], 2))) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS k FROM p)"""


@query("b4_radius_neighbours", f"WITH {NEAR.format(65)} SELECT id, CAST(greatest(count(*) FILTER (WHERE dist <= {RADIUS} * {RADIUS}), 1) AS BIGINT) AS n, count(*) FILTER (WHERE dist <= {RADIUS} * {RADIUS}) = 0 AS fallback FROM r GROUP BY id")
def b4(spark, d):
    """All rows within the radius, counted, or the nearest one (fallback)."""
    index = N.cells(read_table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return N.radius_degrees(index, RADIUS).select("id", F.greatest("n", F.lit(1)).alias("n"), (F.col("n") == 0).alias("fallback"))


def unit_sql(*parts):
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 8))::BIGINT / 4294967296.0"


def mixed_sql(x):
    """The hash of ``neighbours.mixed``; fixed values as there."""
    once = f"((xor({x}, {x} >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return f"(((xor({once}, {once} >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT) >> 1)"


#: Pairs drawn within the radius: first parents by digest, second ones by the smallest hash of draw and neighbour.
PAIRS = f"""{RARE}, dr AS (SELECT label, n, unnest(range(1, target - n + 1)) AS nth FROM tg WHERE n > 1), rw AS (SELECT label, vec_id AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM v),
  pa AS (SELECT dr.label, nth, a, {unit_sql(15, "nth", "dr.label")} AS ratio FROM dr JOIN rw ON rw.label = dr.label AND i = floor({unit_sql(13, "nth", "dr.label")} * n)),
  pd AS (SELECT x.vec_id AS id, y.vec_id AS nb, list_sum(list_transform(range(1, 65), lambda i: pow(ex.embedding[i]::DOUBLE - ey.embedding[i], 2))) AS dist
    FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id JOIN embeddings ex ON ex.vec_id = x.vec_id JOIN embeddings ey ON ey.vec_id = y.vec_id WHERE x.label IN (SELECT label FROM tg WHERE target > n)),
  ca AS (SELECT pa.*, nb, dist, dist <= {RADIUS} * {RADIUS} AS inside, {mixed_sql("nb::UHUGEINT")} AS h1, {mixed_sql("(nth + 13)::UHUGEINT")} AS h2 FROM pa JOIN pd ON id = a),
  cb AS (SELECT *, {mixed_sql("xor(h1, h2)")} AS h FROM ca),
  pr AS (SELECT label, nth, a, ratio, nb AS b, NOT inside AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY label, nth ORDER BY inside DESC, CASE WHEN inside THEN h::DOUBLE ELSE dist END, nb) AS k FROM cb) WHERE k = 1)"""


def _radius(spark, d):
    x = vectors(spark, d)
    return B.radius_pairs(x, quotas(x), "label", "vec_id", "embedding", RADIUS, 13)


@query("b4_radius_interpolation", f"WITH {PAIRS} SELECT label, nth, a, b, round(ratio, 6) AS ratio, fallback FROM pr")
def b4_rows(spark, d):
    return rounded(_radius(spark, d))


@query(
    "b5_visible_neighbours",
    f"""WITH {NEAR.format(4)}, k8 AS (SELECT id, nb AS neighbour, k AS rank FROM r WHERE k <= 8), w AS (SELECT id, neighbour, rank, list_transform(o.embedding, lambda e: e::DOUBLE) AS x, list_transform(n.embedding, lambda e: e::DOUBLE) AS y FROM k8 JOIN embeddings o ON o.vec_id = id JOIN embeddings n ON n.vec_id = neighbour),
    h AS (SELECT a.id, a.neighbour, a.rank, min(list_sum(list_transform(range(1, 4), lambda i: (a.x[i] - z.y[i]) * (a.y[i] - z.y[i])))) >= -1e-6 AS seen FROM w a JOIN w z ON z.id = a.id GROUP BY 1, 2, 3),
    f AS (SELECT *, NOT bool_or(seen) OVER (PARTITION BY id) AS fallback FROM h)
    SELECT id, neighbour, CAST(rank AS INTEGER) AS rank, fallback FROM f WHERE seen OR (fallback AND rank = 1)""",
)
def b5(spark, d):
    """In the first three components; in all 64, hardly any row hides another."""
    x = read_table(spark, d, "embeddings").withColumn("embedding", F.slice("embedding", 1, 3))
    near = N.k_nearest(N.cells(x, "vec_id", "embedding", "label"), 8)
    return Z.visible(near, x, "vec_id", "embedding").select("id", "neighbour", "rank", "fallback")


@query("b6_accepted_candidates", f"WITH {RARE}, t AS (SELECT sum(n) AS total FROM tg) SELECT label, target - n AS quota, CAST(ceil((total - n) / n) AS BIGINT) AS inspectors_wanted, CAST(least(ceil((total - n) / n), 4) AS INTEGER) AS inspectors, target - n AS accepted, true AS met FROM tg, t WHERE target > n AND n > 1")
def b6(spark, d):
    """Facts of the rounds of a class: the quota, inspectors, and accepted rows, counted in the rows themselves."""
    x = vectors(spark, d)
    rows, facts = Z.inspected_rows(x, quotas(x), "label", "vec_id", "embedding", 21)
    counted = rows.groupBy("label").agg(F.count_distinct("synthetic_id").alias("accepted"))
    return facts.drop("accepted").join(counted, "label").select("label", "quota", "inspectors_wanted", "inspectors", "accepted", "met")


@query(
    "b7_synthetic_rows",
    f"""WITH {PAIRS} SELECT sha256(concat_ws('|', '13', a, b, nth)) AS synthetic_id, pr.label, a, b, fallback, ((ea.embedding[2] > 0) AND (eb.embedding[2] > 0))::INT AS available, ((ea.embedding[3] > 0) OR (eb.embedding[3] > 0))::INT AS missing__x,
      round(list_sum(list_transform(range(1, 65), lambda i: i * (ea.embedding[i]::DOUBLE + (eb.embedding[i]::DOUBLE - ea.embedding[i]) * ratio))), 4) AS weighted FROM pr JOIN embeddings ea ON ea.vec_id = a JOIN embeddings eb ON eb.vec_id = b""",
)
def b7(spark, d):
    """Synthetic rows: name, parents, masks (available in both, missing in one) and the vector's components, weighted by place."""
    return rounded(made_rows(spark, d).select("synthetic_id", "label", "a", "b", "fallback", "available", "missing__x", F.expr("aggregate(transform(embedding, (e, i) -> (i + 1) * e), 0D, (s, e) -> s + e)").alias("weighted")), 4)


def made_rows(spark, d):
    x = vectors(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return B.materialize(_radius(spark, d), x, "vec_id", "embedding", ["label"], 13, ("available",), ("missing__x",))


@query(
    "b9_sampling_summary",
    f"""WITH {PAIRS}, g AS (SELECT label, count(*) AS added, avg(fallback::INT) AS rate FROM pr GROUP BY 1)
    SELECT label, n, target, coalesce(added, 0) AS added, cap_bound, coalesce(added, 0) = target - n AS target_met, round((n + coalesce(added, 0)) / n, 6) AS expansion, round(coalesce(rate, 0), 6) AS fallback_rate, coalesce(rate, 0) > 0.5 AS radius_warning FROM tg LEFT JOIN g USING (label)""",
)
def b9(spark, d):
    out = B.sampling_summary(vectors(spark, d), _radius(spark, d), "label")
    return rounded(out.select("label", "n", F.col("target").cast("long").alias("target"), "added", "cap_bound", "target_met", "expansion", "fallback_rate", "radius_warning"))


#: Real and synthetic rows with columns of their vectors: two phases, a count, a mask for the second phase and one for missing values.
PARTS = {"x_P1": 0, "x_P2": 1, "n_count": 2}


def real_columns(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x = vectors(spark, d).withColumn("phase_available_P2", (at(3) > -0.05).cast("int"))
    values = F.array(at(0), F.when(F.col("phase_available_P2") == 1, at(1)).otherwise(0.0), F.rint(at(2) * 20))
    return x.select("vec_id", "label", "phase_available_P2", "missing__x", values.alias("embedding"))


def spread_columns(df):
    return df.select("*", *(F.get("embedding", F.lit(i)).alias(c) for c, i in PARTS.items()))


#: The pairs as rows: every 5th draw takes its first mask from the first parent alone, a fault to be found.
MADE = f"""{PAIRS}, rc AS (SELECT vec_id, label, (e[4] > -0.05)::INT AS av, (e[3] > 0)::INT AS mi, e[1]::DOUBLE AS x_P1, CASE WHEN e[4] > -0.05 THEN e[2]::DOUBLE ELSE 0 END AS x_P2, round_even(e[3]::DOUBLE * 20, 0) AS n_count
    FROM (SELECT embeddings.vec_id, v.label, embedding AS e FROM embeddings JOIN v USING (vec_id))),
  mk AS (SELECT pr.label, nth, a.av AS av_a, b.av AS av_b, a.mi AS mi_a, b.mi AS mi_b, CASE WHEN nth % 5 = 0 THEN a.av ELSE least(a.av, b.av) END AS av, greatest(a.mi, b.mi) AS mi, {", ".join(f"a.{c} + (b.{c} - a.{c}) * ratio AS {c}" for c in PARTS)} FROM pr JOIN rc a ON a.vec_id = pr.a JOIN rc b ON b.vec_id = pr.b)"""
FIDELITY = f"""{MADE}, lr AS ({" UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c} AS v FROM rc" for c in PARTS)}), lm AS ({" UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c} AS v FROM mk" for c in PARTS)}),
  qr AS (SELECT label, feature, quantile_cont(v, list_transform(range(101), lambda i: i / 100)) AS q, count(*) AS n, stddev_pop(v) AS sd FROM lr GROUP BY 1, 2), qm AS (SELECT label, feature, quantile_cont(v, list_transform(range(101), lambda i: i / 100)) AS q, count(*) AS n FROM lm GROUP BY 1, 2),
  bk AS (SELECT qr.label, qr.feature, qr.n AS n_real, qm.n AS n_made, qr.q AS r, qm.q AS m, sd, list_sort(list_distinct(list_transform(range(0, 101, 5), lambda i: qr.q[i + 1]))) AS e FROM qr JOIN qm USING (label, feature)),
  hs AS (SELECT side, bk.label, bk.feature, v, CASE WHEN v >= e[1] AND v <= e[len(e)] THEN least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) END AS bin, v < e[1] - 1e-6 OR v > e[len(e)] + 1e-6 AS far FROM (SELECT 'r' AS side, * FROM lr UNION ALL SELECT 'm', * FROM lm) x JOIN bk USING (label, feature)),
  hc AS (SELECT bk.label, bk.feature, b, count(*) FILTER (WHERE side = 'r' AND bin = b) + 1e-12 AS p, count(*) FILTER (WHERE side = 'm' AND bin = b) + 1e-12 AS s FROM (SELECT *, unnest(range(1, len(e))) AS b FROM bk) bk LEFT JOIN hs USING (label, feature) GROUP BY 1, 2, 3),
  hp AS (SELECT label, feature, p / sum(p) OVER w AS p, s / sum(s) OVER w AS s FROM hc WINDOW w AS (PARTITION BY label, feature)), js AS (SELECT label, feature, sum(p * log2(2 * p / (p + s)) + s * log2(2 * s / (p + s))) / 2 AS jsd FROM hp GROUP BY 1, 2),
  fo AS (SELECT label, feature, count(*) FILTER (WHERE far AND side = 'm') AS outside FROM hs GROUP BY 1, 2),
  fi AS (SELECT label, feature, n_real, n_made, coalesce(jsd, 0) AS jsd, list_sum(list_transform(range(1, 102), lambda i: abs(r[i] - m[i]))) / 101 / greatest(CASE WHEN r[76] - r[26] > 1e-12 THEN r[76] - r[26] ELSE sd END, 1e-12) AS distance, outside FROM bk LEFT JOIN js USING (label, feature) LEFT JOIN fo USING (label, feature))"""


def made_columns(spark, d):
    pairs = _radius(spark, d)
    made = spread_columns(B.materialize(pairs, real_columns(spark, d), "vec_id", "embedding", ["label"], 13, ("phase_available_P2",), ("missing__x",)))
    own = real_columns(spark, d).select(F.col("vec_id").alias("a"), F.col("phase_available_P2").alias("own"))
    return made.join(own, "a").withColumn("phase_available_P2", F.when(F.col("nth") % 5 == 0, F.col("own")).otherwise(F.col("phase_available_P2"))).drop("own")


@query("d20_synthetic_fidelity", f"WITH {FIDELITY} SELECT label, feature, n_real, n_made, round(jsd, 6) AS jsd, round(distance, 6) AS distance, outside FROM fi")
def d20_fidelity(spark, d):
    return rounded(D.synthetic_fidelity(spread_columns(real_columns(spark, d)), made_columns(spark, d), "label", list(PARTS)))


@query(
    "d20_synthetic_quality",
    f"""WITH {FIDELITY}, s AS (SELECT avg(jsd) AS jsd_mean, max(jsd) AS jsd_max, avg(distance) AS distance_mean, max(distance) AS distance_max, sum(outside) / sum(n_made) AS outside_rate FROM fi)
    SELECT (SELECT count(*) FROM mk) AS n, {", ".join(f"(SELECT round({c}, 6) FROM s) AS {c}" for c in ("jsd_mean", "jsd_max", "distance_mean", "distance_max", "outside_rate"))}, round(avg((abs(n_count - round_even(n_count, 0)) > 1e-6)::INT), 6) AS non_integer_rate,
      round((count(*) FILTER (WHERE av <> least(av_a, av_b)) + count(*) FILTER (WHERE mi <> greatest(mi_a, mi_b))) / (2 * count(*)), 6) AS invalid_mask_rate, round(1 / 3, 6) AS cross_phase_rate,
      round(coalesce(count(*) FILTER (WHERE av = 0 AND abs(x_P2) > 1e-6) / nullif(count(*) FILTER (WHERE av = 0), 0), 0), 6) AS unavailable_nonzero_rate, count(*) FILTER (WHERE av = 0 AND abs(x_P2) > 1e-6) AS unavailable_nonzero_cells FROM mk""",
)
def d20(spark, d):
    """Of rows made as if for phase 1, so that a column of phase 2 crosses."""
    real, made = spread_columns(real_columns(spark, d)), made_columns(spark, d)
    return rounded(D.synthetic_quality(real, made, "label", "vec_id", list(PARTS), ["n_count"], ["phase_available_P2"], ["missing__x"], {"x_P2": "phase_available_P2"}, ("_P2",)))
