"""Classification, calibration and sanity metrics over prediction rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import quantiles, running_total

EPS = 1e-12
CLASSES = (0, 1, 2)
PROBS = ("p0", "p1", "p2")


def normalise_probs(df: DataFrame, probs=PROBS) -> DataFrame:
    """Clipped and renormalised probabilities with their argmax (the first of equal ones)."""
    clipped = {p: F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS)) for p in probs}
    out = df.withColumn("__t", reduce(lambda a, b: a + b, clipped.values()))
    out = out.withColumns({p: c / F.col("__t") for p, c in clipped.items()}).drop("__t")
    values = F.array(*(F.col(p) for p in probs))
    return out.withColumn("argmax", (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def confusion(df: DataFrame, keys: list[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return df.groupBy(*keys, truth, guess).agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame, keys: list[str], classes=CLASSES, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Support, precision, recall, specificity, F1 and G-mean of every class; null for a class without support."""
    sums = cm.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        *(F.sum(F.when((F.col(truth) == c) & (F.col(guess) == c), F.col("n")).otherwise(0)).alias(f"tp{c}") for c in classes),
        *(F.sum(F.when(F.col(truth) == c, F.col("n")).otherwise(0)).alias(f"s{c}") for c in classes),
        *(F.sum(F.when(F.col(guess) == c, F.col("n")).otherwise(0)).alias(f"g{c}") for c in classes),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("class_id"), F.col(f"tp{c}").alias("tp"), F.col(f"s{c}").alias("support"), F.col(f"g{c}").alias("predicted")) for c in classes))
    x = sums.select(*keys, "total", F.explode(rows).alias("x")).select(*keys, "total", "x.*")
    tn = F.col("total") - F.col("support") - F.col("predicted") + F.col("tp")
    known = lambda c: F.when(F.col("support") > 0, c)
    x = x.withColumn("precision", known(F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)))).withColumn("recall", known(F.try_divide("tp", "support")))
    x = x.withColumn("specificity", known(F.try_divide(tn, F.col("total") - F.col("support"))))
    x = x.withColumn("f1", known(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")))).withColumn("gmean", F.sqrt(F.col("recall") * F.col("specificity")))
    return x


def overall(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 over present and over all classes, weighted F1, G-mean of recalls.

    A class without support has recall 0 in balanced accuracy and G-mean.
    """
    recall = F.coalesce("recall", F.lit(0.0))
    gmean = F.when(F.min(recall) > 0, F.exp(F.sum(F.log(recall)) / F.count(F.lit(1)))).otherwise(0.0)
    return classes.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1_present"),
        F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1_fixed"), (F.sum(F.coalesce("f1", F.lit(0.0)) * F.col("support")) / F.sum("support")).alias("weighted_f1"), gmean.alias("gmean"),
    )


def mcc_kappa(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Multi-class Matthews correlation and Cohen's kappa from per-class sums; 0 where only one class is present."""
    s = F.max("total").cast("double")
    c, pt, pp, tt = F.sum("tp"), F.sum(F.col("support").cast("double") * F.col("predicted")), F.sum(F.pow("predicted", F.lit(2.0))), F.sum(F.pow("support", F.lit(2.0)))
    x = classes.groupBy(*keys).agg(s.alias("s"), c.alias("c"), pt.alias("pt"), pp.alias("pp"), tt.alias("tt"), F.count_if(F.col("support") > 0).alias("present"))
    known = lambda c: F.when(F.col("present") > 1, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    mcc = F.try_divide(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((F.pow("s", F.lit(2.0)) - F.col("pp")) * (F.pow("s", F.lit(2.0)) - F.col("tt"))))
    kappa = F.try_divide(F.col("c") * F.col("s") - F.col("pt"), F.pow("s", F.lit(2.0)) - F.col("pt"))
    return x.select(*keys, known(mcc).alias("mcc"), known(kappa).alias("kappa"))


def one_vs_rest(df: DataFrame, keys: list[str], classes=CLASSES, probs=PROBS, truth: str = "y_true") -> DataFrame:
    """Per key, class and distinct score: rows and positives. Ranks below run over these, not over rows."""
    long = df.select(*keys, truth, F.explode(F.array(*(F.struct(F.lit(c).alias("class_id"), F.col(p).alias("score")) for c, p in zip(classes, probs, strict=True)))).alias("x"))
    hit = (F.col(truth) == F.col("x.class_id")).cast("long")
    return long.groupBy(*keys, "x.class_id", "x.score").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("pos"))


def ranked_scores(scores: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """Totals of ``values`` up to each score inside its key and class, as ``upto_<value>``; no task holds a whole key."""
    own = [*keys, "class_id"]
    x = running_total(scores, [*map(F.col, own), order], values, [f"__{v}" for v in values])
    base = x.groupBy(*own).agg(*(F.min(F.col(f"__{v}") - F.col(v)).alias(f"__{v}0") for v in values))
    x = x.join(F.broadcast(base), own)  # a row for each class of each key
    return x.withColumns({f"upto_{v}": F.col(f"__{v}") - F.col(f"__{v}0") for v in values})


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision per class; ties count at once. Null without positives."""
    x = ranked_scores(scores, keys, F.desc("score"), ["pos", "n"])
    return x.groupBy(*keys, "class_id").agg(F.try_divide(F.sum(F.col("pos") * F.col("upto_pos") / F.col("upto_n")), F.sum("pos")).alias("ap"))


def roc_auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUC per class with ties at one half; null where a side is empty."""
    x = ranked_scores(scores.withColumn("neg", F.col("n") - F.col("pos")), keys, F.asc("score"), ["neg"])
    wins = F.sum(F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    return x.groupBy(*keys, "class_id").agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def losses(df: DataFrame, keys: list[str], classes=CLASSES, probs=PROBS, truth: str = "y_true") -> DataFrame:
    own = F.coalesce(*(F.when(F.col(truth) == c, F.col(p)) for c, p in zip(classes, probs, strict=True)))
    brier = reduce(lambda a, b: a + b, [F.pow(F.col(p) - (F.col(truth) == c).cast("int"), F.lit(2.0)) for c, p in zip(classes, probs, strict=True)])
    return df.groupBy(*keys).agg(F.avg(-F.log(F.greatest(own, F.lit(EPS)))).alias("log_loss"), F.avg(brier).alias("brier"))


def ece(df: DataFrame, keys: list[str], probs=PROBS, bins: int = 15, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    conf = F.greatest(*(F.col(p) for p in probs))
    x = df.select(*keys, conf.alias("conf"), (F.col(truth) == F.col(guess)).cast("int").alias("hit"), F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"))
    each = x.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("hit") - F.avg("conf")).alias("gap"))
    return each.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def entropy(probs=PROBS) -> Column:
    """Normalised entropy of a row's probabilities."""
    return -reduce(lambda a, b: a + b, [F.when(F.col(p) > 0, F.col(p) * F.log(p)).otherwise(0.0) for p in probs]) / F.log(F.lit(float(len(probs))))


def geometric(components: list[Column], floor: float = 1e-3) -> Column:
    """Geometric mean with a floor; null if a component is."""
    return F.exp(reduce(lambda a, b: a + b, [F.log(F.greatest(c, F.lit(floor))) for c in components]) / len(components))


def smoothed_jsd(left: list[Column], right: list[Column]) -> Column:
    """Base-2 divergence of two count vectors, each count raised by ``EPS``."""
    total = lambda cs: reduce(lambda a, b: a + b, [c + F.lit(EPS) for c in cs])
    p, q = ([(c + F.lit(EPS)) / total(cs) for c in cs] for cs in (left, right))
    part = lambda a, b: a * F.log2(a / ((a + b) / 2))
    return reduce(lambda a, b: a + b, [(part(a, b) + part(b, a)) / 2 for a, b in zip(p, q, strict=True)])


def composite(df: DataFrame, keys: list[str], train_counts: dict[int, int] | None = None, effective: str | None = None, leak_free: float | DataFrame | None = None, classes=CLASSES, probs=PROBS, truth: str = "y_true") -> DataFrame:
    """keys, s_perf, the six sanity parts, s_san and composite = s_perf ** 0.6 * s_san ** 0.4; parts are floored at 0.001.

    Performance: macro F1 over all classes, balanced accuracy, (mcc + 1) / 2, (kappa + 1) / 2. Sanity: finite rows that
    add up to one, predicted against true shares, median entropy near one half, predicted shares against those of
    training (``train_counts``; else the true ones), the mean of ``effective``, and a probe's ``leak_free``: a number, or
    a row a key with ``leak_free`` as of ``leak_probe`` (1 where not given or null).
    """
    finite = reduce(lambda a, b: a & b, [F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(F.col(p)) != float("inf")) for p in probs])
    fits = F.coalesce(finite & (F.abs(reduce(lambda a, b: a + b, [F.col(p) for p in probs]) - 1) <= 1e-4), F.lit(False))
    x = normalise_probs(df.withColumn("__fits", fits.cast("int")), probs)
    each = per_class(confusion(x, keys, truth, "argmax"), keys, classes, truth, "argmax")
    of = lambda column, c: F.sum(F.when(F.col("class_id") == c, F.col(column)).otherwise(0))
    guessed, true = [of("predicted", c) for c in classes], [of("support", c) for c in classes]
    reference = true if train_counts is None else [F.lit(train_counts.get(c, 0)) for c in classes]
    shares = each.groupBy(*keys).agg((1 - smoothed_jsd(guessed, true)).alias("s_majority"), (1 - smoothed_jsd(guessed, reference)).alias("s_drift"))
    middle = quantiles(x, {"e": entropy(probs)}, [0.5], keys).select(*keys, F.get("quantiles", F.lit(0)).alias("__middle"))
    rows = x.groupBy(*keys).agg(F.min("__fits").cast("double").alias("s_finite"), (F.lit(1.0) if effective is None else F.avg(effective)).alias("s_effective"))
    out = overall(each, keys).join(mcc_kappa(each, keys), keys).join(shares, keys).join(rows, keys).join(middle, keys)
    out = out.withColumn("s_entropy", 1 - F.least(F.abs(F.col("__middle") - 0.5) / 0.5, F.lit(1.0)))
    if isinstance(leak_free, DataFrame):
        out = out.join(leak_free.select(*keys, F.col("leak_free").alias("s_leak")), keys, "left").withColumn("s_leak", F.coalesce("s_leak", F.lit(1.0)))
    else:
        out = out.withColumn("s_leak", F.lit(1.0 if leak_free is None else leak_free))
    out = out.withColumn("s_perf", geometric([F.col("macro_f1_fixed"), F.col("balanced_accuracy"), (F.col("mcc") + 1) / 2, (F.col("kappa") + 1) / 2]))
    parts = ["s_finite", "s_majority", "s_entropy", "s_drift", "s_effective", "s_leak"]
    out = out.withColumn("s_san", geometric([F.least(F.col(p), F.lit(1.0)) for p in parts]))
    return out.select(*keys, "s_perf", *parts, "s_san", (F.pow("s_perf", F.lit(0.6)) * F.pow("s_san", F.lit(0.4))).alias("composite"))


def support_flags(classes: DataFrame, keys: list[str]) -> DataFrame:
    return classes.groupBy(*keys).agg(F.max("total").alias("n"), F.min("support").alias("least_support"), F.count_if(F.col("support") == 0).alias("absent_classes")).withColumn(
        "flag", F.when(F.col("n") < 30, "small_slice").when(F.col("absent_classes") > 0, "class_absent").when(F.col("least_support") < 5, "support_below_5").when(F.col("least_support") < 400, "support_below_400").otherwise("ok")
    )


def probe(train: DataFrame, evaluate: DataFrame, features: list[str], label: str, weighted: bool = False, classes=CLASSES, penalty: float = 1.0) -> DataFrame:
    """Multinomial logistic regression on few standardised columns: evaluation rows with probabilities p0.. and argmax.

    The loss is summed over training rows, ``penalty`` times half the squared weights is added; ``weighted`` rows count so
    that all classes weigh the same. Classes that training lacks get probability 0; without two of them every row gets
    the shares of training.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    counts = {r[label]: r["n"] for r in train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    known, total = sorted(counts), sum(counts.values())
    if len(known) < 2:
        return evaluate.withColumns({f"p{k}": F.lit(float(c in counts)) for k, c in enumerate(classes)}).withColumn("argmax", F.lit(known[0] if known else classes[0]).cast("int"))
    place = F.coalesce(*(F.when(F.col(label) == c, F.lit(float(k))) for k, c in enumerate(known)))
    assemble = VectorAssembler(inputCols=features, outputCol="__raw")
    rows = assemble.transform(train.withColumn("__y", place).where("__y is not null"))
    scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(rows)
    learner = LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", maxIter=500, tol=1e-8, regParam=penalty / total, standardization=False)
    rows = scaler.transform(rows)
    if weighted:
        weight = F.coalesce(*(F.when(F.col(label) == c, F.lit(total / (len(counts) * n))) for c, n in counts.items()))
        rows, learner = rows.withColumn("__w", weight), learner.setWeightCol("__w")
    model = learner.fit(rows)
    out = model.transform(scaler.transform(assemble.transform(evaluate))).withColumn("__p", vector_to_array("probability"))
    shares = {f"p{k}": F.get("__p", F.lit(known.index(c))) if c in counts else F.lit(0.0) for k, c in enumerate(classes)}
    best = F.get(F.array(*map(F.lit, known)), F.col("prediction").cast("int")).cast("int")
    return out.withColumns(shares).withColumn("argmax", best).drop("__raw", "__x", "__p", "rawPrediction", "probability", "prediction")


def leak_probe(train: DataFrame, evaluate: DataFrame, flags: list[str], label: str, keys: list[str], classes=CLASSES) -> DataFrame:
    """keys, auc, leak_free: how far missing and availability flags alone tell the classes apart, in each slice.

    A probe is fitted once on all training rows. auc: mean over classes of one against the rest; null where a slice lacks
    a class. leak_free: 1 - 2 max(auc - 0.5, 0).
    """
    probs = tuple(f"p{k}" for k in range(len(classes)))
    out = probe(train, evaluate, flags, label, classes=classes).withColumn("y_true", F.col(label)).select(*keys, "y_true", *probs)
    each = roc_auc(one_vs_rest(out, keys, classes, probs), keys)
    whole = each.groupBy(*keys).agg(F.when(F.count("auc") == len(classes), F.avg("auc")).alias("auc"))
    return whole.withColumn("leak_free", F.when(F.col("auc").isNotNull(), 1 - 2 * F.greatest(F.col("auc") - 0.5, F.lit(0.0))))


def static_probe(train: DataFrame, evaluate: DataFrame, sets: dict[str, list[str]], label: str, keys: list[str], classes=CLASSES) -> DataFrame:
    """features, arm (plain or balanced), keys, balanced_accuracy, macro_f1 (absent classes count 0), macro_f1_present: what sets of static columns tell."""
    facts = []
    for name, columns in sets.items():
        for arm in ("plain", "balanced"):
            out = probe(train, evaluate, columns, label, arm == "balanced", classes).withColumn("y_true", F.col(label))
            each = per_class(confusion(out, keys, "y_true", "argmax"), keys, classes, "y_true", "argmax")
            present = F.col("support") > 0
            facts.append(each.groupBy(*keys).agg(
                F.avg(F.coalesce("recall", F.lit(0.0))).alias("balanced_accuracy"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"), F.avg(F.when(present, F.coalesce("f1", F.lit(0.0)))).alias("macro_f1_present"),
            ).select(F.lit(name).alias("features"), F.lit(arm).alias("arm"), *keys, "balanced_accuracy", "macro_f1", "macro_f1_present"))
    return reduce(lambda a, b: a.unionByName(b), facts)
