"""Data-quality, missingness and drift facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import quantiles
from ..sources.tables import scratch_path
from .balance import hash_unit
from .splits import base2_jsd

EPS = 1e-12


def long_stats(df: DataFrame, columns: list[str], stats: dict[str, object], name: str = "feature", keys: list[str] | None = None) -> DataFrame:
    """One aggregation over all columns, then one row a column; stats: name -> function of a column name."""
    one = df.groupBy(*(keys or [])).agg(*(F.struct(*(f(c).alias(n) for n, f in stats.items())).alias(f"__{c}") for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(f"__{c}").alias("s")) for c in columns))).alias("x")
    return one.select(*(keys or []), rows).select(*(keys or []), f"x.{name}", "x.s.*")


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def feature_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    value = lambda c: F.when(finite(c), F.col(c).cast("double"))
    return long_stats(df, columns, {
        "n": lambda c: F.count(F.lit(1)), "null_rate": lambda c: share(F.col(c).isNull()), "nonfinite_rate": lambda c: share(F.col(c).isNotNull() & ~finite(c)),
        "zero_rate": lambda c: share(F.col(c) == 0), "negative_rate": lambda c: share(F.col(c) < 0), "low": lambda c: F.min(value(c)), "high": lambda c: F.max(value(c)),
        "mean": lambda c: F.avg(value(c)), "std": lambda c: F.stddev(value(c)),
    })


def scope_counts(df: DataFrame, keys: list[str], ids: str, total: list[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(ids, 0.01).alias("ids_estimate"))
    return out.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(*total)))


def mask_quality(df: DataFrame, masks: list[str]) -> DataFrame:
    return long_stats(df, masks, {"rate": lambda c: F.avg(c), "nulls": lambda c: F.count_if(F.col(c).isNull()), "outside": lambda c: F.count_if(~F.col(c).isin(0, 1))}, "mask")


def quality_gate(facts: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Findings: a row for each fact and rule (name, severity, condition) that it meets."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules)), lambda x: x.isNotNull())
    return facts.withColumn("x", F.explode(found)).select("feature", "x.rule", "x.severity")


def categorical_audit(df: DataFrame, columns: list[str], most: int = 64) -> DataFrame:
    """The ``most`` frequent values of each column with their counts (a report of top values)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("r") <= most).select("feature", "value", "n", F.col("r").alias("rank"))


def cell_state(value: Column, available: Column, observed: Column) -> Column:
    """unavailable, structural, missing, zero or observed: three kinds of absence that never merge."""
    return F.when(~available, "unavailable").when(~observed, "structural").when(value.isNull(), "missing").when(value == 0, "zero").otherwise("observed")


def structural_mask(df: DataFrame, columns: list[str], mask: str) -> DataFrame:
    return df.withColumns({f"structural__{c}": (F.col(mask) == 0).cast("int") for c in columns})


def quality_summary(df: DataFrame, columns: list[str], masks: list[str], keys: list[str], label: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.sum(F.col("__n") - 1).alias("duplicate_keys"))
    any_of = lambda cs: reduce(lambda a, b: a | b, cs)
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(any_of([F.isnan(F.col(c).cast("double")) for c in columns])).alias("nonfinite_rows"), F.count_if(any_of([F.col(c) < 0 for c in columns])).alias("negative_rows"),
        F.count_if(any_of([~F.col(m).isin(0, 1) for m in masks])).alias("bad_mask_rows"), F.count_if(F.col(label).isNull()).alias("null_labels"),
    )
    both = one.withColumn("__k", F.lit(1)).join(per.withColumn("__k", F.lit(1)), "__k")  # one row each
    return both.drop("__k")


WIDENING = 1e-7


def bin_scheme(train: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """feature, n, edges: the quantile edges of ``bins`` bins over the training values, smallest and largest included.

    Edges rise strictly: one that does not lie above the one before is set just above it, so a constant column keeps all
    its bins. A feature without values has no row.
    """
    found = quantiles(train, {c: F.col(c) for c in columns}, [i / bins for i in range(bins + 1)])
    rising = F.aggregate(
        "quantiles", F.expr("cast(array() as array<double>)"), lambda a, e: F.array_append(a, F.when((F.size(a) == 0) | (e > F.element_at(a, -1)), e).otherwise(F.element_at(a, -1) + WIDENING))
    )
    counts = long_stats(train, columns, {"n": lambda c: F.count(c)})
    return found.join(counts, "feature").select("feature", "n", rising.alias("edges"))


MOMENTS = ["n", "low", "high", "mean", "m2", "m3"]


def with_spread(moments: DataFrame) -> DataFrame:
    return moments.withColumn("std", F.sqrt(F.try_divide("m2", "n")))


def hist_sketch(df: DataFrame, scheme: DataFrame, columns: list[str], keys: list[str], imputed: dict[str, Column] | None = None) -> DataFrame:
    """keys, feature, status, n, low, high, mean, m2, m3, std, counts, p05, p50, p95, jsd: values by locked bin, observed ones apart from imputed ones.

    m2 and m3 are sums of squares and cubes of deviations from the mean. counts: an entry a bin; values outside the
    outer edges count in the outer bins. jsd: divergence of the observed from the imputed histogram, null where one is
    missing. Null values and features without a scheme (one row a feature) are left out. imputed: column -> condition.
    """
    status = lambda c: F.when((imputed or {}).get(c, F.lit(False)), "imputed").otherwise("observed")
    one = F.array(*(F.struct(F.lit(c).alias("column"), status(c).alias("status"), F.col(c).cast("double").alias("v")) for c in columns))
    long = df.select(*keys, F.explode(one).alias("x")).select(*keys, "x.*").where("v is not null")
    own = [*keys, "column", "status"]
    bins = len((scheme.select("edges").first() or [[0.0, 0.0]])[0]) - 1  # one row
    inner = F.slice("edges", 2, bins - 1)
    placed = long.join(F.broadcast(scheme.select(F.col("feature").alias("column"), "edges")), "column").withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("v"))))
    skew = F.coalesce(F.nanvl(F.skewness("v"), F.lit(0.0)), F.lit(0.0))
    m2 = F.var_pop("v") * F.count("v")
    counted = placed.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), m2.alias("m2"), (skew * F.sqrt(m2 * m2 * m2 / F.count("v"))).alias("m3"),
        F.array(*(F.count_if(F.col("bin") == b) for b in range(bins))).alias("counts"),
    )
    q = quantiles(placed, {"v": F.col("v")}, [0.05, 0.5, 0.95], own)
    q = q.select(*own, *(F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("p05", "p50", "p95"))))
    apart = counted.groupBy(*keys, "column").agg(*(F.first(F.when(F.col("status") == s, F.col("counts")), ignorenulls=True).alias(s) for s in ("observed", "imputed")))
    share_of = lambda side: [F.get(side, F.lit(b)) / F.aggregate(side, F.lit(0).cast("long"), lambda a, x: a + x) for b in range(bins)]
    apart = apart.select(*keys, "column", F.when(F.col("observed").isNotNull() & F.col("imputed").isNotNull(), base2_jsd(share_of("observed"), share_of("imputed"))).alias("jsd"))
    return with_spread(counted).join(q, own).join(apart, [*keys, "column"]).withColumnRenamed("column", "feature")


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, status, n, low, high, mean, m2, m3, std, counts of sketches of parts of the data, as of the whole.

    Quantiles do not follow from those of parts and are left out.
    """
    own = [*keys, "feature", "status"]
    means = sketches.groupBy(*own).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("__mean"))
    off = F.col("mean") - F.col("__mean")
    bins = len((sketches.select("counts").first() or [[]])[0])  # one row
    merged = sketches.join(means, own).groupBy(*own).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("__mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
        F.sum(F.col("m3") + 3 * off * F.col("m2") + F.col("n") * off * off * off).alias("m3"), F.array(*(F.sum(F.get("counts", F.lit(b))) for b in range(bins))).alias("counts"),
    )
    return with_spread(merged)


def histogram_rows(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, n: a row a bin of each sketch."""
    return sketches.select(*keys, F.posexplode("counts").alias("bin", "n"))


def histogram_jsd(left: DataFrame, right: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Base-2 divergence of two sets of histograms (keys, bin, n)."""
    def wide(h: DataFrame, side: str) -> DataFrame:
        total = F.sum("n")
        return h.groupBy(*keys).agg(*((F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)) / total).alias(f"{side}{b}") for b in range(bins)))

    both = wide(left, "a").join(wide(right, "b"), keys)
    return both.select(*keys, base2_jsd([F.col(f"a{b}") for b in range(bins)], [F.col(f"b{b}") for b in range(bins)]).alias("jsd"))


def psi(left: DataFrame, right: DataFrame, keys: list[str], smooth: float = 1e-6) -> DataFrame:
    """Population stability index over bins (a missing bucket is a bin like any other)."""
    share_of = lambda h, n: h.select(*keys, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(n))
    both = share_of(left, "p").join(share_of(right, "q"), [*keys, "bin"], "full")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(smooth)) for c in ("p", "q"))
    return both.groupBy(*keys).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def class_distribution(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.coalesce(F.try_divide(F.sum(-F.col("p") * F.log("p")), F.log(F.count(F.lit(1)))), F.lit(0.0)).alias("normalised_entropy"), (F.max("n") / F.min("n")).alias("imbalance"),
    )


def activity_profile(view: DataFrame, modalities: list[str], phases: list[str], cells: list[str], enroll: str, end: str, cutoffs: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """keys, phase and facts of the rows at that phase, from cumulative counts ``<modality>_<phase>`` (null: none).

    zero_activity: share of rows without any event so far; inactive: share without a new one since the phase before;
    mean_events; zero_cells and known_cells among ``cells`` of phases up to this one (columns without a phase belong to
    all); observed_length (whole days from enrollment to the cutoff) and observed_fraction (of the whole days to the end),
    means over the ``timed`` rows, those with a cutoff and a day at least; monotone_violations: rows whose count fell.
    """
    of_phase = {c: next((i for i, p in enumerate(phases) if c.endswith(f"_{p}")), 0) for c in cells}
    day = lambda a, b: F.floor((F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 86_400_000_000)
    facts, before = [], F.lit(0.0)
    for k, phase in enumerate(phases):
        total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{m}_{phase}"), F.lit(0)).cast("double") for m in modalities])
        known = [c for c in cells if of_phase[c] <= k]
        many = lambda f: reduce(lambda a, b: a + b, [F.coalesce(f(c).cast("int"), F.lit(0)) for c in known], F.lit(0))  # noqa: B023, E731
        whole, seen = day(enroll, end), day(enroll, cutoffs[phase])
        timed = (whole > 0) & F.col(cutoffs[phase]).isNotNull()
        facts.append(F.struct(
            F.lit(phase).alias("phase"), F.count(F.lit(1)).alias("n"), F.avg((total == 0).cast("int")).alias("zero_activity"), F.avg((total == before).cast("int")).alias("inactive"), F.avg(total).alias("mean_events"),
            F.sum(many(lambda c: F.col(c) == 0)).alias("zero_cells"), F.sum(many(lambda c: F.col(c).isNotNull())).alias("known_cells"), F.count_if(timed).alias("timed"),
            F.avg(F.when(timed, seen)).alias("observed_length"), F.avg(F.when(timed, seen / whole)).alias("observed_fraction"), F.count_if(total < before).alias("monotone_violations"),
        ))
        before = total
    return view.groupBy(*(keys or [])).agg(F.array(*facts).alias("x")).select(*(keys or []), F.inline("x"))


def static_audit(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Per column: distinct values, share of groups in which it is constant, and intraclass correlation."""
    per = long_stats(df, columns, {"n": lambda c: F.count(c), "k": lambda c: F.count_distinct(c), "m": lambda c: F.avg(c), "v": lambda c: F.var_pop(c)}, keys=[group])
    distinct = long_stats(df, columns, {"values": lambda c: F.count_distinct(c)})
    total = per.groupBy("feature").agg(F.avg((F.col("k") <= 1).cast("int")).alias("constant_groups"), F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum("n")).alias("within"), (F.try_divide(F.sum(F.col("n") * F.col("m") * F.col("m")), F.sum("n")) - F.pow(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")), F.lit(2.0))).alias("between"))
    out = total.join(distinct, "feature").withColumn("icc", F.coalesce(F.try_divide("between", F.col("between") + F.col("within")), F.lit(0.0)))
    return out.withColumn("flag", F.when(F.col("values") <= 1, "constant").when(F.col("constant_groups") == 1, "group_constant").otherwise("varies"))


def prefix_scan(view: DataFrame, later: list[str]) -> DataFrame:
    """Non-null cells of columns that must still be unknown."""
    return long_stats(view, later, {"violations": lambda c: F.count(c)})


def cohort_flag(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """SEEN if the key occurs in training, else UNSEEN."""
    known = train.select(key).distinct().withColumn("__seen", F.lit(1))
    return test.join(known, key, "left").withColumn("cohort", F.when(F.col("__seen") == 1, "SEEN").otherwise("UNSEEN")).drop("__seen")


def hidden_cells(column: str, key: list[str], rate: float, seed: int) -> Column:
    """A reproducible choice of a column's cells by digest, whatever the partitions."""
    return hash_unit(F.lit(seed), F.lit(column), *map(F.col, key)) < rate


def fidelity_probe(df: DataFrame, families: dict[str, str], key: list[str], rate: float, seed: int, imputers: dict[str, Callable[[DataFrame], DataFrame]], unavailable: dict[str, Column] | None = None) -> DataFrame:
    """imputer, family, n, mae, rmse, median_error: how far imputed values are from observed ones that were hidden.

    A share ``rate`` of each column's cells, observed and not structurally absent (``unavailable``: column -> condition), is
    hidden once; every imputer (name -> function that fills a row, fitted before on other rows or on the masked ones)
    fills the same rows, those with a hidden cell, and one pass takes all errors, written once. families: column -> family.
    """
    path = scratch_path(df.sparkSession, "masked")
    chosen = {c: F.col(c).isNotNull() & ~(unavailable or {}).get(c, F.lit(False)) & hidden_cells(c, key, rate, seed) for c in families}
    marked = df.withColumns({f"__truth_{c}": F.when(chosen[c], F.col(c).cast("double")) for c in families})
    marked.withColumns({c: F.when(F.col(f"__truth_{c}").isNull(), F.col(c)) for c in families}).write.parquet(path)
    masked = df.sparkSession.read.parquet(path).where(F.coalesce(*(F.col(f"__truth_{c}") for c in families)).isNotNull())
    errors = []
    for name, fill in imputers.items():
        off = F.array(*(F.struct(F.lit(f).alias("family"), F.abs(F.col(c).cast("double") - F.col(f"__truth_{c}")).alias("error")) for c, f in families.items()))
        errors.append(fill(masked).select(F.lit(name).alias("imputer"), F.explode(off).alias("x")).select("imputer", "x.*").where("error is not null"))
    held = scratch_path(df.sparkSession, "errors")
    reduce(lambda a, b: a.unionByName(b), errors).write.parquet(held)
    every = df.sparkSession.read.parquet(held)
    own = ["imputer", "family"]
    middle = quantiles(every, {"e": F.col("error")}, [0.5], own).select(*own, F.get("quantiles", F.lit(0)).alias("median_error"))
    return every.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")).join(middle, own)


SMOOTH = 1e-12


def synthetic_fidelity(real: DataFrame, made: DataFrame, label: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """label, feature, n_real, n_made, jsd, distance, outside: how synthetic values of a class differ from its real ones.

    jsd: over the bins between the real values' distinct 21 quantiles (0 where there is one only; values outside count
    in no bin). distance: mean difference of 101 quantiles over the real interquartile range, or over the deviation where
    that is 0. outside: synthetic values beyond the real range. Classes on one side only have no row.
    """
    each = lambda df: df.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(label, "x.*").where("v is not null")
    own = [label, "column"]
    a, b = each(real), each(made)
    steps = [i / 100 for i in range(101)]
    q = lambda x, name: quantiles(x, {"v": F.col("v")}, steps, own).select(*own, F.col("quantiles").alias(name))
    sizes = a.groupBy(*own).agg(F.count("v").alias("n_real"), F.stddev_pop("v").alias("std"))
    book = q(a, "real").join(q(b, "made"), own).join(sizes, own)
    book = book.withColumn("edges", F.array_sort(F.array_distinct(F.filter("real", lambda _, i: i % 5 == 0))))
    seat = F.when((F.col("v") >= F.get("edges", F.lit(0))) & (F.col("v") <= F.element_at("edges", -1)), F.greatest(F.least(F.size(F.filter("edges", lambda e: e <= F.col("v"))), F.size("edges") - 1), F.lit(1)))

    def counts(x: DataFrame, name: str) -> DataFrame:
        bins = x.join(F.broadcast(book.select(*own, "edges")), own).withColumn("bin", seat)  # a row a class and column
        far = F.count_if((F.col("v") < F.get("edges", F.lit(0)) - tolerance) | (F.col("v") > F.element_at("edges", -1) + tolerance))
        return bins.groupBy(*own).agg(F.array(*(F.count_if(F.col("bin") == i) for i in range(1, 21))).alias(name), far.alias(f"{name}_outside"), F.count("v").alias(f"{name}_n"))

    both = book.join(counts(a, "h_real").select(*own, "h_real"), own).join(counts(b, "h_made"), own)
    bins = F.size("edges") - 1
    smooth = lambda c: F.transform(F.slice(c, 1, bins), lambda n: n + F.lit(SMOOTH))
    total = lambda c: F.aggregate(smooth(c), F.lit(0.0), lambda s, n: s + n)
    part = F.zip_with(F.transform(smooth("h_real"), lambda n: n / total("h_real")), F.transform(smooth("h_made"), lambda n: n / total("h_made")), lambda p, r: (p * F.log2(2 * p / (p + r)) + r * F.log2(2 * r / (p + r))) / 2)
    jsd = F.when(bins < 1, 0.0).otherwise(F.aggregate(part, F.lit(0.0), lambda s, x: s + x))
    iqr = F.get("real", F.lit(75)) - F.get("real", F.lit(25))
    scale = F.greatest(F.when(iqr > SMOOTH, iqr).otherwise(F.col("std")), F.lit(SMOOTH))
    gap = F.aggregate(F.zip_with("real", "made", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 101
    return both.select(label, F.col("column").alias("feature"), "n_real", F.col("h_made_n").alias("n_made"), jsd.alias("jsd"), (gap / scale).alias("distance"), F.col("h_made_outside").alias("outside"))


def synthetic_quality(
    real: DataFrame, made: DataFrame, label: str, id_col: str, columns: list[str], counts: list[str], available: list[str], missing: list[str], slots: dict[str, str], later: tuple[str, ...] = (), tolerance: float = 1e-6
) -> DataFrame:
    """One row of facts about synthetic rows (with parents a, b): jsd and distance (mean and largest over classes and columns),
    and the rates of values outside the real range, of counts that are no integers, of masks that are not the parents'
    (available: both, missing: one), of cells of later phases (column endings), and of cells that are not 0 where their slot (column -> mask) is unavailable."""
    shape = synthetic_fidelity(real, made, label, columns, tolerance).agg(
        F.avg("jsd").alias("jsd_mean"), F.max("jsd").alias("jsd_max"), F.avg("distance").alias("distance_mean"), F.max("distance").alias("distance_max"), F.try_divide(F.sum("outside"), F.sum("n_made")).alias("outside_rate")
    )
    masks = [*available, *missing]
    parent = lambda side: real.select(F.col(id_col).alias(side), *(F.col(m).alias(f"__{side}_{m}") for m in masks))
    x = made.join(parent("a"), "a", "left").join(parent("b"), "b", "left")
    sums = lambda conditions: F.sum(reduce(lambda p, q: p + q, [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions], F.lit(0)))
    off = [F.col(m) != F.least(f"__a_{m}", f"__b_{m}") for m in available] + [F.col(m) != F.greatest(f"__a_{m}", f"__b_{m}") for m in missing]
    shut = {c: F.coalesce(F.col(m), F.lit(0)) <= 0 for c, m in slots.items()}
    crossed = [c for c in columns if c.endswith(later)] if later else []
    rate = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    rows = F.count(F.lit(1))
    facts = x.agg(
        rows.alias("n"), rate(sums([F.abs(F.col(c) - F.rint(c)) > tolerance for c in counts]), rows * len(counts)).alias("non_integer_rate"), rate(sums(off), rows * len(masks)).alias("invalid_mask_rate"),
        rate(rows * len(crossed), rows * len(columns)).alias("cross_phase_rate"), rate(sums([s & (F.abs(F.col(c)) > tolerance) for c, s in shut.items()]), sums(list(shut.values()))).alias("unavailable_nonzero_rate"),
        sums([s & (F.abs(F.col(c)) > tolerance) for c, s in shut.items()]).alias("unavailable_nonzero_cells"),
    )
    return facts.withColumn("__k", F.lit(1)).join(shape.withColumn("__k", F.lit(1)), "__k").drop("__k")  # one row each


def static_parity(first: DataFrame, later: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per static column: rows of a later prefix whose value differs from the first prefix's, nulls counting as values; and keys on one side only."""
    right = later.select(F.col(key), F.lit(1).alias("__b"), *(F.col(c).alias(f"__{c}") for c in columns))
    both = first.select(key, F.lit(1).alias("__a"), *columns).join(right, key, "full")
    met = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return long_stats(both, columns, {"compared": lambda c: F.count_if(met), "mismatches": lambda c: F.count_if(met & ~F.col(c).eqNullSafe(F.col(f"__{c}"))), "one_side": lambda c: F.count_if(~met)})
