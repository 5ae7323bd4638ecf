"""Imputation, scaling and vocabularies, fitted on training rows and applied to any split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import quantiles, running_total
from ..sources.tables import scratch_path

def melt_phases(df: DataFrame, ids: list[str], features: list[str], phases: list[str]) -> DataFrame:
    """Wide phase columns to one row a phase."""
    rows = F.array(*(F.struct(F.lit(p).alias("phase"), *(F.col(f"{f}_{p}").alias(f) for f in features)) for p in phases))
    return df.select(*ids, F.inline(rows))


def log_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of values that are not negative; others stay."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.log1p(c)).otherwise(F.col(c)) for c in columns})


def impute_constant(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    flags = {f"missing__{c}": F.col(c).isNull().cast("int") for c in columns}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def fit_univariate(train: DataFrame, columns: list[str], how: str = "median") -> dict[str, float | None]:
    """One number a column: exact median or mean of the observed training values."""
    if how == "median":
        found = {r["feature"]: r["quantiles"][0] for r in quantiles(train, {c: F.col(c) for c in columns}, [0.5]).collect()}  # one row a column
        return {c: found.get(c) for c in columns}
    row = train.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return {c: row[c] for c in columns}


def apply_constants(df: DataFrame, constants: dict[str, float | None]) -> DataFrame:
    flags = {f"missing__{c}": F.col(c).isNull().cast("int") for c in constants}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in constants.items()})


def fit_robust(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range (1 where it is 0) of the observed training values."""
    found = {r["feature"]: r["quantiles"] for r in quantiles(train, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).collect()}  # one row a column
    return {c: (found[c][1], (found[c][2] - found[c][0]) or 1.0) if c in found else (0.0, 1.0) for c in columns}


def scale(df: DataFrame, model: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in model.items()})


def fit_vocab(train: DataFrame, column: str) -> DataFrame:
    """value, code: codes from 1 in order of value; 0 is kept for unknown values."""
    values = train.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().withColumn("one", F.lit(1))
    return running_total(values, [F.col("value")], "one", "code").select("value", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    codes = vocab.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    return df.join(codes, F.col(column).cast("string") == F.col("__v"), "left").withColumn(out, F.coalesce("__c", F.lit(0))).drop("__v", "__c")


def prefix_transform(df: DataFrame, constants: dict[str, float | None], phases: list[str], k: int) -> DataFrame:
    """Imputes phases up to k; later phases' cells are zero, and so are their missing flags."""
    later = [c for c in constants if any(c.endswith(f"_{p}") for p in phases[k:])]
    out = apply_constants(df, {c: v for c, v in constants.items() if c not in later})
    return out.withColumns({c: F.lit(0.0) for c in later} | {f"missing__{c}": F.lit(0) for c in later})


def impute_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def fit_chained(
    train: DataFrame, columns: list[str], how: str = "tree", rounds: int = 1, sample: int = 1_000_000, key: str | None = None, initial: str | float = "median", penalty: float = 0.0
):
    """Chained equations: each column with missing values, fewest first, regressed on the current state of all others, in rounds.

    After each regression the column's missing cells take its predictions, so later regressions and rounds see them. The
    start is the median or a constant. Fitted on at most ``sample`` hashed rows; columns without missing values are only
    predictors. Predictions are bounded by the training range. Returns a function that fills any split the same way.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    start = fit_univariate(train, columns) if initial == "median" else dict.fromkeys(columns, float(initial))
    known = train.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(F.col(c).isNull()).alias("gone")).alias(c) for c in columns)).first()
    order = sorted((c for c in columns if known[c].gone and known[c].lo is not None), key=lambda c: (known[c].gone, columns.index(c)))
    rows = train.orderBy(F.xxhash64(key)).limit(sample) if key else train
    learner = DecisionTreeRegressor(maxDepth=5, seed=7) if how == "tree" else LinearRegression(regParam=penalty)

    def updated(state: DataFrame, c: str, model) -> DataFrame:
        guess = F.least(F.greatest(F.col("__p"), F.lit(float(known[c].lo))), F.lit(float(known[c].hi)))
        seen = VectorAssembler(inputCols=[o for o in columns if o != c], outputCol="__x").transform(state)
        return model.transform(seen).withColumn(c, F.when(F.col(f"missing__{c}") == 1, guess).otherwise(F.col(c))).drop("__x", "__p")

    state = apply_constants(rows.select(*columns), start)
    models: list[tuple[str, object]] = []
    for _ in range(rounds):
        for c in order:
            seen = VectorAssembler(inputCols=[o for o in columns if o != c], outputCol="__x").transform(state.where(F.col(f"missing__{c}") == 0))
            models.append((c, learner.copy().setFeaturesCol("__x").setLabelCol(c).setPredictionCol("__p").fit(seen)))
            path = scratch_path(train.sparkSession, "chained")  # written, so that no regression repeats the earlier ones
            updated(state, *models[-1]).write.parquet(path)
            state = train.sparkSession.read.parquet(path)

    def transform(df: DataFrame) -> DataFrame:
        out = apply_constants(df, start)
        for c, model in models:
            out = updated(out, c, model)
        return out

    return transform
