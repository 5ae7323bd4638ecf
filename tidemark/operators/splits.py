"""Leakage-safe chronological splits, balanced by label, and views of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import quantiles, running_total
from ..sources.tables import scratch_path


def unit_table(rows: DataFrame, unit: str, time: str, label: str, classes: list, ids: str) -> DataFrame:
    """Per unit: rows, class counts, first and last time."""
    return rows.groupBy(unit).agg(
        F.count_distinct(ids).alias("n"), *(F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes), F.min(time).alias("unit_start"), F.max(time).alias("unit_end")
    )


def early_block(units: DataFrame, order: list[str], share: float) -> DataFrame:
    """Marks the first ``share`` of rows in chronological order of whole units."""
    placed = running_total(units, [F.col(c) for c in order], "n", "upto")
    total = units.agg(F.sum("n")).first()[0] or 0
    return placed.withColumn("early", F.col("upto") <= share * total)


def later_slices(later: DataFrame, order: list[str], slices: int = 3) -> DataFrame:
    """Chronological slices of equal mass: 1..slices."""
    placed = running_total(later.drop("upto"), [F.col(c) for c in order], "n", "upto")
    total = later.agg(F.sum("n")).first()[0] or 1
    return placed.withColumn("temporal_slice", F.least(F.ceil(F.col("upto") * slices / total), F.lit(slices)).cast("int")).drop("upto")


def greedy_deal(units: DataFrame, order: list[Column], group: str, metrics: dict[str, float], blocks: dict[int, list[str]], rarest: bool = False, out: str = "block") -> DataFrame:
    """Deals each group's units over its blocks, one after another in ``order``: a unit goes where the weighted squares of
    all blocks' deviations from equal shares add up to the least (ties: the first block).

    metrics: column -> weight; the first one counts rows. ``rarest``: the others weigh more by how rarely they occur in the
    group. Sequential by nature, over units, not rows: sorted units stream through a task with one group's sums as
    state, so memory does not grow, and the result is the same at every size. Sums are taken block by block in the
    order of ``blocks`` and ``metrics``, so that ties by rounding fall alike everywhere.
    """
    names = list(metrics)
    totals = {r[group]: {m: float(r[m] or 0) for m in names} for r in units.groupBy(group).agg(*(F.sum(m).alias(m) for m in names)).collect()}  # a row a group
    weights = {g: {m: w * (t[names[0]] / max(t[m], 1.0) if rarest and m != names[0] else 1.0) for m, w in metrics.items()} for g, t in totals.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for x in batches:
            placed = []
            for g, *sizes in zip(x[group], *(x[m].astype(float) for m in names), strict=True):
                own = blocks[g]
                if g != current:
                    current, state = g, {b: [0.0] * len(names) for b in own}
                    target = [totals[g][m] / len(own) for m in names]
                    weight = [weights[g][m] for m in names]

                def score(block: str) -> float:
                    total = 0.0
                    for b in own:  # noqa: B023
                        for k, held in enumerate(state[b]):  # noqa: B023
                            deviation = (held + (sizes[k] if b == block else 0.0) - target[k]) / max(target[k], 1.0)  # noqa: B023
                            total += weight[k] * (deviation * deviation)  # noqa: B023
                    return total

                best = min(own, key=lambda b: (score(b), b))  # noqa: B023
                state[best] = [a + b for a, b in zip(state[best], sizes, strict=True)]
                placed.append(best)
            yield x.drop(columns="__at").assign(**{out: placed})

    ranked = units.withColumn("__at", F.struct(*order))
    schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes) + f", `{out}` string"
    return ranked.repartition(group).sortWithinPartitions(group, "__at").mapInPandas(run, schema)


def tie(*parts: str | Column) -> Column:
    """A digest that orders equal units."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def balanced_deal(units: DataFrame, group: str, unit: str, metrics: dict[str, float], blocks: dict[int, list[str]], seed: int, strategy: str = "balanced", out: str = "block") -> DataFrame:
    """Deals a group's units over its blocks, large units first. strategy: ``balanced``, or ``rarest_first``, where rare classes weigh more."""
    if strategy not in ("balanced", "rarest_first"):
        raise ValueError(f"unknown strategy {strategy}")
    first = next(iter(metrics))
    return greedy_deal(units, [(-F.col(first)).alias("size"), tie(F.lit(str(seed)), F.col(unit).cast("string")).alias("tie")], group, metrics, blocks, strategy == "rarest_first", out)


def allocate_units(units: DataFrame, unit: str, metrics: dict[str, float], blocks: list[str], out: str = "block") -> DataFrame:
    """Deals all units over all blocks: those with the rarest classes first, then large ones; refuses if a block stays empty.

    A unit's rarity is its part of all rows of each class (all metrics but the first), added up.
    """
    first, *classes = metrics
    totals = units.agg(*(F.sum(m).alias(m) for m in classes)).first()  # one row
    rarity = sum((F.col(m) / max(totals[m] or 0, 1) for m in classes), F.lit(0.0))
    order = [(-rarity).alias("rarity"), (-F.col(first)).alias("size"), tie(F.col(unit).cast("string")).alias("tie")]
    path = scratch_path(units.sparkSession, "dealt")
    dealt = greedy_deal(units.withColumn("__all", F.lit(0)), order, "__all", metrics, {0: blocks}, out=out).drop("__all")
    dealt.write.parquet(path)
    dealt = units.sparkSession.read.schema(dealt.schema).parquet(path)
    held = {r[0] for r in dealt.select(out).distinct().collect()}  # a row a block
    if held != set(blocks):
        raise ValueError(f"blocks without units: {sorted(set(blocks) - held)}")
    return dealt


def rolling_manifest(units: DataFrame, block: str, windows: dict[str, dict[str, list[str]]]) -> DataFrame:
    """A row for each unit, window and split the unit's block has a part in."""
    rows = [(w, s, b) for w, parts in windows.items() for s, bs in parts.items() for b in bs]
    roles = F.create_map(*(x for b in sorted({r[2] for r in rows}) for x in (F.lit(b), F.array(*(F.struct(F.lit(w).alias("window_id"), F.lit(s).alias("split")) for w, s, bb in rows if bb == b)))))
    return units.withColumn("__r", F.explode(F.element_at(roles, F.col(block)))).select(*units.columns, "__r.*")


def split_shares(manifest: DataFrame, size: str = "n") -> DataFrame:
    rows = manifest.groupBy("window_id", "split").agg(F.count(F.lit(1)).alias("units"), F.sum(size).alias("n"))
    return rows.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy("window_id"))))


def split_gate(manifest: DataFrame, start: str, end: str, least_share: float) -> DataFrame:
    """Per window: does training end before evaluation ends, and is each split large enough."""
    shares = split_shares(manifest).groupBy("window_id").agg(F.min("share").alias("smallest_share"))
    dates = manifest.groupBy("window_id").agg(F.max(F.when(F.col("split") == "train", F.col(end))).alias("train_end"), F.max(F.when(F.col("split") != "train", F.col(end))).alias("eval_end"))
    out = dates.join(shares, "window_id")
    return out.withColumn("chronological", F.col("train_end") <= F.col("eval_end")).withColumn("large_enough", F.col("smallest_share") >= least_share)


def strict_flags(rows: DataFrame, bounds: DataFrame, window: str, start: str, end: str, phases: dict[str, float]) -> DataFrame:
    """``strict_<phase>``: the phase's cutoff (by the end itself, not the day after) lies after the window's training end."""
    out = rows.join(F.broadcast(bounds), window)  # one row a window
    s, e = F.unix_timestamp(start), F.unix_timestamp(end)
    for phase, ratio in phases.items():
        out = out.withColumn(f"strict_{phase}", F.timestamp_seconds(F.floor(s + (e - s) * ratio)) > F.col("train_end"))
    return out


def overlap_audit(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Share of rows that are not strict, by key and phase, as long rows."""
    wide = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~F.col(f)).alias(f) for f in flags))
    long = wide.withColumn("x", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("overlap")) for f in flags))))
    return long.select(*keys, "x.flag", "n", "x.overlap").withColumn("overlap_share", F.try_divide("overlap", "n"))


def base2_jsd(left: list[Column], right: list[Column]) -> Column:
    """Jensen-Shannon divergence of two distributions of shares, base 2."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    total = F.lit(0.0)
    for p, q in zip(left, right, strict=True):
        m = (p + q) / 2
        total = total + part(p, m) / 2 + part(q, m) / 2
    return total


def label_drift(dist: DataFrame, order: str, classes: list, prefix: str = "n_") -> DataFrame:
    """Root of the divergence of each row's class shares from the row before (one row a window)."""
    total = sum((F.col(f"{prefix}{c}") for c in classes), F.lit(0))
    shares = dist.select(order, *(F.try_divide(F.col(f"{prefix}{c}"), total).alias(f"s_{c}") for c in classes))
    before = [F.lag(f"s_{c}").over(Window.orderBy(order)) for c in classes]
    jsd = base2_jsd([F.col(f"s_{c}") for c in classes], before)
    return shares.withColumn("drift", F.when(before[0].isNotNull(), F.sqrt(F.greatest(jsd, F.lit(0.0)))))


def validate_manifest(manifest: DataFrame, unit: str, required: list[str], versions: dict[str, str] | None = None) -> DataFrame:
    """Checks as rows: missing columns, units in several splits of one window, null units, and rows of another version (column -> value)."""
    lost = [c for c in [*required, *(versions or {})] if c not in manifest.columns]
    several = manifest.where(F.col(unit).isNotNull()).groupBy("window_id", unit).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("violations"))
    stale = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in (versions or {}).items() if c in manifest.columns], F.lit(False))
    rows = manifest.agg(F.count_if(F.col(unit).isNull()).alias("null_unit"), F.count_if(stale).alias("other_version"))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in ("null_unit", "other_version")))).alias("x")).select("x.*")
    found = manifest.sparkSession.createDataFrame([("required_columns", len(lost))], "check string, violations long")
    return found.unionByName(several.select(F.lit("one_split").alias("check"), "violations")).unionByName(each)


def materialize_view(features: DataFrame, labels: DataFrame, manifest: DataFrame, id_col: str, unit: str, measures: dict[str, str]) -> DataFrame:
    """Features, labels and split of each row, with ``phase_available_<p>`` from a measure of each phase."""
    out = features.join(labels, id_col).join(manifest, unit)
    return out.withColumns({f"phase_available_{p}": F.col(m).isNotNull().cast("int") for p, m in measures.items()})


def attach_strict(view: DataFrame, strict: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that refuses a view row without context."""
    lost = view.join(strict, keys, "left_anti").limit(1).count()
    if lost:
        raise ValueError(f"rows without strict context on {keys}")
    return view.join(strict, keys)


def prefix_view(view: DataFrame, phases: list[str], k: int) -> DataFrame:
    """The view as seen at phase k: later phases' columns null, their availability 0."""
    later = phases[k:]
    types = dict(view.dtypes)
    out = []
    for c in view.columns:
        phase = next((p for p in later if c.endswith(f"_{p}")), None)
        out.append(F.col(c) if phase is None else (F.lit(0) if c.startswith("phase_available_") else F.lit(None)).cast(types[c]).alias(c))
    return view.select(*out)


def view_audit(view: DataFrame, keys: list[str], id_col: str, unit: str) -> DataFrame:
    return view.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(id_col).alias("ids"), F.count_distinct(unit).alias("units"))


def visible_columns(columns: list[str], phases: list[str], k: int, hidden: tuple[str, ...]) -> list[str]:
    """Columns a model may read at phase k: no later phases, no hidden prefixes."""
    return [c for c in columns if not c.startswith(hidden) and not any(c.endswith(f"_{p}") for p in phases[k:])]


def assignment_qa(context: DataFrame, id_col: str, block: str) -> DataFrame:
    per = context.groupBy(id_col).agg(F.count_distinct(block).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("k") > 1).alias("several_blocks"), F.count_if(F.col("k") == 0).alias("unmapped"))


def unit_sizes(units: DataFrame, key: str, size: str) -> DataFrame:
    middle = quantiles(units, {"size": F.col(size)}, [0.5, 0.9], [key]).select(key, F.get("quantiles", F.lit(0)).alias("p50"), F.get("quantiles", F.lit(1)).alias("p90"))
    rows = units.groupBy(key).agg(F.count(F.lit(1)).alias("units"), F.max(size).alias("largest"), F.count_if(F.col(size) <= 5).alias("tiny"))
    return rows.join(middle, key, "left").select(key, "units", "p50", "p90", "largest", "tiny")


def lineage(records: DataFrame) -> DataFrame:
    """Each record with the SHA-256 of its canonical JSON."""
    return records.withColumn("lineage_sha256", F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256))
