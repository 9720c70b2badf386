"""Thresholds and intervention levels of a gap (positive = deficit)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import (
    ACTIONS, DEFICIT_QUANTILES, DETAILED_ACTIONS, DETAILS, FIXED_THRESHOLDS, LEVEL_ORDINAL, LEVELS,
    MIN_SIDE_ROWS, SURPLUS_QUANTILES, THRESHOLD_NAMES,
)
from sparkgrid.functions.columns import signed_whole, whole
from sparkgrid.operators.quantiles import exact_quantiles
from sparkgrid.session import join_keys, join_small, one_row, stage


def quantile_thresholds(df: DataFrame, gap: str = "pred_gap", keys: Iterable[str] = (),
                        truncate: bool = False) -> DataFrame:
    """The six thresholds as quantiles of the deficits (> 0) and of the surpluses (< 0).

    A side with fewer than ``MIN_SIDE_ROWS`` rows takes the fixed values. With
    ``truncate`` quantiles are cut to whole units toward zero. One row without
    keys, else one row per series.
    """
    keys = list(keys)
    g = F.col(gap)
    sides = {"deficit": (g > 0, DEFICIT_QUANTILES), "surplus": (g < 0, SURPLUS_QUANTILES)}
    found = exact_quantiles(
        df, {s: (F.when(test, g), list(probs.values())) for s, (test, probs) in sides.items()}, keys)

    columns = []
    for side, (_, probs) in sides.items():
        for name, p in probs.items():
            usable = (F.col("name") == side) & (F.col("p") == p) & (F.col("n") >= MIN_SIDE_ROWS)
            value = F.max(F.when(usable, F.col("q")))
            if truncate:
                value = value.cast("bigint").cast("double")
            columns.append(F.coalesce(value, F.lit(FIXED_THRESHOLDS[name])).alias(name))
    if not keys:
        return found.agg(*columns)
    series = df.select(*keys).distinct()
    return join_keys(series, found, keys, "left").groupBy(*keys).agg(*columns)


def level(gap: Column, thr: Mapping[str, Column | float]) -> Column:
    """Level of a gap: ``>`` on the deficit side, ``>=`` on the surplus side; NULL for a missing gap."""
    bound = {name: thr[name] if isinstance(thr[name], Column) else F.lit(float(thr[name])) for name in thr}
    rungs = [
        gap > bound["crit_def"], gap > bound["high_def"], gap > bound["low_def"],
        gap >= bound["low_sur"], gap >= bound["high_sur"], gap >= bound["crit_sur"],
    ]
    chain = F
    for test, name in zip(rungs, LEVELS):
        chain = chain.when(test, name)
    return chain.when(gap.isNotNull(), LEVELS[-1])


def _lookup(values: Mapping[str, object], key: Column) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(key == name, F.lit(value))
    return chain


def action(level_column: Column, detailed: bool = False) -> Column:
    return _lookup(DETAILED_ACTIONS if detailed else ACTIONS, level_column)


def ordinal(level_column: Column) -> Column:
    """CRITICAL 4 … CRITICAL SURPLUS −2."""
    return _lookup(LEVEL_ORDINAL, level_column)


def detail(level_column: Column, gap: Column) -> Column:
    """Sentence with the gap in whole MW; without a sign on the surplus levels."""
    chain = F
    for name, text in DETAILS.items():
        before, after = text.split("{}")
        number = whole(gap) if "SURPLUS" in name else signed_whole(gap)
        chain = chain.when(level_column == name, F.concat(F.lit(before), number, F.lit(after)))
    return chain


def classify(df: DataFrame, gap: str = "pred_gap", thresholds: DataFrame | Mapping[str, float] = FIXED_THRESHOLDS,
             keys: Iterable[str] = (), overrides: Mapping[str, float] | None = None,
             level_name: str = "level", action_name: str = "action", detail_name: str | None = None) -> DataFrame:
    """Add level and action (and detail, if named) for each row.

    ``thresholds`` are numbers, or a table as ``quantile_thresholds`` returns
    it. ``overrides`` replaces single thresholds by the caller's numbers.
    """
    keys = list(keys)
    columns = df.columns
    thr: dict[str, Column | float]
    if isinstance(thresholds, DataFrame):
        if keys:
            # Counted and then joined: computed once.
            df = join_small(df, stage(thresholds.select(*keys, *THRESHOLD_NAMES), "thresholds"), keys)
            thr = {name: F.col(name) for name in THRESHOLD_NAMES}
        else:
            df = df.withColumn("_thr", one_row(thresholds, *THRESHOLD_NAMES))
            thr = {name: F.col(f"_thr.{name}") for name in THRESHOLD_NAMES}
    else:
        thr = dict(thresholds)
    thr.update(overrides or {})
    df = df.withColumn(level_name, level(F.col(gap), thr))
    added = [level_name, action_name]
    df = df.withColumn(action_name, action(F.col(level_name), detailed=detail_name is not None))
    if detail_name:
        df = df.withColumn(detail_name, detail(F.col(level_name), F.col(gap)))
        added.append(detail_name)
    return df.select(*[c for c in columns if c not in added], *added)


def override_limits(df: DataFrame, gap: str = "pred_gap", thresholds: DataFrame | None = None,
                    critical: float | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: allowed range, start and step of the caller's critical and high thresholds.

    ``critical`` is the value the caller has set; by default the computed one.
    """
    keys = list(keys)
    if thresholds is None:
        thresholds = quantile_thresholds(df, gap, keys, truncate=True)
    row = df.groupBy(*keys).agg(F.min(gap).cast("bigint").alias("gap_min"), F.max(gap).cast("bigint").alias("gap_max"))
    if keys:
        row = join_keys(row, thresholds.select(*keys, F.struct("high_def", "crit_def").alias("_thr")), keys)
    else:
        row = row.withColumn("_thr", one_row(thresholds, "high_def", "crit_def"))
    chosen = F.lit(critical) if critical is not None else F.col("_thr.crit_def")

    def part(c: Column, n: int) -> Column:
        return F.floor(c / n)

    return row.withColumns({
        "crit": chosen.cast("bigint"),
    }).select(
        *keys, "gap_min", "gap_max",
        F.greatest(F.lit(0), part(F.col("gap_max"), 10)).alias("crit_from"),
        F.greatest(F.col("gap_max"), F.lit(1)).alias("crit_to"),
        F.col("crit").alias("crit_value"),
        F.greatest(F.lit(100), part(F.col("gap_max") - part(F.col("gap_max"), 10), 50)).alias("crit_step"),
        F.greatest(F.lit(0), part(F.col("gap_max"), 20)).alias("high_from"),
        F.col("crit").alias("high_to"),
        F.least(F.col("_thr.high_def").cast("bigint"), F.col("crit")).alias("high_value"),
        F.greatest(F.lit(100), part(F.col("crit"), 50)).alias("high_step"),
    )
