"""Rollups that are kept up to date: one mergeable state per series and day.

A state holds, for each measure, how many values are known and their sum, and
how many hours lie in deficit. States of days add up to those of weeks, months
and years, so reports read a few hundred rows per series and year and no hour.
``update`` takes new and corrected hours: it reads the months they fall into,
replaces the hours with the same series and time, computes the states of the
touched days anew and rewrites these months only. Sums are taken anew from the
hours of a day, never adjusted by differences, so a corrected day is as exact
as one that arrived at once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrid.constants import MONTH_NAMES
from sparkgrid.functions.calendar import day_label, week_label
from sparkgrid.operators.rollups import add_empty_bins
from sparkgrid.session import join_keys, stage

MEASURES = ["pred_gap", "pred_demand", "pred_solar", "pred_wind"]
MONTH = "month_of"


def _month(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_states(df: DataFrame, measures: list[str] | None = None, gap: str = "pred_gap", ts: str = "ts",
               keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, day, rows, deficits, n_… and sum_… of each measure); rows without a time have no day."""
    measures = measures or MEASURES
    parts = [f(c).alias(f"{n}_{c}") for c in measures for n, f in (("n", F.count), ("sum", F.sum))]
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, day_label(ts).alias("day")).agg(
        F.count("*").alias("rows"), F.count(F.when(F.col(gap) > 0, 1)).alias("deficits"), *parts)


def create(df: DataFrame, hours: str, states: str, measures: list[str] | None = None, gap: str = "pred_gap",
           ts: str = "ts", keys: Iterable[str] = ()) -> None:
    """Write the hours and the states of their days, in one folder per month each."""
    rows = df.where(F.col(ts).isNotNull()).withColumn(MONTH, _month(ts))
    _write(rows, hours, "overwrite")
    _write(day_states(rows, measures, gap, ts, keys).withColumn(MONTH, _month("day")), states, "overwrite")


def _write(df: DataFrame, path: str, mode: str) -> None:
    """One folder per month; with mode "months" only the folders of the months that ``df`` holds are replaced."""
    writer = df.repartition(MONTH).write.partitionBy(MONTH)
    if mode == "months":
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    writer.mode(mode).parquet(path)


def update(spark: SparkSession, arrived: DataFrame, hours: str, states: str, measures: list[str] | None = None,
           gap: str = "pred_gap", ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Take new and corrected hours; returns the states that were computed anew.

    A correction replaces the hour of the same series and time. Two arrivals
    for one hour are an error.
    """
    keys = list(keys)
    arrived = stage(arrived.where(F.col(ts).isNotNull()), "arrived")
    twice = arrived.groupBy(*keys, ts).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"several arrivals for one hour: {twice.first()}")
    # As many rows as there are months of arrivals.
    months = [r[0] for r in arrived.select(_month(ts)).distinct().collect()]
    if not months:
        return spark.read.parquet(states).limit(0)
    before = spark.read.parquet(hours).where(F.col(MONTH).isin(months))
    kept = join_keys(before, arrived.select(*keys, ts), [*keys, ts], "left_anti", known=[ts])
    merged = stage(kept.unionByName(arrived.withColumn(MONTH, _month(ts)), allowMissingColumns=True), "merged")

    days = arrived.select(*keys, day_label(ts).alias("day")).distinct()
    touched = join_keys(merged.withColumn("_day", day_label(ts)), days.withColumnRenamed("day", "_day"),
                        [*keys, "_day"], "left_semi", known=["_day"]).drop("_day")
    anew = stage(day_states(touched, measures, gap, ts, keys).withColumn(MONTH, _month("day")), "anew")
    old = spark.read.parquet(states).where(F.col(MONTH).isin(months))
    others = join_keys(old, days, [*keys, "day"], "left_anti", known=["day"])
    replaced = stage(others.unionByName(anew), "states")
    # The states last: a run that fails before has changed hours only, and can be repeated.
    _write(merged, hours, "months")
    _write(replaced, states, "months")
    return anew


def merged_states(states: DataFrame, *units: Column, keys: Iterable[str] = ()) -> DataFrame:
    """The states of longer spans: everything in a state adds up."""
    sums = [f.name for f in states.schema if isinstance(f.dataType, T.NumericType) and (
        f.name in ("rows", "deficits") or f.name.startswith(("n_", "sum_")))]
    return states.groupBy(*keys, *units).agg(*[F.sum(c).alias(c) for c in sums])


def mean(measure: str) -> Column:
    return F.when(F.col(f"n_{measure}") > 0, F.col(f"sum_{measure}") / F.col(f"n_{measure}"))


def yearly_summary(states: DataFrame, decimals: int = 0, keys: Iterable[str] = ()) -> DataFrame:
    """As ``rollups.yearly_summary``, from states."""
    keys = list(keys)
    names = {"avg_gap": "pred_gap", "avg_demand": "pred_demand", "avg_solar": "pred_solar", "avg_wind": "pred_wind"}
    years = merged_states(states, F.year("day").alias("year"), keys=keys)
    return years.select(*keys, "year", *[F.bround(mean(c), decimals).alias(n) for n, c in names.items()],
                        F.bround(F.col("deficits") / F.col("rows") * 100, decimals).alias("pct_deficit"))


def year_month_pivot(states: DataFrame, measure: str = "pred_gap", keys: Iterable[str] = ()) -> DataFrame:
    """As ``rollups.year_month_pivot``, from states."""
    keys = list(keys)
    months = merged_states(states, F.year("day").alias("year"), F.month("day").alias("_month"), keys=keys)
    cells = months.select(*keys, "year", "_month", mean(measure).alias("mean"))
    pivoted = cells.groupBy(*keys, "year").pivot("_month", list(range(1, 13))).agg(F.first("mean"))
    return pivoted.withColumnsRenamed({str(i + 1): name for i, name in enumerate(MONTH_NAMES)})


def resample(states: DataFrame, unit: str, measures: list[str] | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, ts, means) per day ("D") or week ending on Sunday ("W"), from states; empty ones between are present."""
    keys, measures = list(keys), measures or MEASURES
    label, days = {"D": (F.col("day"), 1), "W": (week_label("day"), 7)}[unit]
    spans = merged_states(states, label.alias("_label"), keys=keys)
    means = spans.select(*keys, "_label", *[mean(c).alias(c) for c in measures])
    step = F.make_dt_interval(F.lit(days)).cast("interval day")
    return add_empty_bins(means, "_label", step, keys).select(
        *keys, F.col("_label").cast("timestamp_ntz").alias("ts"), *measures)

