"""Aggregates by calendar unit, resampling, pivots."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrid.constants import MONTH_NAMES, SEASONS
from sparkgrid.functions.calendar import day_label, season, week_label
from sparkgrid.functions.columns import share
from sparkgrid.operators.clean import date_slice
from sparkgrid.session import join_keys

# Longest array of empty bins in one row.
MAX_BINS = 4_096


def mean_by(df: DataFrame, unit: Column, name: str, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """Mean of each column per value of a calendar expression."""
    return df.groupBy(*keys, unit.alias(name)).agg(*[F.avg(c).alias(c) for c in columns])


def by_hour(df: DataFrame, columns: list[str], ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    return mean_by(df, F.hour(ts), "hour", columns, keys)


def by_month(df: DataFrame, columns: list[str], ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    return mean_by(df, F.month(ts), "month", columns, keys)


def weekday_weekend_by_hour(df: DataFrame, column: str, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Mean per hour, weekdays and weekends side by side, in one pass."""
    weekend = F.weekday(ts) >= 5
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg(F.when(~weekend, F.col(column))).alias("weekday"),
        F.avg(F.when(weekend, F.col(column))).alias("weekend"),
    )


def by_season(df: DataFrame, columns: list[str], ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Mean per season in fixed order (``ordinal``); a season without rows is present with NULLs."""
    keys = list(keys)
    names = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("season")) for i, s in enumerate(SEASONS)])
    means = mean_by(df, season(F.month(ts)), "season", columns, keys)
    series = means.select(*keys).distinct() if keys else df.sparkSession.range(1)
    seasons = series.select(*keys, F.inline(names))
    return join_keys(seasons, means, [*keys, "season"], "left", known=["season"]).select(
        *keys, "ordinal", "season", *columns)


def yearly_summary(df: DataFrame, decimals: int = 0, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Mean gap, demand, solar and wind and the share of deficit rows per year, halves to even."""
    means = {"avg_gap": "pred_gap", "avg_demand": "pred_demand", "avg_solar": "pred_solar", "avg_wind": "pred_wind"}
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(
        *[F.bround(F.avg(c), decimals).alias(name) for name, c in means.items()],
        F.bround(share(F.col("pred_gap") > 0), decimals).alias("pct_deficit"),
    )


def year_month_pivot(df: DataFrame, column: str = "pred_gap", ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Mean per year (rows) and month (columns Jan … Dec); empty cells are NULL."""
    pivoted = (
        df.select(*keys, F.year(ts).alias("year"), F.month(ts).alias("_month"), column)
        .groupBy(*keys, "year").pivot("_month", list(range(1, 13))).agg(F.avg(column))
    )
    return pivoted.withColumnsRenamed({str(i + 1): name for i, name in enumerate(MONTH_NAMES)})


def add_empty_bins(means: DataFrame, label: str, step: Column, keys: Iterable[str] = ()) -> DataFrame:
    """Add the missing bins between the first and the last of each series, with NULLs.

    Each bin is followed by those up to the next one, so the data behind the
    aggregate are read once. The window sees one row per bin; their number is
    bounded by the calendar, not by the data.
    """
    keys = list(keys)
    ahead = means.withColumn("_next", F.lead(label).over(Window.partitionBy(*keys).orderBy(label)))
    until = F.coalesce(F.col("_next") - step, F.col(label))
    # Over a gap of centuries a single array of bins could outgrow a row, so it is made in two steps.
    stretch = step * MAX_BINS
    starts = ahead.withColumn("_until", until).withColumn(
        "_start", F.explode(F.sequence(F.col(label), F.col("_until"), stretch)))
    end = F.least(F.col("_until"), F.col("_start") + stretch - step)
    bins = starts.withColumn("_bin", F.explode(F.sequence(F.col("_start"), end, step)))
    first = F.col("_bin") == F.col(label)
    others = [c for c in means.columns if c not in (label, *keys)]
    return bins.select(*keys, F.col("_bin").alias(label), *[F.when(first, F.col(c)).alias(c) for c in others])


def resample(df: DataFrame, unit: str, ts: str = "ts", keys: Iterable[str] = (),
             columns: list[str] | None = None) -> DataFrame:
    """Mean of the numeric columns per day ("D") or per week ending on Sunday ("W").

    Every day or week between the first and the last of a series is present,
    with NULLs if it has no rows.
    """
    keys = list(keys)
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    label, days = {"D": (day_label(ts), 1), "W": (week_label(ts), 7)}[unit]
    means = mean_by(df.where(F.col(ts).isNotNull()), label, "_label", columns, keys)
    step = F.make_dt_interval(F.lit(days)).cast("interval day")
    every = add_empty_bins(means, "_label", step, keys)
    return every.select(*keys, F.col("_label").cast(df.schema[ts].dataType).alias(ts), *columns)


def years(df: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Distinct years in order."""
    return df.select(*keys, F.year(ts).alias("year")).distinct().orderBy(*keys, "year")


def months(df: DataFrame, year: int, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Distinct months of one year in order; the year is a range of the scan."""
    rows = date_slice(df.select(*keys, ts), year, ts=ts)[0]
    return rows.select(*keys, F.month(ts).alias("month")).distinct().orderBy(*keys, "month")


def fullest_year(df: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """The year with most rows, of each series; the earliest of equals."""
    keys = list(keys)
    counted = df.groupBy(*keys, F.year(ts).alias("year")).agg(F.count("*").alias("rows"))
    if not keys:
        return counted.orderBy(F.desc("rows"), "year").limit(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rows"), "year"))
    return counted.withColumn("_place", place).where("_place = 1").drop("_place")
