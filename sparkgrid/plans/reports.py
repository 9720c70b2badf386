"""The table behind each figure and printed report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import CORRELATION_COLUMNS
from sparkgrid.functions.calendar import month_name
from sparkgrid.functions.columns import share, signed_whole
from sparkgrid.functions.energy import errors, split_gap, stack_supply
from sparkgrid.operators.clean import date_slice
from sparkgrid.operators.features import first_rows
from sparkgrid.operators.levels import ordinal
from sparkgrid.operators.rollups import (
    by_hour, by_month, by_season, fullest_year, resample, year_month_pivot, yearly_summary,
)
from sparkgrid.operators.stats import (
    axis_limits, correlation, correlation_pairs, error_by_hour, forecast_error, frequency, group_extremes, histogram,
    histograms, metrics,
)
from sparkgrid.session import join_small, one_row, stage

WEEK, TWO_WEEKS, DAY = 24 * 7, 24 * 14, 24


# --- clean table -----------------------------------------------------------

def year_series(clean: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Hours of the fullest year with the halves of the supply gap.

    One series fetches its year and reads that range only; several join their years.
    """
    keys = list(keys)
    shown = clean.select(*keys, ts, "solar_gen", "wind_gen", "load_actual", "load_forecast", "supply_gap")
    fullest = fullest_year(clean, ts, keys)
    if keys:
        own = stage(fullest.select(*keys, F.col("year").alias("_year")), "years")
        rows = join_small(shown, own, keys).where(F.year(ts) == F.col("_year")).drop("_year")
    else:
        found = fullest.where(F.col("year").isNotNull()).first()
        rows = date_slice(shown, found.year, ts=ts)[0] if found else shown.where("false")
    return split_gap(rows, "supply_gap")


def hour_pattern(clean: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Per hour: mean solar, wind and load, and mean load of weekdays and weekends; one pass."""
    weekend = F.weekday(ts) >= 5
    split = clean.withColumns({"weekday": F.when(~weekend, F.col("load_actual")),
                               "weekend": F.when(weekend, F.col("load_actual"))})
    return by_hour(split, ["solar_gen", "wind_gen", "load_actual", "weekday", "weekend"], ts, keys)


def season_averages(clean: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    return by_season(clean, ["solar_gen", "wind_gen", "load_actual", "supply_gap"], ts, keys)


def correlation_triangle(clean: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    return correlation_pairs(clean, CORRELATION_COLUMNS, keys)


def forecast_error_report(clean: DataFrame, ts: str = "ts",
                          keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histogram of the forecast error, its mean per hour, and its overall means."""
    keys = list(keys)
    return (histogram(clean, "forecast_error", keys=keys), by_hour(clean, ["forecast_error"], ts, keys),
            forecast_error(clean, keys=keys))


def key_insights(clean: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: forecast MAE, peak hours, gap shares, best and worst solar season, correlations.

    Three passes over few columns each: overall, per hour, per season.
    """
    pairs = {"corr_renewable_load": "renewable_total", "corr_solar_load": "solar_gen", "corr_wind_load": "wind_gen"}
    overall = clean.agg(
        F.avg(F.abs("forecast_error")).alias("forecast_mae"),
        share(F.col("supply_gap") > 0).alias("pct_deficit"),
        share(F.col("supply_gap") <= 0).alias("pct_surplus"),
        *[correlation(F.col(c), F.col("load_actual")).alias(n) for n, c in pairs.items()],
    )
    hours = group_extremes(by_hour(clean, ["load_actual", "solar_gen"], ts), "hour", {
        "peak_load_hour": ("load_actual", "most"), "peak_solar_hour": ("solar_gen", "most")})
    seasons = group_extremes(by_season(clean, ["solar_gen"], ts), "season", {
        "best_solar_season": ("solar_gen", "most"), "worst_solar_season": ("solar_gen", "least")})
    row = overall.withColumns({"_h": one_row(hours), "_s": one_row(seasons)})
    return row.select("forecast_mae", "_h.peak_load_hour", "_h.peak_solar_hour", "pct_deficit", "pct_surplus",
                      "_s.best_solar_season", "_s.worst_solar_season", *pairs)


# --- demand predictions ----------------------------------------------------

def week_of_predictions(predictions: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    return first_rows(predictions, WEEK, ts, keys)


def error_report(predictions: DataFrame, models: dict[str, str], ts: str = "ts",
                 keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Histogram of the signed errors per model, and mean absolute error per hour; two passes whatever the models."""
    keys = list(keys)
    with_errors = errors(predictions, "load_actual", models)
    per_model = histograms(with_errors, {n: f"err_{n}" for n in models}, keys=keys).withColumnRenamed("name", "model")
    return per_model, error_by_hour(predictions, "load_actual", models, ts, keys)


def scatter(predictions: DataFrame, predicted: str,
            keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Actual and predicted values, the axis limits and the metrics of one model."""
    keys = list(keys)
    points = predictions.select(*keys, "load_actual", predicted)
    return points, axis_limits(points, ["load_actual", predicted], keys), metrics(
        points, "load_actual", {predicted: predicted}, keys)


# --- classified gap --------------------------------------------------------

def two_week_gap(interventions: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """First two weeks with stacked supply, gap halves and the level's ordinal."""
    rows = split_gap(stack_supply(first_rows(interventions, TWO_WEEKS, ts, keys)))
    return rows.withColumn("level_ordinal", ordinal(F.col("level")))


def week_of_supply(scored: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    keys = list(keys)
    return first_rows(scored.select(*keys, ts, "solar_gen", "pred_solar", "wind_gen", "pred_wind"), WEEK, ts, keys)


def level_report(interventions: DataFrame, keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Share of each level and histogram of the gap."""
    keys = list(keys)
    return frequency(interventions, "level", keys), histogram(interventions, "pred_gap", keys=keys)


def gap_patterns(gaps: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mean gap per hour, and per month with its short name."""
    keys = list(keys)
    months = by_month(gaps, ["pred_gap"], ts, keys).withColumn("name", month_name(F.col("month")))
    return by_hour(gaps, ["pred_gap"], ts, keys), months


def daily_overview(full: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Daily means with stacked supply and gap halves, and the yearly summary."""
    keys = list(keys)
    return split_gap(stack_supply(resample(full, "D", ts, keys))), yearly_summary(full, 0, ts, keys)


def heatmap(full: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    return year_month_pivot(full, "pred_gap", ts, keys)


def sample_report(interventions: DataFrame, ts: str = "ts", rows: int = DAY, keys: Iterable[str] = ()) -> DataFrame:
    """The first rows as text: time (at most 25 characters), gap with sign, level, action."""
    keys = list(keys)
    return first_rows(interventions, rows, ts, keys).select(
        *keys,
        F.substring(F.date_format(ts, "yyyy-MM-dd HH:mm:ssxxx") if interventions.schema[ts].dataType.typeName()
                    == "timestamp" else F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), 1, 25).alias("time"),
        signed_whole("pred_gap", "+").alias("gap"), "level", "action")
