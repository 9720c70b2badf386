"""The tables behind an interactive view of a classified gap."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.functions.columns import signed_whole, time_text
from sparkgrid.functions.energy import split_gap, stack_supply
from sparkgrid.operators.clean import date_slice
from sparkgrid.operators.features import last_rows
from sparkgrid.operators.levels import classify, override_limits, quantile_thresholds
from sparkgrid.operators.quantiles import median
from sparkgrid.operators.rollups import by_hour, by_month, months, resample, year_month_pivot, yearly_summary, years
from sparkgrid.operators.stats import frequency, kpis
from sparkgrid.session import stage


@dataclass
class Dashboard:
    label: str
    rows: DataFrame            # selected hours with live level and action
    thresholds: DataFrame      # computed from all hours
    kpis: DataFrame
    series: DataFrame          # selected hours, days or weeks
    levels: DataFrame
    log: DataFrame
    gap_by_hour: DataFrame     # all hours from here on
    gap_by_month: DataFrame
    yearly: DataFrame
    heatmap: DataFrame
    # What the view's selectors offer.
    years: DataFrame
    months: DataFrame | None   # of the selected year
    limits: DataFrame          # of the thresholds that the caller may set
    median: DataFrame          # of the gap, all hours


def relevel(df: DataFrame, thresholds: DataFrame, critical: float | None = None,
            high: float | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """Add live_level / live_action under computed thresholds, two of which the caller may set."""
    overrides = {n: v for n, v in (("crit_def", critical), ("high_def", high)) if v is not None}
    return classify(df, "pred_gap", thresholds, keys, overrides=overrides,
                    level_name="live_level", action_name="live_action")


def time_series(df: DataFrame, unit: str | None, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Weekly or daily means, or the hours themselves; with stacked supply and gap halves."""
    shown = resample(df, unit, ts, keys) if unit else df
    return split_gap(stack_supply(shown))


def intervention_log(df: DataFrame, n: int = 72, ts: str = "ts", level: str = "live_level",
                     action: str = "live_action", keys: Iterable[str] = ()) -> DataFrame:
    """The last ``n`` hours as text, in time order."""
    keys = list(keys)
    return last_rows(df, n, ts, keys).select(
        *keys,
        time_text(ts).alias("time"),
        F.concat(signed_whole("pred_gap", "+"), F.lit(" MW")).alias("predicted_gap"),
        F.col(level).alias("level"),
        F.col(action).alias("recommended_action"),
    )


def dashboard(full: DataFrame, year: int | None = None, month: int | None = None, critical: float | None = None,
              high: float | None = None, log_rows: int = 72, ts: str = "ts", keys: Iterable[str] = ()) -> Dashboard:
    """The tables of the view; with ``keys`` each series has its own thresholds, means and log."""
    keys = list(keys)
    selected, label, unit = date_slice(full, year, month, ts)
    # One row per series that several of the tables below read.
    thresholds = stage(quantile_thresholds(full, "pred_gap", keys, truncate=True), "thresholds")
    rows = relevel(selected, thresholds, critical, high, keys)
    return Dashboard(
        label, rows, thresholds,
        kpis=kpis(selected, keys),
        series=time_series(selected, unit, ts, keys),
        levels=frequency(rows, "live_level", keys),
        log=intervention_log(rows, log_rows, ts, keys=keys),
        gap_by_hour=by_hour(full, ["pred_gap"], ts, keys),
        gap_by_month=by_month(full, ["pred_gap"], ts, keys),
        yearly=yearly_summary(full, 1, ts, keys),
        heatmap=year_month_pivot(full, "pred_gap", ts, keys),
        years=years(full, ts, keys),
        months=months(full, year, ts, keys) if year is not None else None,
        limits=override_limits(full, "pred_gap", thresholds, critical, keys),
        median=median(full, "pred_gap", keys),
    )
