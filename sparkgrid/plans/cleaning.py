"""Raw measurements → clean hourly table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from sparkgrid.constants import FFILL_ROWS, INTERPOLATE_ROWS
from sparkgrid.functions.calendar import calendar, season
from sparkgrid.functions.energy import measured_balance, utilisation
from sparkgrid.operators.fill import Fill, fill

MEASURED = ["solar_gen", "wind_gen", "wind_onshore", "wind_offshore", "load_actual", "load_forecast"]


def fill_raw(raw: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Short gaps of measurements forward, capacity forward, price along a line; one pass."""
    rules = {c: Fill("forward", FFILL_ROWS) for c in MEASURED}
    rules["solar_capacity"] = Fill("forward")
    rules["price"] = Fill("interpolate", INTERPOLATE_ROWS)
    return fill(raw, {c: r for c, r in rules.items() if c in raw.columns}, ts, keys)


def clean(raw: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Filled rows with a known load, calendar columns and derived quantities."""
    rows = fill_raw(raw, ts, keys).dropna("any", subset=["load_actual"])
    rows = calendar(rows, ts).drop("day_of_year").withColumn("season", season("month"))
    return utilisation(measured_balance(rows))
