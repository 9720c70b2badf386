"""Joins of predictions and measurements on (keys, time)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.session import join_keys


def join_demand_supply(demand: DataFrame, supply: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Rows present on both sides. (keys, time) is unique on each side, so no key is hot."""
    return join_keys(demand, supply, [*keys, ts], "inner", known=[ts])


def common_times(a: DataFrame, b: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Distinct (keys, time) present in both tables."""
    on = [*keys, ts]
    return a.select(*on).intersect(b.select(*on))


def align_late(df: DataFrame, late: DataFrame, columns: list[str], ts: str = "ts",
               keys: Iterable[str] = ()) -> DataFrame:
    """Attach predictions that start some rows late; NULL before."""
    on = [*keys, ts]
    return join_keys(df, late.select(*on, *columns), on, "left", known=[ts])


def full_gap_rows(demand: DataFrame, supply: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Demand (load_actual, pred_demand) and supply (solar_gen, wind_gen, pred_*) of the same hours, complete rows."""
    marks = [c for c in ("split",) if c in demand.columns]
    joined = join_demand_supply(
        demand.select(*keys, ts, F.col("load_actual").alias("actual_demand"), "pred_demand", *marks),
        supply.select(*keys, ts, F.col("solar_gen").alias("actual_solar"), F.col("wind_gen").alias("actual_wind"),
                      "pred_solar", "pred_wind"),
        ts, keys)
    # A NULL key names a series; all other columns must be known.
    return joined.dropna("any", subset=[c for c in joined.columns if c not in keys])
