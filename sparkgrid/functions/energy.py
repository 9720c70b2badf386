"""Row-wise energy arithmetic. Positive gap = deficit. NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.functions.columns import clip, signed_parts, zero_to_null


def measured_balance(df: DataFrame) -> DataFrame:
    """Add renewable_total, supply_gap and forecast_error to a cleaned table."""
    return df.withColumns({
        "renewable_total": F.col("solar_gen") + F.col("wind_gen"),
        "supply_gap": F.col("load_actual") - (F.col("solar_gen") + F.col("wind_gen")),
        "forecast_error": F.col("load_actual") - F.col("load_forecast"),
    })


def utilisation(df: DataFrame, generation: str = "solar_gen", capacity: str = "solar_capacity",
                name: str = "solar_utilisation") -> DataFrame:
    """Per cent of capacity in use, between 0 and 100; NULL where capacity is 0 or missing."""
    return df.withColumn(name, clip(F.col(generation) / zero_to_null(capacity) * 100, 0, 100))


def scored_balance(df: DataFrame) -> DataFrame:
    """Add predicted and actual supply and gap to a table with predictions and actuals."""
    return df.withColumns({
        "pred_supply": F.col("pred_solar") + F.col("pred_wind"),
        "actual_supply": F.col("actual_solar") + F.col("actual_wind"),
        "pred_gap": F.col("pred_demand") - (F.col("pred_solar") + F.col("pred_wind")),
        "actual_gap": F.col("actual_demand") - (F.col("actual_solar") + F.col("actual_wind")),
    })


def split_gap(df: DataFrame, gap: str = "pred_gap") -> DataFrame:
    """Add the deficit and surplus halves that a two-colour gap chart fills."""
    deficit, surplus = signed_parts(gap)
    return df.withColumns({"deficit": deficit, "surplus": surplus})


def stack_supply(df: DataFrame, solar: str = "pred_solar", wind: str = "pred_wind") -> DataFrame:
    """Add the lower and upper edge of the stacked supply bands."""
    return df.withColumns({"solar_top": F.col(solar), "wind_top": F.col(solar) + F.col(wind)})


def errors(df: DataFrame, actual: str, predicted: dict[str, str]) -> DataFrame:
    """Add ``err_<name>`` (signed, actual − predicted) and ``abs_<name>`` per prediction column."""
    added = {}
    for name, column in predicted.items():
        added[f"err_{name}"] = F.col(actual) - F.col(column)
        added[f"abs_{name}"] = F.abs(F.col(actual) - F.col(column))
    return df.withColumns(added)
