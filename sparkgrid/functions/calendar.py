"""Calendar columns derived from the timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import MONTH_NAMES, SEASONS


def day_of_week(ts) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(ts)


def is_weekend(ts) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def season(month) -> Column:
    month = F.col(month) if isinstance(month, str) else month
    chain = F
    for name, months in SEASONS.items():
        chain = chain.when(month.isin(months), name)
    return chain


def month_name(month) -> Column:
    """1 → Jan … 12 → Dec; anything else → NULL."""
    return F.try_element_at(F.array(*map(F.lit, MONTH_NAMES)), month)


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add hour, day_of_week, month, year, day_of_year and is_weekend."""
    return df.withColumns({
        "hour": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "day_of_year": F.dayofyear(ts),
        "is_weekend": is_weekend(ts),
    })


# Period of each calendar column, and the prefix of its sine and cosine.
PERIODS = {"hour": ("hour", 24), "month": ("month", 12), "day_of_week": ("dow", 7), "day_of_year": ("doy", 365)}


def cyclical(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``<prefix>_sin`` / ``<prefix>_cos`` for the given calendar columns."""
    added = {}
    for name in columns:
        prefix, period = PERIODS[name]
        angle = F.lit(2 * math.pi) * F.col(name) / F.lit(period)
        added[f"{prefix}_sin"] = F.sin(angle)
        added[f"{prefix}_cos"] = F.cos(angle)
    return df.withColumns(added)


def start_of_hour(ts) -> Column:
    """Truncate a zone-free timestamp without a detour over the session time zone."""
    return F.col(ts).cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def day_label(ts) -> Column:
    return F.col(ts).cast("date")


def week_label(ts) -> Column:
    """The Sunday that ends the row's week."""
    day = F.col(ts).cast("date")
    return F.date_add(day, 6 - F.weekday(day))
