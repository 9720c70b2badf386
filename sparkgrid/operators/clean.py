"""Missing-value profile, row filters, time-range filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import MIN_PROFILE_ROWS, MONTH_NAMES


def missing_profile(df: DataFrame, columns: list[str] | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, column, missing, missing_pct): one pass, one row per column, per cent to 2 decimals."""
    keys = list(keys)
    columns = columns or [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns])
    long = counted.unpivot([*keys, "_rows"], columns, "column", "present")
    missing = F.col("_rows") - F.col("present")
    return long.select(
        *keys, "column",
        missing.alias("missing"),
        F.bround(F.try_divide(missing, F.col("_rows")) * 100, 2).alias("missing_pct"),
    )


def missing_total(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return missing_profile(df, columns).agg(F.sum("missing").alias("missing"))


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep rows in which all of ``columns`` are known (names not in the table are ignored)."""
    return df.dropna("any", subset=[c for c in columns if c in df.columns])


def usable(df: DataFrame, first: str, second: str, rows: int = MIN_PROFILE_ROWS,
           keys: Iterable[str] = ()) -> DataFrame:
    """One row per series, one flag: both columns have more than ``rows`` known values."""
    return df.groupBy(*keys).agg(((F.count(first) > rows) & (F.count(second) > rows)).alias("usable"))


def without_zone(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Wall-clock time in the session zone (UTC) without a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def duplicates(df: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, ts, rows) that occur more than once."""
    return df.groupBy(*keys, ts).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def require_unique(df: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """``df``, after checking that no series has two rows for one time."""
    found = duplicates(df, ts, keys).take(1)
    if found:
        raise ValueError(f"more than one row for {found[0].asDict()}")
    return df


def date_slice(df: DataFrame, year: int | None = None, month: int | None = None,
               ts: str = "ts") -> tuple[DataFrame, str, str | None]:
    """Rows of a year or of a month, with a label and the resampling that suits the range.

    The filter is a range on the time itself, so that it reaches the scan; if
    the table is partitioned by ``year``, whole partitions are skipped too.
    """
    if year is None:
        return df, "All years", "W"
    first = dt.datetime(year, month or 1, 1)
    after = dt.datetime(year + 1, 1, 1) if month in (None, 12) else dt.datetime(year, month + 1, 1)
    kind = df.schema[ts].dataType.simpleString()
    rows = df.where((F.col(ts) >= F.lit(str(first)).cast(kind)) & (F.col(ts) < F.lit(str(after)).cast(kind)))
    if "year" in df.columns:
        rows = rows.where(F.col("year") == year)
    if month is None:
        return rows, f"Full Year {year}", "D"
    return rows, f"{MONTH_NAMES[month - 1]} {year}", None


def day_kind(df: DataFrame, weekend: bool, ts: str = "ts") -> DataFrame:
    """Only weekend rows, or only weekday rows."""
    return df.where((F.weekday(ts) >= 5) == F.lit(weekend))
